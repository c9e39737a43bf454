"""Personal data: fixed patterns, and identifiers found from the contexts of these, natively.

The base patterns give e-mail addresses, IP addresses, card numbers and telephone numbers. Their valid matches, and what stands
after a label of ``LABELS`` (``password: ...``), are the seeds of a bootstrap. Instances are the seeds and every token of ``LEAST`` or
more characters that holds a digit or stands in quotes after a colon or an equals sign. Patterns are contexts: the two words before; the word before and the
word after; the word and the marks before (``member no: "``). In ``ROUNDS`` rounds over the graph of patterns and instances the score of a
pattern becomes the share of its occurrences that score, and the score of an instance the chance that not all of its patterns of ``FAIR`` or more err.
Seeds score 1. What a base pattern matched and its check refused (a card number's digits that fail it) scores 0: it is evidence
against its contexts. A context of two words counts as occurring at least as often as chance would bring these together, given the counts of all words in all texts,
so that contexts such as ``the _ of``, which mostly surround ordinary words, come to nothing. Contexts of ``CONFIDENCE`` or more that surround ``SUPPORT`` different instances or more are kept, and every instance that
they surround is personal data of kind ``id``, unless it overlaps a base span. Shapes (``hex40``, ``9-9:7``: runs and the number
of digits) only support: a context of ``FAIR`` or more counts where the shape, too, has ``CONFIDENCE``.

All is DataFrame expressions. The patterns are written so that Java matches them in
linear time and without recursion, also in long runs of letters or digits; they match
what the plain forms in ``PLAIN`` match. Texts are read once: a small table of matches
with the lengths of what lies between them gives the positions, as running sums.

Defined cases: a null or empty text has no spans; repeated rows have the same spans;
null ids stay; an empty table gives an empty result; other columns are ignored.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import join_small, of_row, settle, table, whole_row

#: The base patterns as they are defined.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same for Java: a run is entered at its start, or where the last match ended, and never given back.
FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?<![A-Za-z0-9_])[A-Za-z_]{0,16}+[0-9](?:[\x20().+:_/-]{0,2}[0-9]|[A-Za-z])*+|(?<=[:=]\x20?[\x22\x27])[A-Za-z0-9_+/.=@-]++",
}
#: What a text must hold for a pattern to be tried.
NEED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]", "id": r"[0-9]|[:=]\x20?[\x22\x27]"}
KINDS = ("email", "ip", "card", "phone")
LEAST = 4
#: Labels whose values are seeds.
LABELS = r"(?:^|[^\p{L}\p{N}])(?:password|passwd|pwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|ssn|passport|iban)\s?[:=]\s?[\x22\x27]?$"
ROUNDS = 3
CONFIDENCE, FAIR, SUPPORT, DAMP = 0.5, 0.25, 3, 1.0
#: Code points beside a match in which its neighbouring words are sought; a word that they cut is left out.
BESIDE = 48
#: What stands between the words of a context.
BETWEEN = r"[^\p{L}\p{N}_]+"


def _matches(kind: str):
    """The matches of a kind: an array of (kind, no, gap before, text, words before, words after)."""
    found = F.regexp_extract_all("text", F.lit(FAST[kind]), F.lit(0))
    gaps = F.split("text", FAST[kind])
    part = lambda whole, cut, broken: F.lower(F.when(F.length(whole) > BESIDE, F.regexp_replace(cut, broken, "")).otherwise(whole))
    left = lambda i: part(F.get(F.col("gaps"), i), F.right(F.get(F.col("gaps"), i), F.lit(BESIDE)), r"^\S+")
    right = lambda i: part(F.get(F.col("gaps"), i + 1), F.substring(F.get(F.col("gaps"), i + 1), 1, BESIDE), r"\S+$")
    return found, gaps, lambda arr: F.transform(
        arr,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("no"), F.length(F.get(F.col("gaps"), i)).cast("long").alias("gap"),
            m.alias("match"), left(i).alias("before"), right(i).alias("after"),
        ),
    )


def matches(docs: DataFrame) -> DataFrame:
    """``(rid, doc_id, text_key, ms)``: a row per document, with all matches of all kinds."""
    df = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    for kind in FAST:
        found, gaps, made = _matches(kind)
        has = F.contains("text", F.lit("@")) if kind == "email" else F.col("text").rlike(NEED[kind])
        df = df.withColumn("found", F.when(has, found)).withColumn("gaps", F.when(F.size("found") > 0, gaps))
        df = df.withColumn(f"m_{kind}", F.coalesce(made(F.col("found")), F.array())).drop("found", "gaps")
    ms = F.concat(*[F.col(f"m_{kind}") for kind in FAST])
    return settle(df.select("rid", "doc_id", F.xxhash64("text").alias("text_key"), ms.alias("ms")))


def _luhn(digits):
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def spans(found: DataFrame) -> DataFrame:
    """``(rid, kind, start, end, match, before, after, valid)`` of base matches and of all instances.

    Matches that fail the base check are not ``valid``; of those only such as were near it are returned.
    """
    each = found.select("rid", F.inline("ms"))
    order = W.partitionBy("rid", "kind").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("match").cast("long")
    each = each.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    parts = F.split("match", r"\.")
    fits = (
        F.when(F.col("kind") == "ip", F.forall(parts, lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
        .when(F.col("kind") == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .when(F.col("kind") == "id", F.length("match") >= LEAST)
        .otherwise(True)
    )
    each = each.withColumn("valid", fits).where(F.col("valid") | F.col("kind").isin("ip", "phone") | ((F.col("kind") == "card") & n.between(12, 19)))
    return settle(each.select("rid", "kind", "start", "end", "match", "before", "after", "valid"))


def shape(match):
    """What a token is made of: ``hex40``, ``mix20`` (letters and digits), or its runs and number of digits."""
    mixed = match.rlike("^[A-Za-z0-9]+$") & match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    size = F.length(match).cast("string")
    runs = F.regexp_replace(F.regexp_replace(match, "[A-Za-z]+", "a"), "[0-9]+", "9")
    digits = F.length(F.regexp_replace(match, "[^0-9]", "")).cast("string")
    return F.when(mixed & match.rlike("^[0-9A-Fa-f]+$"), F.concat(F.lit("hex"), size)).when(mixed, F.concat(F.lit("mix"), size)).otherwise(F.concat(runs, F.lit(":"), digits))


def occurrences(each: DataFrame) -> DataFrame:
    """The instances that no base span overlaps and, with ``base``, the base spans; ``seed``, ``refused``; ``contexts`` and ``shape``."""
    sweep = W.partitionBy("rid").orderBy("start", F.col("kind") == "id", "end")
    of = lambda valid, c: F.when((F.col("kind") != "id") & (F.col("valid") == valid), F.col(c))

    def met(valid: bool):
        ends = F.max(of(valid, "end")).over(sweep.rowsBetween(W.unboundedPreceding, 0))
        starts = F.min(of(valid, "start")).over(sweep.rowsBetween(0, W.unboundedFollowing))
        return F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))

    df = each.withColumns({"base": F.col("kind") != "id", "overlaps": met(True), "refused": met(False)}).where("valid and (base or not overlaps)")
    mark = F.regexp_extract("before", r"([\p{L}\p{N}_-]{1,32}\s{0,2}[:=(\[{<#\x22\x27][\s:=(\[{<#\x22\x27]{0,6})$", 1)
    marked = F.when(mark != "", F.concat(F.lit("m:"), F.regexp_replace(mark, r"\s+", " ")))
    words_of = lambda c: F.filter(F.split(c, BETWEEN), lambda w: w != "")
    df = df.withColumns({"marked": marked, "left": words_of("before"), "right": words_of("after")})
    two = F.when(F.size("left") > 1, F.concat(F.lit("b:"), F.get("left", F.size("left") - 2), F.lit(" "), F.element_at("left", -1)))
    both = F.when((F.size("left") > 0) & (F.size("right") > 0), F.concat(F.lit("a:"), F.element_at("left", -1), F.lit(" "), F.get("right", F.lit(0))))
    instance = F.xxhash64(F.lower(F.regexp_replace("match", "[^A-Za-z0-9]", "")))
    seed = F.col("base") | F.col("before").rlike(LABELS)
    return df.select(
        "rid", "start", "end", "base", seed.alias("seed"), (~seed & F.col("refused")).alias("refused"), instance.alias("instance"),
        F.array_compact(F.array(two, both, F.col("marked"))).alias("contexts"), shape(F.col("match")).alias("shape"),
    )


def context_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(pattern, total)``: how often each pair of words in ``wanted`` would meet in all texts, were words independent."""
    t = F.filter(F.split(F.lower("text"), BETWEEN), lambda w: w != "")
    words = settle(docs.select(F.explode(t).alias("word")).groupBy("word").agg(F.count("*").alias("c")))
    every = words.agg(F.sum("c")).first()[0] or 1
    two = F.split(F.substring("pattern", 3, 1 << 20), " ")
    pairs = settle(wanted.where("pattern not like 'm:%'").select("pattern", F.get(two, 0).alias("one"), F.get(two, 1).alias("other")))
    need = settle(pairs.select(F.explode(F.array("one", "other")).alias("word")).distinct())
    counts = settle(join_small(words, need, "word"))
    both = join_small(pairs, counts.select(F.col("word").alias("one"), F.col("c").alias("c1")), "one")
    both = join_small(both, counts.select(F.col("word").alias("other"), F.col("c").alias("c2")), "other")
    return both.select("pattern", (F.col("c1") * F.col("c2").cast("double") / every).alias("total"))


def good_patterns(met: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contexts, and the shapes, that seeds and what is like them lead to: ``(pattern, rating)`` and ``(shape)``."""
    edges = met.select("instance", "seed", "refused", F.explode("contexts").alias("pattern"))
    most = lambda c: F.max(F.col(c).cast("double"))
    edges = settle(edges.groupBy("pattern", "instance").agg(F.count("*").alias("n"), most("seed").alias("seed"), most("refused").alias("refused")))
    supported = settle(edges.groupBy("pattern").agg(F.count("*").alias("support"), F.sum("n").alias("own")).where(F.col("support") >= SUPPORT))
    totals = context_counts(docs, supported)
    supported = settle(supported.join(totals, "pattern", "left").select("pattern", "support", F.greatest(F.col("own").cast("double"), F.coalesce("total", F.lit(0.0))).alias("total")))
    edges = settle(join_small(edges, supported.select("pattern"), "pattern"))
    fixed = met.groupBy("instance").agg(most("seed").alias("seed"), most("refused").alias("refused"))
    start = F.when(F.col("seed") > 0, 1.0).when(F.col("refused") > 0, 0.0)
    fixed = settle(fixed.select("instance", start.alias("fixed")))
    scores = fixed.select("instance", F.coalesce("fixed", F.lit(0.0)).alias("score"))
    for k in range(ROUNDS):
        sums = edges.join(scores, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("scored"))
        rated = settle(sums.where("scored > 0").join(supported, "pattern").select("pattern", (F.col("scored") / (F.col("total") + DAMP)).alias("rating")))
        err = F.exp(F.sum(F.log(F.greatest(1 - F.col("rating"), F.lit(1e-9)))))
        led = join_small(edges, rated.where(F.col("rating") >= FAIR), "pattern").groupBy("instance").agg((1 - err).alias("led"))
        scores = settle(fixed.join(led, "instance", "left").select("instance", F.coalesce("fixed", "led", F.lit(0.0)).alias("score")))
    forms = met.join(scores, "instance").groupBy("shape").agg((F.sum("score") / (F.count("*") + DAMP)).alias("rating"), F.count_distinct("instance").alias("support"))
    shapes = forms.where((F.col("rating") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("shape")
    return rated.where(F.col("rating") >= FAIR), settle(shapes)


def find(docs: DataFrame) -> DataFrame:
    """Every document's ``spans``: an array of (start, order of kind, kind, end); ``rid`` and keys."""
    found = matches(docs)
    each = spans(found)
    met = settle(occurrences(each))
    contexts, shapes = good_patterns(met, docs)
    new = met.where("not base")
    led = join_small(new.select("rid", "start", "end", "shape", F.explode("contexts").alias("pattern")), settle(contexts), "pattern")
    led = join_small(led, shapes.withColumn("known", F.lit(True)), "shape", "left").where((F.col("rating") >= CONFIDENCE) | F.col("known"))
    new = new.where("seed").select("rid", "start", "end").union(led.select("rid", "start", "end"))
    new = new.distinct().select("rid", F.lit("id").alias("kind"), "start", "end")
    both = each.where("valid and kind <> 'id'").select("rid", "kind", "start", "end").union(new)
    rank = F.array_position(F.array(*[F.lit(k) for k in FAST]), F.col("kind"))
    by_row = both.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    return found.drop("ms").join(by_row, "rid", "left").withColumn("spans", F.coalesce("spans", F.array()))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    found = find(docs).where("size(spans) > 0").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "spans")
    own = docs.select(whole_row(docs), F.xxhash64("text").alias("key"))
    df = own.join(found, F.col("row.doc_id").eqNullSafe(found.doc_id) & (own.key == found.text_key), "left").select("row", "spans")
    text = F.col("row.text")
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    df = df.select("row", F.when(F.col("spans").isNotNull(), step).otherwise(text).alias("clean"))
    new = {"text": F.col("clean")} | ({"n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return of_row(df, docs.columns, new)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    shown = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "id")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
        count("id"), F.size("spans").cast("long").alias("n_spans"),
    )
