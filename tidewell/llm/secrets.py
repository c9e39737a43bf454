"""Secret scans by a trigram inverted index, natively.

Each rule is a regular expression. From it a Boolean query over trigrams is derived: the strings that each run of
finite parts can spell are listed, a string needs all of its trigrams, alternatives are or-ed, parts that follow
one another are and-ed, and a part of unknown content asks for nothing. The query is held as clauses: a text is a candidate
of a rule if it has all trigrams of one clause. A rule without a mandatory trigram (``hex``) scans every text.

The index has a posting ``(trigram, text key)`` for each trigram of the rules' queries that a text holds, letters in lower case. Postings are
intersected by adding up, for each text and clause, a bit for each trigram that was met: a clause whose bits are all set
makes the text a candidate. Equal texts share their postings, so copies are indexed once. Text keys are hashes: a
collision can add a candidate, which the pattern then does not match, but lose none. Candidates are verified by the patterns
themselves over whole texts. Where candidates are counted to be few they are broadcast and no text moves.

Base kinds come first in ``RULES``; of their matches those too short are dropped, without a second try. The
others are forms of public services' keys.

Defined cases: a null or empty text has no spans; repeated rows have the same spans; null ids stay; texts are scanned
whole; an empty table gives an empty result; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import join_small, settle, table


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{either_case('api')}_?{either_case('key')}"
#: Kinds and their patterns, which Java, Python and RE2 match alike; the base kinds first.
RULES = {
    "assign": rf"({_NAMES})[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "github": r"gh[opsu]_[A-Za-z0-9]{36,}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"[rs]k_live_[0-9A-Za-z]{16,}",
    "url": r"://[^\x00-\x20:@/\x22']{1,64}:[^\x00-\x20:@/\x22']{3,64}@",
}
BASE = ("assign", "access", "hex")
#: Code points that a match needs, or its second group in ``assign``; others need what their pattern says.
LEAST = {"assign": 6, "access": 20}
#: Most strings that a finite part is spelled out into, and most clauses of a query. Beyond, parts ask for less; no text is missed.
SPELLED, CLAUSES = 64, 64

Clauses = frozenset[frozenset[str]]


def _spelled(items) -> set[str] | None:
    """All strings that a sequence can match, in lower case; None if they are too many or without bound."""
    out = {""}
    for op, av in items:
        one: set[str] | None = None
        if op is sre.LITERAL:
            one = {chr(av).lower()}
        elif op is sre.IN and av[0][0] is not sre.NEGATE and all(kind in (sre.LITERAL, sre.RANGE) for kind, _ in av):
            one = {chr(c).lower() for kind, x in av for c in ([x] if kind is sre.LITERAL else range(x[0], x[1] + 1))}
        elif op is sre.BRANCH:
            each = [_spelled(branch) for branch in av[1]]
            one = None if any(e is None for e in each) else set().union(*each)
        elif op is sre.SUBPATTERN:
            one = _spelled(av[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[1] <= 4:
            each = [_spelled(list(av[2]) * n) for n in range(av[0], av[1] + 1)]
            one = None if any(e is None for e in each) else set().union(*each)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            one = {""}
        if one is None or len(one) * len(out) > SPELLED:
            return None
        out = {a + b for a in out for b in one}
    return out


def _least(clauses) -> Clauses:
    """Without clauses that ask for more than another one."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _of_strings(strings: set[str]) -> list[Clauses]:
    if any(len(s) < 3 for s in strings):
        return []
    return [_least({frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings})]


def _conjuncts(items) -> list[Clauses]:
    """What every match of a sequence holds: all of the list, of each the trigrams of one clause."""
    run, out = {""}, []
    for item in items:
        op, av = item
        one = _spelled([item])
        if one is not None and len(one) * len(run) <= SPELLED:
            run = {a + b for a in run for b in one}
            continue
        out += _of_strings(run)
        run = {""} if one is None else one
        if one is None and op is sre.SUBPATTERN:
            out += _conjuncts(av[-1])
        elif one is None and op is sre.BRANCH:
            each = [_joined(_conjuncts(branch)) for branch in av[1]]
            out += [] if any(e is None for e in each) else [_least(set().union(*each))]
        elif one is None and op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[0]:
            out += _conjuncts(list(av[2]) * min(av[0], 3))
    return out + _of_strings(run)


def _joined(conjuncts: list[Clauses]) -> Clauses | None:
    """The clauses of them all together; a conjunct that would make too many clauses is left out."""
    out: Clauses | None = None
    for one in sorted(conjuncts, key=len):
        if out is None:
            out = one
        elif len(out) * len(one) <= CLAUSES:
            out = _least({a | b for a, b in product(out, one)})
    return out


def trigram_query(pattern: str) -> Clauses | None:
    """The clauses of trigrams of which every match of ``pattern`` holds one whole; None if nothing is mandatory."""
    return _joined(_conjuncts(_parser.parse(pattern)))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(t, text_key)``: the inverted index of the given trigrams, by their numbers; copies of a text may repeat."""
    df = docs.select(F.xxhash64("text").alias("text_key"), F.lower("text").alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))
    return df.select("text_key", F.explode(held).alias("t"))


def candidates(docs: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """``(text_key, kinds)``: the texts that hold all trigrams of a clause, and whose."""
    if not queries:
        return docs.select(F.xxhash64("text").alias("text_key"), F.array(F.lit("")).alias("kinds")).where(F.lit(False))
    trigrams = sorted({t for clauses in queries.values() for c in clauses for t in c})
    rows = []
    for kind, clauses in queries.items():
        for no, clause in enumerate(sorted(map(sorted, clauses))):
            parts = [clause[k : k + 62] for k in range(0, len(clause), 62)]  # bits of a long
            rows += [(trigrams.index(t), kind, no, part, len(parts), 1 << bit, (1 << len(own)) - 1) for part, own in enumerate(parts) for bit, t in enumerate(own)]
    terms = docs.sparkSession.createDataFrame(rows, "t int, kind string, clause int, part int, parts int, bit long, full long")
    met = postings(docs, trigrams).join(F.broadcast(terms), "t")  # a row for each trigram of the rules
    met = met.groupBy("text_key", "kind", "clause", "part").agg(F.bit_or("bit").alias("held"), F.first("full").alias("full"), F.first("parts").alias("parts")).where("held = full")
    whole = met.groupBy("text_key", "kind", "clause").agg(F.count("*").alias("n"), F.first("parts").alias("parts")).where("n = parts")
    return settle(whole.groupBy("text_key").agg(F.collect_set("kind").alias("kinds")))


def matches(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``(rid, doc_id, ms)``: a row per document with its matches ``(kind, no, gap, match)``."""
    queries = {kind: q for kind, pattern in rules.items() if (q := trigram_query(pattern))}
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("rid"))
    df = join_small(own, candidates(docs, queries), "text_key", "left")
    for kind, pattern in rules.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        found = F.when(F.array_contains("kinds", kind), found) if kind in queries else found
        df = df.withColumn("_found", found)
        gaps = F.when(F.size("_found") > 0, F.split("text", pattern))
        df = df.withColumn("_gaps", gaps)
        made = F.transform("_found", lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), F.length(F.get("_gaps", i)).cast("long").alias("gap"), m.alias("match")))  # noqa: B023
        df = df.withColumn(f"_m_{kind}", F.coalesce(made, F.array())).drop("_found", "_gaps")
    return settle(df.select("rid", "doc_id", F.concat(*[F.col(f"_m_{kind}") for kind in rules]).alias("ms")))


def find(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Every document's ``spans``: an array of (start, rank of kind, kind, end), by start, then kind."""
    found = matches(docs, rules)
    each = found.select("rid", F.inline("ms"))
    size = F.length("match").cast("long")
    order = W.partitionBy("rid", "kind").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    for kind, least in LEAST.items():
        if kind in rules:
            value = F.regexp_extract("match", rules[kind], 2) if kind == "assign" else F.col("match")
            each = each.where((F.col("kind") != kind) | (F.length(value) >= least))
    rank = F.array_position(F.array(*[F.lit(k) for k in rules]), F.col("kind"))
    by_row = each.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    return found.drop("ms").join(by_row, "rid", "left").withColumn("spans", F.coalesce("spans", F.array()))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    shown = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The same in SQL: every pattern over every text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        f"SELECT rid, {rank} AS rank, '{kind}' AS kind, unnest(range(len(m))) AS no, unnest(m) AS match, unnest(list_transform(g[: len(m)], lambda x: length(x))) AS gap "
        f"FROM (SELECT rid, regexp_extract_all(text, {quoted(p)}) AS m, regexp_split_to_array(text, {quoted(p)}) AS g FROM d WHERE regexp_matches(text, {quoted(p)}))"
        for rank, (kind, p) in enumerate(RULES.items())
    ]
    shown = lambda where: f"coalesce(string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank){where}, '')"
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, sum(gap + length(match)) OVER (PARTITION BY rid, kind ORDER BY no) AS hi FROM m),
s AS (SELECT *, (hi - length(match))::BIGINT AS lo FROM p
      WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(match, {quoted(RULES["assign"])}, 2)) >= {LEAST["assign"]} WHEN 'access' THEN length(match) >= {LEAST["access"]} ELSE true END),
f AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
             {shown(f" FILTER (kind IN ({base}))")} AS base, {shown("")} AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (rid)"""
