"""Quality rules: multivariate outliers by minimum covariance determinant, natively.

Each text gives counts (words, vowels, punctuation, capitals, lines, symbols, repeated lines, repeated five-word
windows). A text fails the base rule if it has under ``MIN_WORDS`` words or if over a fifth of its words stand in repeated windows. Five counts
that vary in ordinary prose become a vector: the logarithm of the mean word length, the roots of the shares of vowels, of punctuation, and of capitals and exclamations, and the
logarithm of lines for a word. For each language and source the centre and covariance of the ``CORE`` share of vectors with the least covariance
determinant are found by concentration steps from several pseudo-random halves. That
covariance times ``FACTOR`` is the one of all rows, were they normal; a vector whose
squared Mahalanobis distance is above ``CUTOFF``, the chi-square quantile ``QUANTILE``,
is rejected.

Shares are shrunken so that a short text, whose shares scatter, is not mistaken for an
outlier: as if ``PRIOR`` words of the group's kind were added to it. A factor's diagonal is at least ``LEAST``: a maximum, not a sum, so that it bears only on groups whose texts agree in a count.
Shares of symbols, repeated lines and repeated windows are zero in most texts, so they have no covariance to speak of. They are judged apart:
by how far their roots lie above the core's mean, in units (``CHANCE``) of what chance alone gives a text of
``PRIOR`` words; the sum of squares may reach ``RATES_CUTOFF``.
Estimates are shrunken by row count, so that groups of every size are treated alike: a group of ``n`` rows
has its own with weight ``n / (n + SHRINK)`` and for the rest its language's; that is pooled
from the cores of the language's groups and shrunken likewise towards the whole table's. So a lone text of
a source is judged by its language, and a lone text of a language by the table. Outliers
that are over half of a large group are the group's own kind and stay.

All is DataFrame expressions. The distances are cut at a share of the group by
counting them in narrow logarithmic bins, so that no task sorts a group; sums are of
whole numbers, so that their order does not matter.

Defined cases: a null or wordless text has zero counts and fails; a group too small for any
start to draw a row of it has its language's estimate; if that holds for all groups of a table there is
no estimate, and texts are kept unless the base rule fails them; null languages or
sources are groups of their own; repeated rows count as often as they occur; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import SMALL_ROWS, SPACE, join_small, of_row, settle, table, whole_row, words

MIN_WORDS = 10
WINDOW = 5
PRIOR = 100
CORE = 0.5
#: Hardly any text of a normal group is rejected; of real ones, whose tails are longer, about one in a thousand.
QUANTILE = 1 - 1e-8
RATES_QUANTILE = 0.9999
SHRINK = 60
STARTS, STEPS = 3, 4
DIM = 5
#: Least deviations of the vector, about a third of those in prose: for groups whose texts agree in a count. Where an estimate is larger, they change nothing.
LEAST = (0.005, 0.002, 0.002, 0.002, 0.04)
#: Of the three rates that are judged apart. The root of a rate out of n has a deviation of half the root of 1 / n; words repeat by ten at least, two windows.
CHANCE = (0.5 / (5 * PRIOR) ** 0.5, 0.5 / (PRIOR / 10) ** 0.5, 0.5 / (PRIOR / 10) ** 0.5)
N_RATES = len(CHANCE)


def chi_square(x: float, freedom: int) -> float:
    """The share of the chi-square distribution below ``x``; ``freedom`` is odd."""
    share, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, freedom, 2):
        share, term = share - term, term * x / (k + 2)
    return share


def chi_square_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < share else (low, middle)
    return low


CUTOFF = chi_square_quantile(QUANTILE, DIM)
RATES_CUTOFF = chi_square_quantile(RATES_QUANTILE, N_RATES)
#: From the covariance of the core of normal rows to that of all.
FACTOR = CORE / chi_square(chi_square_quantile(CORE, DIM), DIM + 2)
#: Rates are held as whole numbers of this part.
UNIT = 1 << 16
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with its counts."""
    kept = [c for c in docs.columns if c != text]
    own = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    less = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    df = docs.select(*kept, own.alias("_t"), words(F.col(text)).alias("_w"), F.xxhash64(text).alias("text_key"))
    df = df.select(
        *kept, "text_key", "_w", lines.alias("_l"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        less(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        less(r"[A-Z!]").cast("long").alias("n_shouts"),
        less(r"[.,;:?!]").cast("long").alias("n_marks"),
        less(r"[AEIOUYaeiouy]").cast("long").alias("n_vowels"),
    )
    # The last places have shorter windows, each of a length of its own, which repeat nothing.
    window = F.transform("_w", lambda w, i: F.xxhash64(w, *[F.get(F.col("_w"), i + k) for k in range(1, WINDOW)]))
    df = df.select(
        *kept, "text_key", "n_words", "word_chars", "n_symbols", "n_shouts", "n_marks", "n_vowels",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") > WINDOW, window).alias("_s"),
    )
    repeats = F.size(F.array_distinct("_s")) < F.size("_s")
    df = df.withColumn("_e", F.when(repeats, F.sort_array(F.transform("_s", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_s")
    same = lambda e, i: F.get(F.col("_e"), i)["h"] == e["h"]
    again = F.filter("_e", lambda e, i: F.coalesce((i > 0) & same(e, i - 1), F.lit(False)) | F.coalesce(same(e, i + 1), F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda e: e["i"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_e")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _vectors(counted: DataFrame) -> DataFrame:
    """Each row with its group's name ``g``, its language's ``gl``, its vector ``x0 ...`` and its rates ``r0 ...`` in whole units."""
    df = counted.withColumn("g", F.to_json(F.struct("lang", "source"))).withColumn("gl", F.to_json(F.struct("lang")))
    counts = ("n_words", "word_chars", "n_vowels", "n_marks", "n_shouts", "n_lines")
    good = lambda c: F.sum(F.when(~F.col("base_failed"), F.col(c))).alias(f"_{c}")
    own = settle(df.groupBy("g", "gl").agg(*[good(c) for c in counts]).where("_n_words > 0"))
    by_lang = own.groupBy("gl").agg(*[(F.sum(f"_{c}") / F.sum("_n_words")).alias(f"_l_{c}") for c in counts[1:]])
    words_of = F.lit(SHRINK * PRIOR)
    each = lambda c: ((F.col(f"_{c}") + words_of * F.col(f"_l_{c}")) / (F.col("_n_words") + words_of)).alias(f"_{c}")
    typical = settle(join_small(own, settle(by_lang), "gl").select("g", *[each(c) for c in counts[1:]]))  # for a word of the group's kind
    df = join_small(df, typical, "g", "left")
    n = F.col("n_words") + PRIOR
    full = lambda c, otherwise: F.col(c) + PRIOR * F.coalesce(f"_{c}", F.lit(otherwise))
    chars = full("word_chars", 5.0)
    vector = (
        F.log(chars / n), F.sqrt(full("n_vowels", 2.0) / chars), F.sqrt(full("n_marks", 0.1) / chars), F.sqrt(full("n_shouts", 0.1) / chars), F.log(full("n_lines", 0.1) / n),
    )
    rates = (
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 5 * PRIOR)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + PRIOR / 10)),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    whole = {f"x{k}": x for k, x in enumerate(vector)} | {f"r{k}": x for k, x in enumerate(rates)}
    return df.withColumns({c: F.round(x * UNIT).cast("long") for c, x in whole.items()}).drop(*[f"_{c}" for c in counts[1:]])


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys``: the number ``n`` of rows, the sums ``m0 ...`` of values, ``c00 ...`` of products and ``q0 ...`` of rates, exactly."""
    exact = lambda x: F.sum(x.cast("decimal(20,0)"))
    x = [F.col(f"x{k}") for k in range(DIM)]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[exact(x[i]).alias(f"m{i}") for i in range(DIM)], *[exact(x[i] * x[j]).alias(f"c{i}{j}") for i, j in PAIRS],
        *[exact(F.col(f"r{k}")).alias(f"q{k}") for k in range(N_RATES)],
    )


MEANS, COVS, RATES = [f"m{i}" for i in range(DIM)], [f"c{i}{j}" for i, j in PAIRS], [f"q{k}" for k in range(N_RATES)]


def _moments(sums: DataFrame) -> DataFrame:
    """Sums over cores as means ``m0 ...`` and ``q0 ...`` and covariances ``c00 ...`` of all rows."""
    df = sums.withColumns({m: F.col(m).cast("double") / F.col("n") for m in (*MEANS, *RATES)})
    return df.withColumns({f"c{i}{j}": FACTOR * (F.col(f"c{i}{j}").cast("double") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) for i, j in PAIRS})


def _factored(df: DataFrame) -> DataFrame:
    """``df`` with the Cholesky factor ``l00 ...`` of its covariances and ``volume``, the logarithm of its determinant's root."""

    def rest(i: int, j: int):
        left = F.col(f"c{i}{j}")
        for k in range(j):
            left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        return left

    for j in range(DIM):  # column by column
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest(j, j), F.lit((LEAST[j] * UNIT) ** 2))))
        df = df.withColumns({f"l{i}{j}": rest(i, j) / F.col(f"l{j}{j}") for i in range(j + 1, DIM)}) if j < DIM - 1 else df
    return df.withColumn("volume", sum((F.log(F.col(f"l{i}{i}")) for i in range(1, DIM)), F.log(F.col("l00")))).drop(*COVS)


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance to their group's estimate (null: it has none), and ``far``, that of the rates."""
    df = join_small(rows, estimates, "g", "left")
    above = [F.greatest(F.col(f"r{k}") - F.col(f"q{k}"), F.lit(0.0)) / (c * UNIT) for k, c in enumerate(CHANCE)]
    df = df.withColumn("far", sum((a * a for a in above[1:]), above[0] * above[0]))
    for i in range(DIM):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIM)), F.col("z0") * F.col("z0"))
    return df.withColumn("d2", d2).drop("volume", "n", *RATES, *[f"{c}{i}" for c in "mz" for i in range(DIM)], *[f"l{i}{j}" for i, j in PAIRS])


def _core(rows: DataFrame, share: float) -> DataFrame:
    """Per group and start, the sums over the rows with the least ``d2``: at least ``share`` of them.

    Rows are added up by bin of their distance, in the tasks that read them; only the
    bins' sums move.
    """
    bins = _sums(rows.where("d2 is not null").withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-9) * 16).cast("int")), "g", "start", "bin")
    every = W.partitionBy("g", "start")
    bins = bins.withColumn("before", F.sum("n").over(every.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(every))
    near = bins.where(F.col("before") < share * F.col("all"))
    return near.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in near.columns if c not in ("g", "start", "bin", "before", "all")])


def cores(vectors: DataFrame) -> DataFrame:
    """Per group the sums over its core: that of the start which ends in the least determinant."""
    vectors = vectors.select("g", "row_hash", *[f"x{k}" for k in range(DIM)], *[f"r{k}" for k in range(N_RATES)])
    started = vectors.withColumn("start", F.explode(F.array(*[F.lit(s) for s in range(STARTS)])))
    sums = _sums(started.where(F.pmod(F.xxhash64("row_hash", "start"), F.lit(2)) == 0), "g", "start")
    for _ in range(STEPS):
        found = settle(_factored(_moments(sums)).drop("n"))
        sums = settle(_core(_distance(vectors, found), CORE))
    volumes = _factored(_moments(sums)).select("g", "start", "volume")
    tightest = F.row_number().over(W.partitionBy("g").orderBy("volume", "start"))
    best = volumes.withColumn("_k", tightest).where("_k = 1").select("g", "start")
    return settle(sums.join(best, ["g", "start"]).drop("start"))


def estimates(vectors: DataFrame) -> DataFrame:
    """Each group's means ``m0 ...``, ``q0 ...`` and factor ``l00 ...``: its minimum-covariance-determinant estimate, shrunken."""
    groups = settle(vectors.select("g", "gl").distinct())
    own = settle(groups.join(cores(vectors), "g", "left"))
    pooled = lambda df, *keys: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", *MEANS, *COVS, *RATES)])
    some = own.where("n is not null")
    by_lang, whole = pooled(some, "gl"), pooled(some)
    named = lambda df, prefix: df.select(*[F.col(c).alias(prefix + c if c in ("n", *MEANS, *COVS, *RATES) else c) for c in df.columns])
    df = join_small(_moments(own), settle(named(_moments(by_lang), "l_")), "gl", "left")
    df = df.crossJoin(F.broadcast(named(_moments(whole), "t_")))  # one row
    rows = lambda c: F.coalesce(F.col(c), F.lit(0)) / CORE
    weight = lambda c: rows(c) / (rows(c) + SHRINK)
    mixed = lambda w, a, b: w * F.coalesce(a, F.lit(0.0)) + (1 - w) * b
    made = {c: mixed(weight("n"), F.col(c), mixed(weight("l_n"), F.col("l_" + c), F.col("t_" + c))) for c in (*MEANS, *COVS, *RATES)}
    return settle(_factored(df.select("g", *[x.alias(c) for c, x in made.items()])))


def judge(docs: DataFrame) -> DataFrame:
    """Every document's counts, ``base_failed``, distance ``d2`` and verdict ``kept``; no text."""
    need = docs.select("doc_id", "text", "lang", "source")
    counted = settle(with_counts(need))
    vectors = settle(_vectors(counted).withColumn("row_hash", F.xxhash64("doc_id", "text_key")))
    judged = _distance(vectors, estimates(vectors.where("not base_failed")))
    fits = (F.col("d2") <= CUTOFF) & (F.col("far") <= RATES_CUTOFF)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True)))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones; the texts stay where they are if these are counted to be few."""
    out = judge(docs).where("not kept")
    out = settle(out.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "lang", "source", "text_key").alias("key")).distinct())
    own = docs.select(whole_row(docs), F.xxhash64("doc_id", "lang", "source", F.xxhash64("text")).alias("own"))
    few = F.broadcast(out) if out.count() <= SMALL_ROWS else out
    return of_row(own.join(few, (own.own == out.key) & F.col("row.doc_id").eqNullSafe(out.id), "left_anti"), docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "far"
    )
