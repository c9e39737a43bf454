"""Spelling variant grouping: words one edit apart, by a positional q-gram inverted index with a count filter.

Words are runs of letters (Latin-1), of which pseudorandom ones lost a letter; those of ``LETTERS`` code points or
more that occur ``LEAST`` times or more are compared. Two are near if one insertion, deletion or replacement turns one
into the other.

Lists of single q-grams grow with the vocabulary, so it is first cut into blocks that any two near words share. For a pair whose longer word has
``m`` code points, that word has three parts at fixed places; one edit leaves two of them whole,
at places known up to one. So a block is named by ``m``, the part left out, and the rest: each word of length
``m`` is in three blocks, and as the shorter word of a pair in three of ``m + 1``. A block of over ``BLOCK`` words is
left, and its words go to blocks named by the word less one code point; these hold at most ``m`` times the
alphabet, whatever the vocabulary's size. Both ways lose no pair.

In each block an inverted index lists, for each q-gram (``Q``) and position in the part left out and
``Q - 1`` code points on its sides, the words that have it. Each longer word heap-merges the lists of its own q-grams, for words of
its length those at the same position, for shorter ones also those one place to the left; a word met ``bound`` times
or more is a candidate: one edit changes ``Q`` q-grams at most, so of ``g`` q-grams ``g - Q`` remain. Candidates
are verified letter by letter.

A word's form is its near word with the largest count (ties: the first in code-point order), if that is ``TIMES`` its own or
more. Counts grow by that factor along a chain of forms, so its end is found in as many rounds as the logarithm of a logarithm of the largest count.

Defined cases: a null or empty text has no words; a null id is written as an empty string; repeated rows count again; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import join_small, settle, table

LETTERS, LEAST, TIMES = 7, 2, 10
DROP = 31
RUN = r"[A-Za-zÀ-ÿ]+"
Q = 2
#: Most words of a block.
BLOCK = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIRS = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n)``: the words that are compared and how often they occur."""
    long_enough = RUN.replace("+", f"{{{LETTERS},}}+")  # shorter runs cannot give such a word
    each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(long_enough), F.lit(0))).alias("run"))
    each = each.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    hashed = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary"))
    each = each.select("run", hashed.alias("h"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.left("run", at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DROP == 0, cut).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def ends(m: int) -> tuple[int, int, int, int]:
    """Where the three parts of a word of ``m`` code points begin and end."""
    return 0, m // 3, 2 * m // 3, m


def entries(words: DataFrame) -> DataFrame:
    """``(key, part, longer, word, n)``: each word in its blocks."""
    size = F.length("word")

    def rows(longer: bool):
        m = size if longer else size + 1
        edges = [F.lit(0), F.floor(m / 3).cast("int"), F.floor(2 * m / 3).cast("int"), m]
        for part in range(3):
            after = edges[part + 1] if longer else edges[part + 1] - 1
            rest = F.concat(F.left("word", edges[part]), F.substring(F.col("word"), after + 1, size))
            yield F.struct(F.xxhash64(m, F.lit(part), rest).alias("key"), F.lit(part).alias("part"), F.lit(longer).alias("longer"))

    return words.select("word", "n", F.inline(F.array(*rows(True), *rows(False)))).select("key", "part", "longer", "word", "n")


def finer_entries(words: DataFrame) -> DataFrame:
    """The same in blocks named by a word less one code point; the shorter word of a pair names one itself."""
    size = F.length("word")
    less = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.concat(F.left("word", k), F.substring(F.col("word"), k + 2, size)))
    longer = F.transform(F.array_distinct(less), lambda x: F.struct(F.xxhash64(size, F.lit(3), x).alias("key"), F.lit(3).alias("part"), F.lit(True).alias("longer")))
    shorter = F.array(F.struct(F.xxhash64(size + 1, F.lit(3), F.col("word")).alias("key"), F.lit(3).alias("part"), F.lit(False).alias("longer")))
    return words.select("word", "n", F.inline(F.concat(longer, shorter))).select("key", "part", "longer", "word", "n")


def one_edit(a: str, b: str) -> bool:
    """Whether one edit turns ``a`` into ``b``; ``a`` is as long, or one longer."""
    if a == b or len(a) - len(b) not in (0, 1):
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1 :] == b[k + (len(a) == len(b)) :]


def near_in_block(part: int, longer: list[str], shorter: list[str]) -> Iterator[tuple[int, int, bool]]:
    """``(i, j, same)``: longer word ``i`` is near longer word ``j`` (after it) or, if not ``same``, near shorter word ``j``."""
    m = len(longer[0])
    lo, hi = (ends(m)[part], ends(m)[part + 1]) if part < 3 else (0, m)
    lo, hi = max(0, lo - Q + 1), min(m, hi + Q - 1)
    bound = hi - lo - Q + 1 - Q
    lists: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for side, words in enumerate((longer, shorter)):
        for no, w in enumerate(words):
            for p in range(lo, min(hi, len(w)) - Q + 1):
                lists[side][p, w[p : p + Q]].append(no)  # in order, so that lists can be merged
    for i, w in enumerate(longer):
        grams = [(p, w[p : p + Q]) for p in range(lo, hi - Q + 1)]
        for side, words in enumerate((longer, shorter)):
            if not words:
                continue
            if bound <= 0:
                met = range(i + 1 if side == 0 else 0, len(words))
            else:
                found = [lists[side][g] for g in grams if g in lists[side]]
                if side == 1:  # behind the letter that the shorter word lacks
                    found += [lists[1][p - 1, g] for p, g in grams if (p - 1, g) in lists[1]]
                met = [j for j, same in groupby(merge(*found)) if (side == 1 or j > i) and sum(1 for _ in same) >= bound]
            for j in met:
                if one_edit(w, words[j]):
                    yield i, j, side == 0


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for part, longer, shorter in zip(*(batch.column(c).to_pylist() for c in ("part", "longer", "shorter"))):
            longer, shorter = (sorted((x["word"], x["n"]) for x in side) for side in (longer, shorter))
            by_size = lambda words: groupby(sorted(words, key=lambda x: (len(x[0]), x[0])), key=lambda x: len(x[0]))
            short = {m: list(own) for m, own in by_size(shorter)}  # several lengths only where keys collide
            for m, own in by_size(longer):
                own, less = list(own), short.get(m - 1, [])
                for i, j, same in near_in_block(part, [w for w, _ in own], [w for w, _ in less]):
                    out.append((*own[i], *(own if same else less)[j]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, PAIRS)], schema=PAIRS)


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, n_a, b, n_b)``: all pairs of near words, each in both orders."""
    rows = entries(words)
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if("longer").alias("n_longer"))
    sizes = sizes.where("size > 1 and n_longer > 0")
    light = rows.join(sizes.where(F.col("size") <= block).select("key"), "key")
    heavy = settle(sizes.where(F.col("size") > block).select("key"))
    crowded = join_small(rows, heavy, "key").select("word", "n").distinct()
    side = lambda df, c: F.collect_list(F.when(df.longer if c == "longer" else ~df.longer, F.struct("word", "n"))).alias(c)
    gathered = lambda df: df.groupBy("key").agg(F.first("part").alias("part"), side(df, "longer"), side(df, "shorter")).where("size(longer) > 0 and size(longer) + size(shorter) > 1")
    blocks = gathered(light).union(gathered(finer_entries(crowded)))
    pairs = settle(blocks.select("part", "longer", "shorter").mapInArrow(_pairs, "a string, n_a long, b string, n_b long").distinct())
    return pairs.union(pairs.select("b", "n_b", "a", "n_a"))


def last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for the rows ``(word, form)``: where following the forms ends. Each round doubles the steps."""
    reached = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = settle(reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if after.where("moved").limit(1).count() == 0:
            return after.select("word", "root")
        reached = after.select("word", "root")


def variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)``: a row for each word."""
    words = settle(vocabulary(docs))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")))
    near = near_pairs(words, block).groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"))
    df = words.join(near, words.word == near.a, "left")
    fits = -F.col("best.less") >= TIMES * F.col("n")
    df = settle(df.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    roots = last_forms(df.where("form is not null"))
    return df.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
