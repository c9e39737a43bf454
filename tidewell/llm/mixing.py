"""Mixing sources to target weights, natively.

Sources, in code-point order with null last, weigh 5, 2, 1, repeating. They share
``SHARE`` (150%) of all words by weight; a target stops at ``MOST`` (2) times its source's
size and the excess goes to the others by weight.

The texts of a source, one after the other, are cut into blocks of ``BLOCK`` words. The mix
is a number of output shards of about ``SHARD`` slots each, one block to a slot. How many slots each
source gets in each shard is drawn at random: multinomial counts, given that a source's slots
add up to its target (free draws would miss the targets and could go over the stop).
The draw goes down a tree of shards: at each node the slots split by a binomial draw, the number of ones among as
many pseudorandom bits, so no slot needs a row; a node with many slots is drawn in parts, ``FAN`` children at a time.
A source's slots are numbered through the shards; number ``i`` of a pass over the source takes block ``permutation(i)``, a
pseudorandom permutation of the source's own block numbers, so that no block is taken
again before all others were. The last slot takes only as many words of its block as the target still
lacks. Slots and the texts' parts are joined by source and block number; what a document gives to the mix
is the sum of these rows.

Permutations are swap-or-not shuffles of any whole length: rows need no sort and no
state, and a rerun gives the same mix. Sources are ranked by a distributed sort, and the level of
their targets is found by sums over all of them, so many sources need no task of their own.

Defined cases: a null or wordless text has size 0 and is never taken; a null source is a
source; repeated rows are separate documents that lie side by side in their source; an
empty table gives an empty result; other columns stay with their row.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import join_small, new_dir, of_row, row_key, running_total, settle, table, whole_row, words

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK, SHARD = 128, 1024
ROUNDS = 24
SEED = 7
#: Children that a node of the tree is split into at once, as a power of two; slots drawn at once.
FAN_BITS, DRAW_SLOTS = 8, 1 << 22
#: Slots that one task numbers at most.
TASK_SLOTS = 1 << 18


def _rounds(x, n, names, order):
    def swap(at, r):
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *names, r), n) - at + n, n)
        pair = F.greatest(at, other)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), *names, r, pair), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(order, x.cast("long"), swap)


def permuted(x, n, *names):
    """The place of ``x`` (0 to n - 1) in the pseudorandom permutation that ``names`` give."""
    return _rounds(x, n, names, F.sequence(F.lit(1), F.lit(ROUNDS)))


def place_of(y, n, *names):
    """The ``x`` whose place is ``y``: each round is its own inverse."""
    return _rounds(y, n, names, F.sequence(F.lit(ROUNDS), F.lit(1)))


def ones(n, *names):
    """A binomial draw: how many of ``n`` pseudorandom bits are one."""
    rest = F.pmod(n, F.lit(64)).cast("int")
    some = F.when(rest > 0, F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - rest)).otherwise(0)
    mask = lambda i: F.when(i < F.floor(n / 64), F.lit(-1).cast("long")).otherwise(some)
    bits = lambda i: F.bit_count(F.xxhash64(F.lit(SEED + 2), *names, i).bitwiseAND(mask(i))).cast("long")
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n / 64)), F.lit(0).cast("long"), lambda a, i: a + bits(i))


def measured(docs: DataFrame) -> DataFrame:
    """Each document's ``rid`` (of this row alone), key of its whole row, and ``size``."""
    size = F.size(words(F.col("text"))).cast("long")
    return settle(docs.select("doc_id", "source", row_key(docs).alias("row_key"), size.alias("size"), F.monotonically_increasing_id().alias("rid")))


def ranked(sizes: DataFrame) -> DataFrame:
    """``(source, rank, source_size)``: sources in order, by a sort into ranges and the ranges' counts."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = settle(by.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("within", F.col("at") - F.shiftleft(F.col("part"), 33))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row for each partition
    return placed.join(F.broadcast(parts), "part").select("source", (F.col("before") + F.col("within") + 1).alias("rank"), "source_size")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, rank, source_size, target)``, the number of blocks and slots, and the words of the last slot; a row per source."""
    of = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    df = ranked(sizes).withColumn("weight", F.element_at(of, (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    df = settle(df.withColumn("limit", MOST * F.col("source_size")))
    # The level rises until it meets no further limit; what stops at its limit leaves the rest to the others.
    stopped, level = -1, 0.0
    while True:
        over = F.lit(stopped < 0) & F.lit(False) if stopped < 0 else F.col("weight") * level > F.col("limit")
        now = df.agg(
            F.sum("source_size").alias("all"), F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0)).alias("held"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        if now.n == stopped or not now.weight:
            break
        stopped, level = now.n, (SHARE * now.all - now.held) / now.weight
    df = df.withColumn("target", F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight")))
    size, wanted = F.col("source_size"), F.round("target").cast("long")
    df = df.withColumn("n_blocks", F.ceil(size / BLOCK).cast("long")).withColumn("passes", F.when(size > 0, F.floor(wanted / size)).otherwise(0))
    df = df.withColumn("rest", wanted - F.col("passes") * size)
    short = size - BLOCK * (F.col("n_blocks") - 1)  # words of the last block
    at = F.when(F.col("n_blocks") > 0, place_of(F.col("n_blocks") - 1, F.col("n_blocks"), F.lit("block"), F.col("rank")))
    df = df.withColumn("short", short).withColumn("short_at", at)
    first = lambda k: BLOCK * k - F.when(F.col("short_at") < k, BLOCK - F.col("short")).otherwise(0)  # noqa: E731  words of the first k slots
    least = F.ceil(F.col("rest") / BLOCK).cast("long")
    df = df.withColumn("partial", least).withColumn("partial", F.when(first(F.col("partial")) < F.col("rest"), F.col("partial") + 1).otherwise(F.col("partial")))
    df = df.withColumn("slots", F.coalesce(F.col("passes") * F.col("n_blocks") + F.col("partial"), F.lit(0)))
    df = df.withColumn("last_words", F.when(F.col("partial") > 0, F.col("rest") - first(F.col("partial") - 1)))
    return settle(df.select("source", "rank", "source_size", "target", "n_blocks", "slots", "last_words"))


def shard_counts(sources: DataFrame, bits: int) -> DataFrame:
    """``(shard, rank, n)``: the slots that each source gets in each of the ``2 ** bits`` output shards."""
    counts = sources.where("slots > 0").select(F.lit(0).cast("long").alias("shard"), "rank", F.col("slots").alias("n"))
    while bits > 0:
        step = min(FAN_BITS, bits)
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAW_SLOTS).cast("long")))
        parts = counts.select("shard", "rank", "n", part.alias("part")).withColumn("m", F.least(F.col("n") - F.col("part"), F.lit(DRAW_SLOTS)))
        for level in range(step):
            draw = ones(F.col("m"), F.lit(bits - level), F.col("shard"), F.col("rank"), F.col("part"))
            parts = parts.select("shard", "rank", "part", "m", draw.alias("left"))
            sides = F.array(F.struct((2 * F.col("shard")).alias("shard"), F.col("left").alias("m")), F.struct((2 * F.col("shard") + 1).alias("shard"), (F.col("m") - F.col("left")).alias("m")))
            parts = parts.select("rank", "part", F.inline(sides)).where("m > 0")
        counts = parts.groupBy("shard", "rank").agg(F.sum("m").alias("n"))
        bits -= step
    return counts


def mix(sources: DataFrame) -> DataFrame:
    """The mix: ``(shard, rank, slot, pass, block, slot_words)``, a row per slot.

    Permuting a slot takes far more time than bytes, so the number of tasks is set from
    the number of slots.
    """
    all_slots = sources.agg(F.sum("slots")).first()[0] or 0
    bits = max(0, -(-all_slots // SHARD) - 1).bit_length()
    tasks = max(sources.sparkSession.sparkContext.defaultParallelism, all_slots // TASK_SLOTS)
    counts = settle(shard_counts(sources, bits)).withColumn("bucket", F.floor(F.col("shard") / (1 + isqrt(1 << bits))))
    numbered = running_total(counts, ["rank"], ["shard"], "n", "bucket", "before").repartition(tasks, "rank", "shard")
    slot = F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1))
    slots = join_small(numbered.select("shard", "rank", slot.alias("slot")), sources.select("rank", "n_blocks", "slots", "last_words"), "rank")
    block = permuted(F.pmod("slot", "n_blocks"), F.col("n_blocks"), F.lit("block"), F.col("rank"))
    cut = F.when((F.col("slot") == F.col("slots") - 1) & F.col("last_words").isNotNull(), F.col("last_words")).otherwise(BLOCK)
    return slots.select("shard", "rank", "slot", F.floor(F.col("slot") / F.col("n_blocks")).alias("pass"), block.alias("block"), cut.alias("slot_words"))


def parts(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``(rid, rank, block, first, offset, words)``: each document's part of each block, from its word ``first`` on."""
    buckets = 1 + isqrt(sizes.count())  # as many buckets as rows in each: both levels of the running total stay small
    ranks = settle(sources.select(F.col("source").alias("_source"), "rank"))
    df = sizes.where("size > 0")
    df = df.join(F.broadcast(ranks) if ranks.count() <= 50_000 else ranks, F.col("source").eqNullSafe(F.col("_source")))
    df = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(buckets)))
    df = running_total(df, ["rank"], ["doc_id", "row_key", "rid"], "size", "bucket", "start")
    block = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)))
    df = df.select("rid", "rank", "start", "size", block.alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * BLOCK)
    return df.select(
        "rid", "rank", "block", (first - F.col("start")).alias("first"), (first - F.col("block") * BLOCK).alias("offset"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - first).alias("words"),
    )


def packed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """The packed mix: ``(shard, rank, slot, pass, block, offset, rid, first, words)``.

    A row for each document's part of each slot: ``words`` words of document ``rid`` from its word ``first`` on stand at
    ``offset`` in the slot.
    """
    df = parts(sizes, sources).join(mix(sources), ["rank", "block"])
    df = df.withColumn("words", F.least(F.col("words"), F.col("slot_words") - F.col("offset"))).where("words > 0")
    return df.select("shard", "rank", "slot", "pass", "block", "offset", "rid", "first", "words")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with ``docs``' columns: of each, the words taken, and again those taken twice.

    Rows are written once with a number each, by which the plan finds them again; so a row is never
    told by a hash, and texts move once. That copy stays in the shared folder until the result has been read.
    """
    path = new_dir(docs.sparkSession, "numbered")
    size = F.size(words(F.col("text"))).cast("long")
    docs.select(whole_row(docs), row_key(docs).alias("row_key"), size.alias("size"), F.monotonically_increasing_id().alias("rid")).write.parquet(path)
    numbered = docs.sparkSession.read.parquet(path)
    sizes = numbered.select("row.doc_id", "row.source", "row_key", "size", "rid")
    pieces = packed(sizes, targets(sizes)).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pass", "first", "words"))).alias("pieces"))
    # The words are split below the explode, so that the pieces do not each split the text again.
    df = numbered.join(pieces, "rid").withColumn("own_words", words(F.col("row.text"))).withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    mine = F.filter("pieces", lambda p: p["pass"] == F.col("turn"))
    df = df.withColumn("taken", F.aggregate(mine, F.lit(0).cast("long"), lambda a, p: a + p["words"])).where("taken > 0")
    part = F.flatten(F.transform(mine, lambda p: F.slice(F.col("own_words"), (p["first"] + 1).cast("int"), p["words"].cast("int"))))
    df = df.withColumn("made", F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(F.array_join(part, " ")))
    new = {"text": F.col("made")} | ({"n_chars": F.length("made").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return of_row(df, docs.columns, new)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = measured(table(spark, sf_dir, "documents"))
    sources = targets(sizes)
    taken = packed(sizes, sources).groupBy("rid").agg(F.sum("words").alias("taken"))
    of = sources.select(F.col("source").alias("_source"), "source_size", "target")
    df = sizes.join(F.broadcast(of) if of.count() <= 50_000 else of, sizes.source.eqNullSafe(F.col("_source"))).join(taken, "rid", "left")
    return df.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
