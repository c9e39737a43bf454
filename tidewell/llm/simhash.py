"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint is 64 bits over the document's word shingles. Two fingerprints link
at ``RADIUS`` (2) or fewer differing bits. The 64 bits are cut into two segments of
32: of two linked fingerprints either the high segments differ in at most one bit or
the low segments are equal. So every fingerprint enumerates the Hamming ball of
radius 1 around its high segment (33 values) and of radius 0 around its low one,
fetches what the table of that segment holds there, and the complete distance is
verified.

Segment values that more than ``BUCKET`` distinct fingerprints share would make the
verification quadratic. The fingerprints that meet such a value instead enumerate the
ball of radius 1 over all 64 bits: two fingerprints are within 2 bits exactly if these
balls meet, each ball has 65 points, and a point lies in at most 65 balls, so nothing
is lost and no group grows.

Defined cases: a null or wordless text has fingerprint zero and links like any other;
fewer words than a shingle make one shingle; repeated rows get the same group; a group
whose ids are all null has a null ``component_id``; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import least_labels, of_row, settle, table, whole_row

SHINGLE = 3
SEED = 42
RADIUS = 2
BUCKET = 32
#: Rows of byte lanes that can be added before a lane may overflow.
_LANE_ROWS = 255


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of the lower-cased text, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return []
    if len(tokens) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), (ends[size - 1 :] - 1).tolist())]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document (``sizes`` hashes each) the bits set in over half of its hashes."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full].astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    pieces = -(-n // _LANE_ROWS)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    cut = np.repeat(begin, pieces) + _LANE_ROWS * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    lane = np.uint64(0x0101010101010101)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & lane, cut)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


@F.pandas_udf(T.LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint of each text, as the signed long of the same 64 bits."""
    for batch in texts:
        found = []
        for k in range(0, len(batch), 500):
            each = [shingle_hashes(t) for t in batch.iloc[k : k + 500]]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter((h for hs in each for h in hs), np.uint64, int(sizes.sum()))
            found.append(majority_bits(flat, sizes))
        yield pd.Series(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))


def _ball(value, bits: int, kind: str):
    """``value`` and all values that differ from it in one of its ``bits`` lowest bits."""
    return F.transform(
        F.sequence(F.lit(-1), F.lit(bits - 1)),
        lambda i: F.when(i < 0, value).otherwise(value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast(kind), F.greatest(i, F.lit(0))))),
    )


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)`` links that connect all distinct ``fp`` within ``RADIUS`` bits.

    Connected means linked or joined by a path of links; every returned pair is
    within ``RADIUS`` bits.
    """
    prints = prints.select(
        "fp", F.shiftright("fp", 32).cast("int").alias("high"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low")
    )

    def fetch(segment: str, probes: DataFrame) -> DataFrame:
        """Pairs of a probe and each entry of a light bucket, or null for a heavy one."""
        light = prints.groupBy(segment).agg(F.count("*").alias("n"), F.min("fp").alias("only"))
        several = light.where("n > 1").select(segment, "n")
        entries = (
            light.where("n = 1").select(segment, F.col("only").alias("b"))
            .union(prints.join(several.where(F.col("n") <= bucket), segment).select(segment, F.col("fp").alias("b")))
            .union(several.where(F.col("n") > bucket).select(segment, F.lit(None).cast("long").alias("b")))
        )
        met = probes.join(entries, segment).select("a", "b")
        return met.where("b is null or (a <> b and bit_count(a ^ b) <= 2)")

    high = fetch("high", prints.select(F.col("fp").alias("a"), F.explode(_ball(F.col("high"), 32, "int")).alias("high")))
    low = fetch("low", prints.select(F.col("fp").alias("a"), "low"))
    met = settle(high.union(low))
    crowded = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    points = crowded.select("fp", F.explode(_ball(F.col("fp"), 64, "bigint")).alias("point"))
    shared = points.groupBy("point").agg(F.collect_set("fp").alias("near")).where("size(near) > 1")
    hubs = shared.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return met.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(hubs).distinct()


def group_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(<id_col>, text_key, fp, label, component_id)``, one per row of ``docs``.

    ``label`` is the least fingerprint of the group, ``component_id`` its least id.
    """
    own = settle(
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_key"), fingerprint(F.col(text_col)).alias("fp"))
    )
    prints = settle(own.groupBy("fp").agg(F.min("_id").alias("least")))
    groups = least_labels(links(prints))
    labelled = settle(prints.join(groups, prints.fp == groups.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    heads = settle(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    of = settle(labelled.join(heads, "label").select("fp", "label", "component_id"))
    return own.join(of, "fp").select(F.col("_id").alias(id_col), "text_key", "fp", "label", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one with the least ``doc_id``."""
    grouped = group_near_copies(docs)
    heads = grouped.where("doc_id <=> component_id").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("label").alias("_label"))
    heads = settle(heads.dropDuplicates(["_label"]))
    own = docs.select(whole_row(docs), F.xxhash64("text").alias("own"))
    kept = own.join(heads, F.col("row.doc_id").eqNullSafe(heads["_id"]) & (own.own == heads["_key"]))
    return of_row(kept.dropDuplicates(["_label"]), docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
