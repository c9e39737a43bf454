"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space as the word counts of this package see it.
SPACE = r"[\x20\x09-\x0D]"

#: Most rows of numbers and names that are broadcast.
SMALL_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a new local folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def new_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, in files that outlive executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def join_small(df: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``few`` (settled), which is broadcast if it is counted to be small.

    So a hot key's rows stay where they are. A larger ``few`` is joined by key, and adaptive
    execution splits the hot ones.
    """
    return df.join(F.broadcast(few) if few.count() <= SMALL_ROWS else few, on, how)


def row_key(df: DataFrame) -> F.Column:
    """A hash of a row's columns, all of them."""
    plain = lambda c, kind: F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(f"`{c}`")
    return F.xxhash64(*[plain(c, kind) for c, kind in df.dtypes])


def whole_row(df: DataFrame) -> F.Column:
    """All columns of a row as one, ``row``, so that no name of theirs meets a name of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def of_row(df: DataFrame, columns: list[str], new: dict | None = None) -> DataFrame:
    """The columns back from ``row``; those in ``new`` replaced."""
    return df.select(*[(new or {}).get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def words(text) -> F.Column:
    """The words of a text column (null: none), natively."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before, in order of bucket and then ``order``.

    Two levels, so that no task holds more of a hot key than one bucket's rows, or one
    row for each of its buckets.
    """
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_before"))
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(sums, [*keys, bucket])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )


def least_labels(links: DataFrame) -> DataFrame:
    """Connected components of ``links (a, b)``: rows ``(node, label)``, label the least node.

    Rounds of "take the least label among the neighbours, then the label of that
    label" until nothing changes. Only nodes that occur in a link are returned.
    The links must have a bounded degree; rows never gather by component.
    """
    links = settle(links.where("a <> b"))
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = settle(
            labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        of = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = settle(
            step.join(of, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        )
        if after.where("label <> old").limit(1).count() == 0:
            return after.select("node", "label")
        labels = after.select("node", "label")
