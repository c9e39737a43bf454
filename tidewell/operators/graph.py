"""The scatter-gather pattern: accounts joined through many bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = ("from_bank", "from_account", "to_bank", "to_account")


def edges(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*extra, *EDGE).distinct()


def heavy(edge: DataFrame, side: str, threshold: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Accounts with ``threshold`` or more different partners on the other side; ``side`` from or to."""
    return edge.groupBy(*extra, f"{side}_bank", f"{side}_account").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def split_bridges(first: DataFrame, second: DataFrame, via: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both hops with ``_salt``: a bridge whose sources times sinks exceed ``most`` is dealt out to as many tasks as that takes, the others to one.

    The sources of such a bridge are dealt out and its sinks sent to each part, so what is sent grows with the sinks alone.
    """
    counts = lambda df, name: df.groupBy(*via).agg(F.count("*").alias(name))
    met = counts(first, "_sources").join(counts(second, "_sinks"), via).where(F.col("_sources") * F.col("_sinks") > most)
    parts = F.least(F.ceil(F.col("_sources") * F.col("_sinks") / most), F.col("_sources")).cast("int")
    hot = met.select(*via, parts.alias("_parts"))
    salted = lambda df: df.join(hot, via, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = salted(first).withColumn("_salt", F.pmod(F.xxhash64("from_bank", "from_account"), F.col("_parts").cast("long")).cast("int"))
    sent = salted(second).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.drop("_parts"), sent.drop("_parts")


def pairs(edge: DataFrame, threshold: int, pruned: bool = True, exclude_cycles: bool = False, extra: tuple[str, ...] = (), salts: int = 1, most_met: int | None = None) -> DataFrame:
    """Pairs of accounts joined by ``threshold`` or more bridges, with their number ``n``.

    A pair with so many bridges has a source with as many partners and a sink with as
    many: pruning by that first loses nothing, and keeps hubs from multiplying. Where single
    bridges have very many sources, ``salts`` deals these out to as many tasks, and sends the bridge's sinks to each;
    ``most_met`` does so for the bridges alone that would give more pairs than this, as counted.
    """
    first, second = edge, edge
    if pruned:
        first = edge.join(heavy(edge, "from", threshold, extra).drop("n"), [*extra, "from_bank", "from_account"], "left_semi")
        second = edge.join(heavy(edge, "to", threshold, extra).drop("n"), [*extra, "to_bank", "to_account"], "left_semi")
    first = first.select(*extra, "from_bank", "from_account", F.col("to_bank").alias("via_bank"), F.col("to_account").alias("via_account"))
    second = second.select(*extra, F.col("from_bank").alias("via_bank"), F.col("from_account").alias("via_account"), "to_bank", "to_account")
    if salts > 1:
        first = first.withColumn("_salt", F.pmod(F.xxhash64("from_bank", "from_account"), F.lit(salts)).cast("int"))
        second = second.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    elif most_met is not None:
        first, second = split_bridges(first, second, [*extra, "via_bank", "via_account"], most_met)
    met = first.join(second, [*extra, "via_bank", "via_account", *(["_salt"] if salts > 1 or most_met is not None else [])])
    if exclude_cycles:
        met = met.where("from_bank <> to_bank or from_account <> to_account")
    return met.groupBy(*extra, *EDGE).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def partners_above(df: DataFrame, k: int) -> DataFrame:
    """Rows of source accounts with more than ``k`` different destination accounts."""
    many = heavy(edges(df), "from", k + 1).drop("n")
    return df.join(many, ["from_bank", "from_account"], "left_semi")


def lay_out(edge: DataFrame, name: str, folder: str, buckets: int = 64) -> None:
    """Save edges twice in ``folder``, as bucketed tables ``<name>_by_source`` and ``<name>_by_sink``, for joins that move nothing."""
    for side, role in (("from", "source"), ("to", "sink")):
        at = [f"{side}_bank", f"{side}_account"]
        laid = edge.repartition(buckets, *at)  # one file for each bucket
        laid.write.bucketBy(buckets, *at).sortBy(*at).mode("overwrite").option("path", f"{folder}/{role}").saveAsTable(f"{name}_by_{role}")


def two_hops(spark: SparkSession, name: str) -> DataFrame:
    """``(from_bank, from_account, via_bank, via_account, to_bank, to_account)`` of edges that ``lay_out`` has saved.

    The first hop is read by its sink and the second by its source: both are bucketed by the bridge, so neither moves.
    """
    first = spark.table(f"{name}_by_sink").select("from_bank", "from_account", F.col("to_bank").alias("via_bank"), F.col("to_account").alias("via_account"))
    second = spark.table(f"{name}_by_source").select(F.col("from_bank").alias("via_bank"), F.col("from_account").alias("via_account"), "to_bank", "to_account")
    return first.hint("merge").join(second, ["via_bank", "via_account"]).select("from_bank", "from_account", "via_bank", "via_account", "to_bank", "to_account")


def laid_out_pairs(spark: SparkSession, name: str, threshold: int) -> DataFrame:
    """``pairs`` over edges that ``lay_out`` has saved: heavy accounts are counted where they lie, the hops meet where they lie."""
    many = lambda role, side: heavy(spark.table(f"{name}_by_{role}"), side, threshold).drop("n")
    met = two_hops(spark, name).join(many("source", "from"), ["from_bank", "from_account"], "left_semi").join(many("sink", "to"), ["to_bank", "to_account"], "left_semi")
    return met.groupBy(*EDGE).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
