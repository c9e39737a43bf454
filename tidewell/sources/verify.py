"""Whether written results are those expected: ``python -m tidewell.sources.verify --expected FOLDER --actual FOLDER``.

Rows are compared as bags, whatever their order, as text, with doubles rounded. Each side is added up by bucket of a hash of
the row: a number of rows and two sums of hashes. Only the rows of buckets that differ are compared one by one.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources import files
from tidewell.sources.sinks import differences

BUCKETS = 4096
DECIMALS = 6


def as_text(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Every column as text; doubles rounded."""
    shown = lambda c, kind: F.round(F.col(f"`{c}`"), decimals) if kind in ("double", "float") else F.col(f"`{c}`")
    return df.select(*[shown(c, kind).cast("string").alias(c) for c, kind in df.dtypes])


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    parts = [F.coalesce(F.col(f"`{c}`"), F.lit("\u0000")) for c in df.columns]
    key = F.xxhash64(*parts)
    return df.withColumns({"_bucket": F.pmod(key, F.lit(buckets)), "_key": key, "_other": F.crc32(F.concat_ws("\u0001", *parts).cast("binary"))})


def checksums(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(_bucket, n, a, b)``: order-free sums over the rows of each bucket."""
    each = _bucketed(df, buckets)
    return each.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum(F.col("_key").cast("decimal(20,0)")).alias("a"), F.sum("_other").alias("b"))


def compare(expected: DataFrame, actual: DataFrame, buckets: int = BUCKETS, decimals: int = DECIMALS) -> DataFrame:
    """The rows that one side has more often, with ``side`` ``missing`` (from ``actual``) or ``extra``."""
    if sorted(expected.columns) != sorted(actual.columns):
        raise ValueError(f"columns differ: {expected.columns} expected, {actual.columns} found")
    left, right = as_text(expected, decimals), as_text(actual.select(*expected.columns), decimals)
    sums = lambda df, side: checksums(df, buckets).withColumnsRenamed({c: f"{side}_{c}" for c in ("n", "a", "b")})
    both = sums(left, "l").join(sums(right, "r"), "_bucket", "full")
    same = F.col("l_n").eqNullSafe(F.col("r_n")) & F.col("l_a").eqNullSafe(F.col("r_a")) & F.col("l_b").eqNullSafe(F.col("r_b"))
    odd = F.broadcast(both.where(~same).select("_bucket"))  # one row for each bucket at most
    some = lambda df: _bucketed(df, buckets).join(odd, "_bucket", "left_semi").select(*expected.columns)
    found = differences(some(left), some(right))
    return found.withColumn("side", F.when(F.col("side") == "left", "missing").otherwise("extra"))


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(header=True, escape='"', emptyValue="", nullValue="\u0000").csv(path)


def verify(spark: SparkSession, expected: str, actual: str) -> list[str]:
    """What is wrong with the results in ``actual``, a line for each result; results are folders or files ``*.csv``."""
    names = [n for n in files.listed(spark, expected) if n.endswith(".csv")]
    wrong = [] if names else [f"no results in {expected}"]
    for name in names:
        if not files.exists(spark, f"{actual}/{name}"):
            wrong.append(f"{name}: not there")
            continue
        try:
            found = compare(*(read_result(spark, f"{folder}/{name}") for folder in (expected, actual)))
        except ValueError as e:
            wrong.append(f"{name}: {e}")
            continue
        counts = {r.side: r["count"] for r in found.groupBy("side").count().collect()}
        if counts:
            some = [tuple(r) for r in found.limit(5).collect()]
            wrong.append(f"{name}: {counts.get('missing', 0)} missing, {counts.get('extra', 0)} extra, such as {some}")
    return wrong


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewell.sources.verify", description=__doc__)
    parser.add_argument("--expected", required=True)
    parser.add_argument("--actual", required=True)
    args = parser.parse_args(argv)
    wrong = verify(SparkSession.builder.appName("tidewell").getOrCreate(), args.expected, args.actual)
    print("\n".join(wrong or ["all results agree"]))
    return int(bool(wrong))


if __name__ == "__main__":
    sys.exit(main())
