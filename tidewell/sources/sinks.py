"""CSV results and the comparison of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import plain_number
from tidewell.sources import files
from tidewell.sources.counts import Tally


def formatted(df: DataFrame) -> DataFrame:
    """``df`` as strings: doubles in plain digits."""
    return df.select([(plain_number(F.col(c)) if kind in ("double", "float") else F.col(c).cast("string")).alias(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Write ``df`` with a header; ``single`` only for results known to be small."""
    out = formatted(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """Each result as CSV in a folder of its own: ``query1.csv`` for q1 and so on."""
    for name, df in results.items():
        write_csv(df, f"{folder.rstrip('/')}/query{name.removeprefix('q')}.csv")


def write_together(results: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """All results or none: they are written beside ``folder``, which they replace once all are whole. Their numbers of rows."""
    spark, folder, tally = next(iter(results.values())).sparkSession, folder.rstrip("/"), Tally()
    new, old = (f"{folder}.{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
    try:
        write_results({name: tally.at(df, name) for name, df in results.items()}, new)
    except Exception:
        files.remove(spark, new)
        raise
    if files.exists(spark, folder):
        files.move(spark, folder, old)
    files.move(spark, new, folder)
    files.remove(spark, old)
    return {name: tally.get(name)["n"] for name in results}


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of two bags has more often than the other: their columns and ``side``."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))
