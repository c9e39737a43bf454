"""One pass over the transactions' CSV files: typed rows laid out by route and day, bad rows aside, and counts.

All five analyses read what is staged, and of it only the routes and days that they need. A row that cannot be
read or lacks a key goes to the route ``bad`` of the same write, with its record, file and reason. Rows that come
in are held against rows that are written, by counts taken on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalars import canonical_bank
from tidewell.sources.counts import Tally, reconcile
from tidewell.sources.tables import TRANSACTIONS

#: Why a row is set aside, in the order in which it is judged: number of columns, an amount, the flag, an empty bank or account.
REASONS = ("columns", "amount", "flag", "key")
KEYS = ("from_bank", "from_account", "to_bank", "to_account")
TYPED = T.StructType([T.StructField(f.name, T.BooleanType() if f.name == "is_laundering" else f.dataType) for f in TRANSACTIONS])
LAID_OUT = T.StructType([*TYPED.fields, *[T.StructField(c, T.StringType()) for c in ("reason", "record", "file", "route", "day")]])


def classified(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the files, typed, with ``reason`` (null: good), ``record`` and ``file`` (of bad ones)."""
    names = [f.name for f in TRANSACTIONS]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_record", T.StringType())])
    reader = spark.read.schema(schema).options(header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_record", escape='"', emptyValue="", nullValue="\u0000")
    raw = reader.csv(path).select("*", F.col("_metadata.file_path").alias("_file"))
    flag = F.lower("is_laundering")
    typed = {
        **{c: F.expr(f"try_cast({c} AS double)") for c in ("amount_received", "amount_paid")},
        **{c: canonical_bank(F.col(c)) for c in ("from_bank", "to_bank")},
        "is_laundering": F.when(flag.isin("1", "t", "true"), True).when(flag.isin("0", "f", "false"), False),
    }
    bad = {
        "columns": F.col("_record").isNotNull(),
        "amount": typed["amount_received"].isNull() | typed["amount_paid"].isNull(),
        "flag": typed["is_laundering"].isNull(),
        "key": F.greatest(*[(F.coalesce(F.col(c), F.lit("")) == "").cast("int") for c in KEYS]) == 1,
    }
    reason = F.coalesce(*[F.when(bad[r], F.lit(r)) for r in REASONS])
    record = F.coalesce("_record", F.to_csv(F.struct(*names)))
    marked = raw.withColumns({"reason": reason, "record": F.when(reason.isNotNull(), record), "file": F.when(reason.isNotNull(), F.col("_file"))})
    return marked.select(*[typed.get(n, F.col(n)).alias(n) for n in names], "reason", "record", "file")


def routed(rows: DataFrame, usd: str) -> DataFrame:
    route = F.when(F.col("reason").isNotNull(), "bad").when(F.col("payment_currency") == usd, "usd").otherwise("other")
    day = F.when(F.col("reason").isNull() & (F.col("timestamp") != ""), F.left("timestamp", F.lit(10)))
    return rows.withColumns({"route": route, "day": F.coalesce(day, F.lit("-"))})


@dataclass(frozen=True)
class Staged:
    """Transactions that were laid out in ``folder``, and how many rows came, stayed and were set aside."""

    spark: SparkSession
    folder: str
    counts: dict[str, int]

    def rows(self, route: str | None = None, *windows: tuple[str, str]) -> DataFrame:
        """Good rows: of one route, or of all; of the days that windows touch, or of all. Only these folders are read."""
        df = self.spark.read.schema(LAID_OUT).parquet(self.folder).where(F.col("route") != "bad" if route is None else F.col("route") == route)
        if windows:
            touched = F.lit(False)
            for lo, hi in windows:  # what lies between two strings begins with what lies between their beginnings
                touched = touched | F.col("day").between(lo[:10], hi[:10])
            df = df.where(touched)
        return df.select(*TYPED.names)

    def set_aside(self) -> DataFrame:
        """``(file, reason, record)`` of the bad rows."""
        return self.spark.read.schema(LAID_OUT).parquet(self.folder).where("route = 'bad'").select("file", "reason", "record")


def stage(spark: SparkSession, path: str, folder: str, usd: str = "US Dollar") -> Staged:
    """Lay out the files' rows in ``folder``; it is whole when this returns."""
    tally = Tally()
    came = tally.at(classified(spark, path), "read", **{r: F.col("reason") == r for r in REASONS})
    out = tally.at(routed(came, usd).hint("rebalance", "route", "day"), "written", good=F.col("route") != "bad", bad=F.col("route") == "bad")
    out.write.mode("overwrite").partitionBy("route", "day").parquet(folder)
    read, written = tally.get("read"), tally.get("written")
    counts = {"read": read["n"], "good": written["good"], **{r: read[r] for r in REASONS}}
    reconcile("staging", read["n"], {k: v for k, v in counts.items() if k != "read"})
    return Staged(spark, folder, counts)
