"""Aggregations of amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.params import AggSpec

#: Amounts are added as decimals, so that the order of rows does not matter.
MONEY = "decimal(18,2)"


def aggregate(df: DataFrame, spec: AggSpec, extra: tuple[str, ...] = ()) -> DataFrame:
    """The keys and ``amount_paid``; for max and min also the account of the winning row (ties: the least)."""
    keys = [*extra, *spec.keys]
    money = F.col("amount_paid").cast(MONEY)
    if spec.kind == "count":
        return df.groupBy(*keys).agg(F.count("*").alias("count"))
    if spec.kind in ("sum", "avg"):
        made = F.sum(money) if spec.kind == "sum" else F.avg(money)
        return df.groupBy(*keys).agg(made.cast("double").alias("amount_paid"))
    rows = df.where("amount_paid is not null")
    rank = -F.col("amount_paid") if spec.kind == "max" else F.col("amount_paid")
    own = [c for c in ("from_account",) if c not in keys]
    best = F.min(F.struct(rank.alias("rank"), *own)).alias("best")
    sign = -1 if spec.kind == "max" else 1
    return rows.groupBy(*keys).agg(best).select(*keys, *[f"best.{c}" for c in own], (F.col("best.rank") * sign).alias("amount_paid"))


def totals(df: DataFrame, usd: str = "US Dollar") -> DataFrame:
    """One row: how many transactions there are, in the currency and in others."""
    own = F.count_if(F.col("payment_currency").eqNullSafe(usd))
    return df.agg(F.count("*").alias("n"), own.alias("n_usd"), (F.count("*") - own).alias("n_other"))
