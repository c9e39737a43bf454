"""Joins with small tables. Spark broadcasts these where their size allows, and shuffles otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import written_date


def bank_names(accounts: DataFrame) -> DataFrame:
    """One name for each bank id: the least."""
    return accounts.groupBy("bank_id").agg(F.min("bank_name").alias("bank_name"))


def with_bank_name(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """``df`` with the name of ``from_bank``; rows of banks without a name go."""
    names = bank_names(accounts)
    return df.join(names, df.from_bank == names.bank_id).drop("bank_id")


def below_average(df: DataFrame, averages: DataFrame, multiplier: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose amount is below their format's average times ``multiplier``; formats without one go."""
    own = averages.select(*extra, "payment_format", F.col("amount_paid").alias("average"))
    return df.join(own, [*extra, "payment_format"]).where(F.col("amount_paid") < F.col("average") * multiplier).drop("average")


def in_usd(df: DataFrame, rates: DataFrame, fallbacks: DataFrame | None = None, usd: str = "US Dollar") -> DataFrame:
    """``df`` with amounts in US dollars and the currency rewritten; rows without a rate go.

    ``rates`` has ``currency, per_usd`` and, if rates differ by day, ``rate_date``; the amount
    is divided by the rate. ``fallbacks`` has ``currency, usd_per_unit``, which multiplies.
    """
    daily = "rate_date" in rates.columns
    left = df.withColumn("_day", written_date(F.col("timestamp"))) if daily else df
    on = left.payment_currency == rates.currency
    met = left.join(rates, on & (left._day == rates.rate_date) if daily else on, "left").drop("currency", "rate_date")
    amount = F.col("amount_paid") / F.nullif(F.col("per_usd"), F.lit(0.0))
    if fallbacks is not None:
        met = met.join(fallbacks.withColumnRenamed("currency", "_c"), F.col("payment_currency") == F.col("_c"), "left")
        dated = F.col("_day").isNotNull() if daily else F.lit(True)
        amount = F.coalesce(amount, F.when(dated, F.col("amount_paid") * F.col("usd_per_unit")))
    amount = F.when(F.col("payment_currency") == usd, F.col("amount_paid")).otherwise(amount)
    out = met.withColumn("amount_paid", amount).where("amount_paid is not null")
    return out.select(*[F.lit(usd).alias(c) if c == "payment_currency" else F.col(c) for c in df.columns])
