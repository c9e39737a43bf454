"""Filters and projections; functions from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import in_range
from tidewell.params import FilterSpec

#: What a configuration may call columns, besides their own names: roles, and single parts of them.
NAMES = {
    "origin": ("from_bank", "from_account"), "dest": ("to_bank", "to_account"), "paid": ("amount_paid", "payment_currency"),
    "format": ("payment_format",), "timestamp": ("timestamp",), "BankID": ("from_bank",), "ID": ("from_account",),
    "origin.BankID": ("from_bank",), "origin.ID": ("from_account",), "dest.BankID": ("to_bank",), "dest.ID": ("to_account",),
}


def predicate(spec: FilterSpec) -> Column:
    if spec.kind == "amount":
        amount = F.col("amount_paid")
        return {"<": amount < spec.value, ">": amount > spec.value, "==": amount == spec.value}[spec.operator]
    within = F.col("payment_format").isin(list(spec.value))
    return (F.col("payment_format") != "") & (within if spec.operator == "==" else ~within)


def keep(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.where(predicate(spec))


def dated(df: DataFrame, lo: str, hi: str) -> DataFrame:
    return df.where(in_range(F.col("timestamp"), lo, hi))


def by_currency(df: DataFrame, usd: str = "US Dollar") -> tuple[DataFrame, DataFrame]:
    """Rows in the currency, and all others (null among these)."""
    own = F.col("payment_currency").eqNullSafe(usd)
    return df.where(own), df.where(~own)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the named columns; a role's name stands for all of its columns."""
    found = [c for n in names for c in NAMES.get(n, (n,))]
    if unknown := [c for c in found if c not in df.columns]:
        raise ValueError(f"no columns {unknown}")
    return df.drop(*found)


def blanked(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with empty strings in the named columns."""
    found = [c for n in names for c in NAMES.get(n, (n,))]
    return df.withColumns({c: F.lit("") for c in found if dict(df.dtypes)[c] == "string"})


def ends(pairs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Both accounts of each pair as rows ``(bank_id, account_id)``, after ``extra`` columns."""
    sides = F.array(*[F.struct(F.col(f"{p}_bank").alias("bank_id"), F.col(f"{p}_account").alias("account_id")) for p in ("from", "to")])
    return pairs.select(*extra, F.inline(sides))


def checked(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``; a row in which a named column is empty or null fails the query."""
    for c in names:
        df = df.where(F.when((F.col(c) != "") & F.col(c).isNotNull(), True).otherwise(F.raise_error(F.lit(f"empty {c}")).cast("boolean")))
    return df
