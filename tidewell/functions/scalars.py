"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted layouts of a transaction's time, fixed values.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd")


def canonical_bank(c: Column) -> Column:
    """A bank id without leading zeros; one zero stays."""
    return F.regexp_replace(c, "^0+(?!$)", "")


def written_date(c: Column) -> Column:
    """The date that a time says in its own zone, in any accepted layout; null if in none."""
    stamps = [F.try_to_timestamp(F.substring(c, 1, 19), F.lit(LAYOUTS[1])), *[F.try_to_timestamp(c, F.lit(x)) for x in LAYOUTS[2:]]]
    zoned = F.when(F.try_to_timestamp(c, F.lit(LAYOUTS[0])).isNotNull(), stamps[0])
    bare = F.when(F.length(c) == 19, stamps[0])
    return F.coalesce(zoned, bare, *stamps[1:]).cast("date")


def account_id(bank: Column, account: Column) -> Column:
    """Bank and account as one string, the bank first."""
    return F.concat_ws("-", bank, account)


def split_account_id(c: Column) -> tuple[Column, Column]:
    """Bank and account of such a string; an account may hold dashes."""
    parts = F.split(c, "-", 2)
    return F.get(parts, 0), F.get(parts, 1)


def in_range(c: Column, lo: str, hi: str) -> Column:
    """Whether a time lies between two others as strings, both ends included; an empty one does not."""
    return (c != "") & c.between(lo, hi)


def day(c: Column) -> Column:
    """What stands before the first space."""
    return F.substring_index(c, " ", 1)


def plain_number(c: Column) -> Column:
    """A double in its shortest exact digits, without an exponent or closing zeros; no number as its name."""
    text = c.cast("string")
    exponent = F.regexp_extract(text, "E(-?[0-9]+)$", 1)
    power = F.when(exponent != "", exponent.cast("int"))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), "^-", "")
    digits = F.concat(F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", ""))
    whole = F.rpad(digits, F.greatest(F.length(digits), power + 1), F.lit("0"))
    large = F.concat(F.left(whole, power + 1), F.when(F.length(whole) > power + 1, F.concat(F.lit("."), F.right(whole, F.length(whole) - power - 1))).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return F.when(power.isNull(), F.regexp_replace(text, r"\.0$", "")).when(power >= 0, F.concat(sign, large)).otherwise(F.concat(sign, small))
