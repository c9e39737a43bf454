"""The five analyses, compositions of the operators. Each keeps tenants apart by ``params.tenant_cols``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import graph, groups, joins, rows
from tidewell.params import AggSpec, FilterSpec, QueryParams
from tidewell.sources.staging import Staged


def q1(tx: DataFrame, p: QueryParams) -> DataFrame:
    """Transfers in dollars below the small amount."""
    small = rows.keep(rows.by_currency(tx, p.usd)[0], FilterSpec("amount", "<", p.small_amount))
    return small.select(*p.tenant_cols, *graph.EDGE, F.col("amount_paid").alias("total_amount"))


def q2(tx: DataFrame, accounts: DataFrame, p: QueryParams) -> DataFrame:
    """The largest transfer in dollars of each source bank, with the bank's name."""
    largest = groups.aggregate(rows.by_currency(tx, p.usd)[0], AggSpec("max", "origin_bank"), p.tenant_cols)
    return joins.with_bank_name(largest, accounts).select(*p.tenant_cols, "from_bank", "from_account", "bank_name", "amount_paid")


def q3(tx: DataFrame, p: QueryParams) -> DataFrame:
    """Transfers in dollars in window 2 far below their format's average of window 1."""
    usd = rows.by_currency(tx, p.usd)[0]
    averages = groups.aggregate(rows.dated(usd, *p.window1), AggSpec("avg", "format"), p.tenant_cols)
    low = joins.below_average(rows.dated(usd, *p.window2).where("payment_format <> ''"), averages, p.multiplier, p.tenant_cols)
    return low.select(*p.tenant_cols, "from_bank", "from_account", "payment_format", "amount_paid")


def q4(tx: DataFrame, p: QueryParams, pruned: bool = True) -> DataFrame:
    """Accounts at the ends of scatter-gather patterns in window 1."""
    found = graph.pairs(q4_edges(tx, p), p.threshold, pruned, p.exclude_cycles, p.tenant_cols)
    return rows.ends(found, p.tenant_cols).distinct()


def q4_edges(tx: DataFrame, p: QueryParams) -> DataFrame:
    return graph.edges(rows.dated(rows.by_currency(tx, p.usd)[0], *p.window1), p.tenant_cols)


def q5(tx: DataFrame, rates: DataFrame, p: QueryParams, fallbacks: DataFrame | None = None) -> DataFrame:
    """How many transfers of some formats in window 1 are worth less than the micro amount."""
    chosen = rows.keep(rows.dated(tx, *p.window1), FilterSpec("format", "==", p.formats))
    small = rows.keep(joins.in_usd(chosen, rates, fallbacks, p.usd), FilterSpec("amount", "<", p.micro_amount))
    return groups.aggregate(small, AggSpec("count"), p.tenant_cols)


def run_all(tx: DataFrame, accounts: DataFrame, rates: DataFrame, p: QueryParams) -> dict[str, DataFrame]:
    """All five over one set of transactions."""
    return {"q1": q1(tx, p), "q2": q2(tx, accounts, p), "q3": q3(tx, p), "q4": q4(tx, p), "q5": q5(tx, rates, p)}


def run_staged(staged: Staged, accounts: DataFrame, rates: DataFrame, p: QueryParams, fallbacks: DataFrame | None = None) -> dict[str, DataFrame]:
    """All five over transactions that were laid out; each reads the route and the days that it needs."""
    usd = staged.rows("usd")
    return {
        "q1": q1(usd, p), "q2": q2(usd, accounts, p), "q3": q3(staged.rows("usd", p.window1, p.window2), p),
        "q4": q4(staged.rows("usd", p.window1), p), "q5": q5(staged.rows(None, p.window1), rates, p, fallbacks),
    }
