"""Operators by the names that a configuration gives them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import graph, groups, joins, rows
from tidewell.params import AggSpec, FilterSpec

#: Name to builder: ``builder(**params)`` gives a function from DataFrame to DataFrame.
WORKERS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {
    "SyncFilter": lambda **p: lambda df: rows.keep(df, FilterSpec(**p)),
    "Q5Filter": lambda **p: lambda df: rows.keep(df, FilterSpec(**p)),
    "Cleaner": lambda names: lambda df: rows.without(df, names),
    "DateRangeFilter": lambda lo, hi: lambda df: rows.dated(df, lo, hi),
    "Join": lambda accounts: lambda df: joins.with_bank_name(df, accounts),
    "Aggregator": lambda **p: lambda df: groups.aggregate(df, AggSpec(**p)),
    "Converter": lambda rates, fallbacks=None: lambda df: joins.in_usd(df, rates, fallbacks),
    "AvgFormatFilter": lambda averages, multiplier: lambda df: joins.below_average(df, averages, multiplier),
    "Router": lambda columns, n=None: lambda df: df.repartition(*([n] if n else []), *columns),
    "Spliter": lambda: graph.edges,
    "ScatterAndGather": lambda threshold: lambda edge: graph.pairs(edge, threshold),
    "ScatterGather": lambda: lambda part: part.groupBy(*graph.EDGE).agg(F.sum("n").alias("n")),
    "ScatterGatherFilter": lambda threshold: lambda pair: pair.where(F.col("n") >= threshold),
    "JoinQuery4": lambda: lambda pair: rows.ends(pair).distinct(),
}


def worker(name: str, **params) -> Callable[[DataFrame], DataFrame]:
    if name not in WORKERS:
        raise ValueError(f"no worker {name}")
    return WORKERS[name](**params)
