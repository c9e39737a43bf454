"""The fourth analysis kept up to date over a stream: no batch joins all edges with all edges.

A transaction adds ``weight`` (1; -1 takes one back) to its edge, which is there while its sum is above
0. A pair of accounts with ``threshold`` bridges has a source with as many partners and a sink with as many, so only
edges out of such sources (first hops) and into such sinks (second hops) are joined. An account that reaches the threshold brings
all of its edges in; one that falls below takes them out. Changes of edges, hops and counts of pairs are rows with a sign, and
the join is linear in them:

    change of pairs = change of first hops x second hops after + first hops before x change of second hops

so each batch joins what it changed with what is there, and adds up signs. Where a batch is small, Spark broadcasts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import graph, rows
from tidewell.params import QueryParams
from tidewell.streaming.logs import Logs, drive

#: Batches after which the logs are added up.
FOLD_EVERY = 16


def _schemas(p: QueryParams) -> dict[str, tuple[str, str]]:
    keys = ", ".join(f"{c} string" for c in (*p.tenant_cols, *graph.EDGE))
    return {name: (f"{keys}, {value} long", value) for name, value in (("weights", "m"), ("edges", "sign"), ("first", "sign"), ("second", "sign"), ("pairs", "n"))}


def _hops(logs: Logs, new: DataFrame, side: str, no: int, p: QueryParams) -> DataFrame:
    """The edges that enter or leave the hops of one side: those of accounts that the batch touched."""
    keys, account = [*p.tenant_cols, *graph.EDGE], [*p.tenant_cols, f"{side}_bank", f"{side}_account"]
    touched = new.select(*account).distinct()
    old = logs.read("edges", _schemas(p)["edges"][0], before=no).join(touched, account, "left_semi")
    both = old.select(*keys, F.col("sign").alias("old"), F.lit(0).cast("long").alias("more")).union(new.select(*keys, F.lit(0).cast("long"), "sign"))
    each = both.groupBy(*keys).agg(F.sum("old").alias("old"), F.sum("more").alias("more"))
    degrees = each.groupBy(*account).agg(F.sum("old").alias("was"), F.sum(F.col("old") + F.col("more")).alias("now"))
    counts = lambda degree, n: F.when(F.col(degree) >= p.threshold, n).otherwise(0)
    sign = counts("now", F.col("old") + F.col("more")) - counts("was", F.col("old"))
    return each.join(degrees, account).select(*keys, sign.cast("long").alias("sign")).where("sign <> 0")


def _met(first: DataFrame, second: DataFrame, p: QueryParams) -> DataFrame:
    own = lambda df, far, via: df.select(*p.tenant_cols, *[f"{far}_{c}" for c in ("bank", "account")], *[F.col(f"{via}_{c}").alias(f"via_{c}") for c in ("bank", "account")], F.col("sign").alias(f"{far}_sign"))
    both = own(first, "from", "to").join(own(second, "to", "from"), [*p.tenant_cols, "via_bank", "via_account"])
    return both.select(*p.tenant_cols, *graph.EDGE, (F.col("from_sign") * F.col("to_sign")).alias("n"))


def step(batch: DataFrame, no: int, logs: Logs, p: QueryParams, weight: str | None = None) -> None:
    """Take in one batch of transactions."""
    keys, kinds = [*p.tenant_cols, *graph.EDGE], _schemas(p)
    chosen = rows.dated(rows.by_currency(batch, p.usd)[0], *p.window1)
    times = F.sum(F.lit(1) if weight is None else F.col(weight)).cast("long")
    changed = logs.put("weights", chosen.groupBy(*keys).agg(times.alias("m")).where("m <> 0"), no)
    before = logs.read("weights", kinds["weights"][0], before=no).join(changed.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sum("m").alias("was"))
    was, now = F.coalesce("was", F.lit(0)), F.coalesce("was", F.lit(0)) + F.col("m")
    sign = (now > 0).cast("long") - (was > 0).cast("long")
    new = logs.put("edges", changed.join(before, keys, "left").select(*keys, sign.alias("sign")).where("sign <> 0"), no)
    first, second = (logs.put(name, _hops(logs, new, side, no, p), no) for name, side in (("first", "from"), ("second", "to")))
    first_before, second_before = (logs.read(name, kinds[name][0], before=no) for name in ("first", "second"))
    delta = _met(first, second_before.union(second), p).union(_met(first_before, second, p))
    logs.put("pairs", delta.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0"), no)
    logs.commit(no)
    if no % FOLD_EVERY == FOLD_EVERY - 1:
        for name, (schema, value) in kinds.items():
            logs.fold(name, schema, value)


def follow(stream: DataFrame, folder: str, checkpoint: str, p: QueryParams, weight: str | None = None) -> None:
    """Take in all that is there, batch by batch."""
    drive(stream, folder, checkpoint, lambda batch, no, logs: step(batch, no, logs, p, weight))


def pairs(spark: SparkSession, folder: str, p: QueryParams) -> DataFrame:
    """Pairs of accounts joined by the threshold of bridges or more, as of the last whole batch, with their number ``n``."""
    keys = [*p.tenant_cols, *graph.EDGE]
    found = Logs(spark, folder).read("pairs", _schemas(p)["pairs"][0]).groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= p.threshold)
    return found.where("from_bank <> to_bank or from_account <> to_account") if p.exclude_cycles else found


def accounts(spark: SparkSession, folder: str, p: QueryParams) -> DataFrame:
    """The fourth analysis as of the last whole batch."""
    return rows.ends(pairs(spark, folder, p), p.tenant_cols).distinct()
