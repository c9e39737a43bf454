"""Clients' transactions and markers in one stream, and the third analysis as soon as it can be known.

Messages have ``client_id``, ``msg_id``, ``kind``, ``expected`` and the columns of transactions. ``kind`` is ``tx``, or a
marker: ``window1`` (the client sends no more of window 1; ``expected`` such rows were sent), ``end`` (no more at all;
``expected`` rows were sent) or ``abort``. A marker counts once as many rows have arrived as it says, so batches may come in any
order. Rows of window 2 wait in a backlog until their client's averages are known, then they are judged where they arrive. An
end closes the client and drops what it held; an abort also drops its results. What a closed client sends later is dropped.

State lies in logs keyed by client and format, joined with each batch, and not in one task for each client, so that a client with
a third of all rows is spread like any other. Messages must be told apart before (``runs.deduplicated``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.ids import derived_id
from tidewell.functions.scalars import in_range
from tidewell.operators import joins, rows
from tidewell.operators.groups import MONEY
from tidewell.params import QueryParams
from tidewell.streaming.logs import Logs, drive

MARKS = "client_id string, kind string, expected long"
COUNTS = "client_id string, n long, n_window1 long"
SUMS = "client_id string, payment_format string, total decimal(28,2), n long"
ROWS = "client_id string, msg_id string, from_bank string, from_account string, payment_format string, amount_paid double"
CLOSED = "client_id string, aborted boolean"


def _status(logs: Logs, no: int) -> DataFrame:
    """Of the clients with markers before batch ``no``: whether they are ``aborted``, ``ready`` (averages known), ``over``."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("expected")))
    marks = logs.read("marks", MARKS, no).groupBy("client_id").agg(of("window1").alias("e1"), of("end").alias("e"), F.bool_or(F.col("kind") == "abort").alias("aborted"))
    counts = logs.read("counts", COUNTS, no).groupBy("client_id").agg(F.sum("n").alias("n"), F.sum("n_window1").alias("n1"))
    df = marks.join(counts, "client_id", "left")
    whole = lambda e, n: F.coalesce(F.coalesce(F.col(n), F.lit(0)) >= F.col(e), F.lit(False))
    ended = whole("e", "n")
    return df.select("client_id", "aborted", (~F.col("aborted") & (whole("e1", "n1") | ended)).alias("ready"), (F.col("aborted") | ended).alias("over"))


def step(batch: DataFrame, no: int, logs: Logs, p: QueryParams) -> None:
    """Take in one batch of messages."""
    closed = logs.read("closed", CLOSED, no)
    batch = batch.join(closed.select("client_id"), "client_id", "left_anti")
    tx = batch.where("kind = 'tx'")
    usd = rows.by_currency(tx, p.usd)[0]
    logs.put("marks", batch.where("kind <> 'tx'").select("client_id", "kind", F.col("expected").cast("long").alias("expected")), no)
    logs.put("counts", tx.groupBy("client_id").agg(F.count("*").alias("n"), F.count_if(in_range(F.col("timestamp"), *p.window1)).alias("n_window1")), no)
    money = F.col("amount_paid").cast(MONEY)
    sums = rows.dated(usd, *p.window1).groupBy("client_id", "payment_format").agg(F.sum(money).alias("total"), F.count(money).alias("n"))
    logs.put("sums", sums, no)
    was = logs.read("ready", "client_id string", no)
    now = _status(logs, no + 1).join(closed.select("client_id"), "client_id", "left_anti")
    logs.put("closed", now.where("over").select("client_id", "aborted"), no)
    new = logs.put("ready", now.where("ready").select("client_id").join(was, "client_id", "left_anti"), no)
    ready = was.union(new)

    later = rows.dated(usd, *p.window2).where("payment_format <> ''").select(*[c.split()[0] for c in ROWS.split(", ")])
    gone = ready.union(now.where("aborted").select("client_id")).distinct()
    logs.put("backlog", later.join(gone, "client_id", "left_anti"), no)
    judged = logs.read("backlog", ROWS, no).join(new, "client_id", "left_semi").union(later.join(ready, "client_id", "left_semi"))
    averages = logs.read("sums", SUMS, no + 1).groupBy("client_id", "payment_format").agg((F.sum("total") / F.sum("n")).cast("decimal(22,6)").cast("double").alias("amount_paid"))
    low = joins.below_average(judged, averages, p.multiplier, ("client_id",))
    logs.put("results", low.withColumn("msg_id", derived_id(F.col("msg_id"), "q3")).select(*[c.split()[0] for c in ROWS.split(", ")]), no)
    logs.commit(no)
    if not now.where("over").isEmpty():
        _drop_closed(logs)


def _drop_closed(logs: Logs) -> None:
    """Rewrite the logs without what closed clients held, and without the results of aborted ones."""
    closed = logs.read("closed", CLOSED)
    for name, schema in (("marks", MARKS), ("counts", COUNTS), ("sums", SUMS), ("backlog", ROWS), ("ready", "client_id string")):
        left = logs.read(name, schema).join(closed, "client_id", "left_anti")
        if name == "backlog":  # also what was judged when its client's averages came
            left = left.join(logs.read("ready", "client_id string"), "client_id", "left_anti")
        logs.rebase(name, left.select(*[c.split()[0] for c in schema.split(", ")]))
    if not closed.where("aborted").isEmpty():
        logs.rebase("results", results(logs.spark, logs.folder))


def follow(messages: DataFrame, folder: str, checkpoint: str, p: QueryParams) -> None:
    """Take in all that is there, batch by batch."""
    drive(messages, folder, checkpoint, lambda batch, no, logs: step(batch, no, logs, p))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The third analysis of each client so far, with ids; aborted clients have none."""
    logs = Logs(spark, folder)
    aborted = logs.read("closed", CLOSED).where("aborted")
    return logs.read("results", ROWS).join(aborted, "client_id", "left_anti")


def held(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each log of open clients holds."""
    logs = Logs(spark, folder)
    sizes = [logs.read(name, schema).agg(F.lit(name).alias("log"), F.count("*").alias("n")) for name, schema in (("marks", MARKS), ("counts", COUNTS), ("sums", SUMS), ("backlog", ROWS), ("ready", "client_id string"))]
    out = sizes[0]
    for df in sizes[1:]:
        out = out.union(df)
    return out
