"""Results handed over once: a ledger of what each client has been given.

Results have ``client_id`` and ``msg_id`` (see ``functions.ids``). Of each batch, what the ledger knows, what
repeats within the batch and what belongs to no known client is left out; the rest is written with its ledger entries, and
one small manifest file, put in place by a rename, makes both count. What no manifest names does not exist, so
a batch that is cut off, a batch that comes twice, and a second run with a fresh checkpoint add no row.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources import files

IDS = ("client_id", "msg_id")


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    """The parts that count: one for each delivered batch."""
    found = [n for n in files.listed(spark, f"{folder}/manifests") if n.endswith(".txt")]
    return [r.value for r in spark.read.text([f"{folder}/manifests/{n}" for n in found]).collect()] if found else []


def _parts(spark: SparkSession, folder: str, what: str, parts: list[str]) -> DataFrame | None:
    read = [spark.read.parquet(f"{folder}/{what}/{part}") for part in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read) if read else None


def hand_over(batch: DataFrame, clients: DataFrame, folder: str) -> None:
    """Deliver one batch. ``clients`` names the known ones in ``client_id``."""
    spark = batch.sparkSession
    before = _manifests(spark, folder)
    fresh = batch.join(clients.select("client_id").distinct(), "client_id", "left_semi").dropDuplicates(list(IDS))
    ledger = _parts(spark, folder, "ledger", before)
    if ledger is not None:
        fresh = fresh.join(ledger, list(IDS), "left_anti")
    part = uuid.uuid4().hex
    fresh.write.parquet(f"{folder}/data/{part}")
    rows = spark.read.schema(fresh.schema).parquet(f"{folder}/data/{part}")
    rows.select(*IDS).write.parquet(f"{folder}/ledger/{part}")
    if not files.put_text(spark, f"{folder}/manifests/{len(before)}.txt", part, replace=False):
        raise RuntimeError(f"another run has delivered to {folder} meanwhile; run again")


def deliver(results: DataFrame, clients: DataFrame, folder: str, checkpoint: str) -> None:
    """Deliver a stream of results, all that is there."""
    query = results.writeStream.foreachBatch(lambda batch, _: hand_over(batch, clients, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """All that has been delivered."""
    rows = _parts(spark, folder, "data", _manifests(spark, folder))
    if rows is None:
        raise FileNotFoundError(f"nothing was delivered to {folder}")
    return rows

