"""Transactions and accounts that arrive in any order: each stream goes to a log of its own, and the logs are joined where they are read.

So a transaction finds names that came before it and names that come after, and nothing of either stream is held in executors'
memory: without a bound on how late a name may come, a join of the streams themselves would keep every transaction in its state, by bank,
and write it once for each name. A bank may have several names, which may also come one after the other: ``named`` takes the least of
those that arrived, whatever their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.streaming.runs import drain


def follow(tx: DataFrame, accounts: DataFrame, folder: str, checkpoint: str) -> None:
    """Take in all that is there of both streams, each row exactly once; ``tx`` has ``msg_id``."""
    drain(accounts.select("bank_id", "bank_name"), f"{folder}/names", f"{checkpoint}/names")
    drain(tx, f"{folder}/tx", f"{checkpoint}/tx")


def named(spark: SparkSession, folder: str) -> DataFrame:
    """Each transaction once, with the least name of its bank so far; those of banks without a name are not there yet."""
    tx = spark.read.parquet(f"{folder}/tx")
    names = spark.read.parquet(f"{folder}/names").groupBy(F.col("bank_id").alias("_bank")).agg(F.min("bank_name").alias("bank_name"))
    keys = [c for c in ("client_id", "msg_id") if c in tx.columns]
    return tx.join(names, tx.from_bank == names["_bank"]).drop("_bank").dropDuplicates(keys)
