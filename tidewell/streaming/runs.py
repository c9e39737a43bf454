"""Streams of transactions: all that is there is taken, in micro-batches, then the stream ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.ids import TRANSACTIONS, source_id
from tidewell.operators import groups, joins, rows
from tidewell.params import AggSpec, FilterSpec, QueryParams
from tidewell.plans import five


def numbered(stream: DataFrame, client: str, sequence: str) -> DataFrame:
    """``stream`` with ``client_id`` and ``msg_id``: what deliveries are told apart by.

    ``sequence`` names the column in which the client numbers its messages, from which the id is made, so that equal rows stay
    apart. What comes from files without numbers goes through ``ingest``.
    """
    msg_id = source_id(F.lit(client), TRANSACTIONS, F.col(sequence))
    return stream.withColumns({"client_id": F.lit(client), "msg_id": msg_id}).drop(sequence)


def deduplicated(stream: DataFrame, ids: tuple[str, ...] = ("client_id", "msg_id"), watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each message once. With a watermark (time column, delay) old ids are forgotten; without one all are kept."""
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(list(ids))
    return stream.dropDuplicates(list(ids))


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is there to Parquet, each row exactly once, also over restarts."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()


def latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the newest result of a running aggregate in Parquet: two folders by turns, so that one is always whole."""

    def put(batch: DataFrame, no: int) -> None:
        batch.withColumn("batch", F.lit(no)).write.mode("overwrite").parquet(f"{path}/turn={no % 2}")  # the same batch again writes the same result

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole result that ``latest`` has written."""
    both = spark.read.parquet(path)
    return both.where(F.col("batch") == both.agg(F.max("batch")).first()[0]).drop("batch", "turn")


def ingest(stream: DataFrame, client: str, path: str, checkpoint: str) -> None:
    """Take in a stream of files, every row once, equal ones too, with ``client_id`` and ``msg_id``.

    The id is the file, the place of the row's block in it and the row's number in that block. A batch that is taken
    again has the same files, and overwrites what it wrote.
    """

    def put(batch: DataFrame, no: int) -> None:
        block = W.partitionBy("_file", "_block").orderBy("_order")
        placed = batch.withColumn("_order", F.monotonically_increasing_id()).withColumn("_row", F.row_number().over(block))
        named = placed.withColumns({"client_id": F.lit(client), "msg_id": F.concat_ws(":", "_file", "_block", "_row")})
        named.drop("_file", "_block", "_order", "_row").write.mode("overwrite").parquet(f"{path}/batch={no}")

    placed = stream.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    query = placed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingested(spark: SparkSession, path: str, kind: DataFrame) -> DataFrame:
    """What ``ingest`` has written, with the columns of ``kind``, ``client_id`` and ``msg_id``; each message once."""
    schema = kind.schema.add("client_id", "string").add("msg_id", "string").add("batch", "integer")
    return spark.read.schema(schema).parquet(path).dropDuplicates(["client_id", "msg_id"]).drop("batch")


def q1(stream: DataFrame, p: QueryParams) -> DataFrame:
    return five.q1(stream, p)


def q2(stream: DataFrame, accounts: DataFrame, p: QueryParams) -> DataFrame:
    """The running largest transfers, joined with the accounts, which do not change."""
    return joins.with_bank_name(groups.aggregate(rows.by_currency(stream, p.usd)[0], AggSpec("max", "origin_bank"), p.tenant_cols), accounts)


def q5(stream: DataFrame, rates: DataFrame, p: QueryParams) -> DataFrame:
    chosen = rows.keep(rows.dated(stream, *p.window1), FilterSpec("format", "==", p.formats))
    return groups.aggregate(rows.keep(joins.in_usd(chosen, rates, None, p.usd), FilterSpec("amount", "<", p.micro_amount)), AggSpec("count"))


def staged(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Take in the stream, then run a batch query over all of it: for queries that need the whole input first."""
    drain(stream, path, checkpoint)
    return then(stream.sparkSession.read.parquet(path))
