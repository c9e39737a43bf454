"""Transactions, accounts and rates: CSV files, streams of files, and the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalars import canonical_bank

_text, _number = T.StringType(), T.DoubleType()
TRANSACTIONS = T.StructType([
    T.StructField("timestamp", _text), T.StructField("from_bank", _text), T.StructField("from_account", _text),
    T.StructField("to_bank", _text), T.StructField("to_account", _text), T.StructField("amount_received", _number),
    T.StructField("receiving_currency", _text), T.StructField("amount_paid", _number), T.StructField("payment_currency", _text),
    T.StructField("payment_format", _text), T.StructField("is_laundering", _text),
])
ACCOUNTS = T.StructType([T.StructField(n, _text) for n in ("bank_name", "bank_id", "account_number", "entity_id", "entity_name")])

#: Units of each currency for a US dollar; Bitcoin as its table has it, 199999.0 included.
RATE_CURRENCIES = (
    "Australian Dollar", "Brazil Real", "Canadian Dollar", "Swiss Franc", "Yuan", "Euro", "UK Pound", "Shekel", "Rupee", "Yen",
    "Mexican Peso", "Ruble", "Saudi Riyal", "US Dollar", "Bitcoin",
)
RATES = {
    "2022-09-01": (1.4644, 5.1805, 1.314, 0.97999, 6.9, 1.0002, 0.86272, 3.3535, 79.543, 139.34, 20.189, 60.367, 3.75, 1.0, 19793.1),
    "2022-09-02": (1.4691, 5.2035, 1.3141, 0.98175, 6.9035, 1.0011, 0.86468, 3.3755, 79.719, 140.11, 20.085, 60.427, 3.75, 1.0, 199999.0),
    "2022-09-03": (1.4691, 5.2056, 1.3138, 0.98207, 6.9046, 1.0013, 0.86478, 3.3791, 79.75, 140.17, 20.081, 60.471, 3.75, 1.0, 19831.4),
    "2022-09-04": (1.4695, 5.2082, 1.3139, 0.98219, 6.9047, 1.0013, 0.8649, 3.3815, 79.754, 140.22, 20.084, 60.461, 3.75, 1.0, 19952.7),
    "2022-09-05": (1.4722, 5.1786, 1.3142, 0.98273, 6.9216, 1.0068, 0.86813, 3.4006, 79.816, 140.49, 20.018, 60.737, 3.75, 1.0, 20126.1),
}
#: US dollars for a unit where the table has no rate.
FALLBACKS = {"Saudi Riyal": 1 / 3.75, "Ruble": 1 / 60.5, "Bitcoin": 20000.0}

#: Returns US dollars for a unit of each (day, currency) that it knows; called on the driver, once.
RateProvider = Callable[[list[tuple[str, str]]], dict[tuple[str, str], float]]


def _typed(raw: DataFrame) -> DataFrame:
    flag = F.lower("is_laundering")
    known = F.when(flag.isin("1", "t", "true"), True).when(flag.isin("0", "f", "false"), False)
    flagged = F.when(flag.isNotNull() & known.isNull(), F.raise_error(F.concat(F.lit("no truth value: "), F.col("is_laundering"))).cast("boolean")).otherwise(known)
    return raw.withColumns({"from_bank": canonical_bank(F.col("from_bank")), "to_bank": canonical_bank(F.col("to_bank")), "is_laundering": flagged})


def _csv(reader, schema: T.StructType):
    return reader.schema(schema).options(header=True, enforceSchema=True, mode="FAILFAST", escape='"', emptyValue="", nullValue="\u0000")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transactions from CSV. A malformed row fails the read; bank ids lose leading zeros."""
    return _typed(_csv(spark.read, TRANSACTIONS).csv(path))


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark.read, ACCOUNTS).csv(path)


def stream_transactions(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream over a folder of CSV files."""
    reader = spark.readStream if files_per_trigger is None else spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return _typed(_csv(reader, TRANSACTIONS).csv(path))


def stream_accounts(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark.readStream, ACCOUNTS).csv(path)


def rates(spark: SparkSession) -> DataFrame:
    """``(rate_date, currency, per_usd)``: 75 rows."""
    rows = [(day, c, r) for day, values in RATES.items() for c, r in zip(RATE_CURRENCIES, values)]
    return spark.createDataFrame(rows, "rate_date string, currency string, per_usd double").withColumn("rate_date", F.col("rate_date").cast("date"))


def fallbacks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FALLBACKS.items()), "currency string, usd_per_unit double")


def fetched_rates(tx: DataFrame, known: DataFrame, date_col: F.Column, provider: RateProvider) -> DataFrame:
    """``known`` with what ``provider`` knows of the days and currencies that it lacks.

    The driver sees a row for each missing day and currency, not for each transaction.
    """
    missing = tx.select(date_col.alias("rate_date"), F.col("payment_currency").alias("currency")).where("rate_date is not null").distinct()
    missing = missing.join(known, ["rate_date", "currency"], "left_anti").orderBy("rate_date", "currency").collect()
    found = provider([(r.rate_date.isoformat(), r.currency) for r in missing])
    rows = [(day, c, 1 / usd) for (day, c), usd in found.items() if usd]
    more = tx.sparkSession.createDataFrame(rows, "rate_date string, currency string, per_usd double")
    return known.unionByName(more.withColumn("rate_date", F.col("rate_date").cast("date")))


def sample_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as transactions between customers."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    events = read("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    side = lambda p: read("customer").select(F.col("c_custkey").alias(f"{p}_key"), F.col("c_nationkey").cast("string").alias(f"{p}_bank"))
    met = events.join(side("from"), F.col("user_id") == F.col("from_key")).join(side("to"), F.col("k") == F.col("to_key"))
    turn = F.col("event_id") % 5
    currency = F.when(turn == 0, "Euro").when(turn == 1, "Bitcoin").otherwise("US Dollar")
    return met.select(
        F.date_format("ts", "yyyy/MM/dd HH:mm").alias("timestamp"), "from_bank", F.col("user_id").cast("string").alias("from_account"),
        "to_bank", F.col("to_key").cast("string").alias("to_account"), F.col("value").alias("amount_paid"),
        currency.alias("payment_currency"), F.col("event_type").alias("payment_format"),
    )


def sample_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select(F.col("n_name").alias("bank_name"), F.col("n_nationkey").cast("string").alias("bank_id"))


def sample_rates(spark: SparkSession) -> DataFrame:
    """One rate for each currency, of every day."""
    return spark.createDataFrame([("US Dollar", 1.0), ("Euro", 1.0002), ("Bitcoin", 19793.1)], "currency string, per_usd double")
