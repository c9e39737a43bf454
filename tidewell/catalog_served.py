"""Queries of what serves clients: ids, markers, delivery, streams kept up to date, staging, verification; with SQL oracles."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog import CONVERTED, DAILY_SQL, ENDS, LOWER, NAMES, Q1, Q2, Q3, Q5, RATES_SQL, P, _as_csv, _edges, _written, dealt, pairs_sql, sql, tx
from tidewell.functions.ids import TRANSACTIONS, derived_id, source_id, stage_id
from tidewell.functions.scalars import written_date
from tidewell.operators import graph, joins, rows
from tidewell.params import QueryParams
from tidewell.plans import five
from tidewell.plans.workers import worker
from tidewell.sources import staging, verify
from tidewell.sources import tables as t
from tidewell.sources.files import scratch
from tidewell.streaming import bridges, clients, delivery, names


def as_stream(df: DataFrame, parts: int = 4, per_batch: int = 1) -> DataFrame:
    """``df`` as a stream over Parquet files: ``per_batch`` of ``parts`` at a time, each of as many files as its rows need."""
    folder = scratch(df.sparkSession, "in")
    sent, files = dealt(df, parts)
    sent.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch * files).parquet(folder)


def numbered(df: DataFrame, client: str = "a") -> DataFrame:
    """Transactions as a client sends them: with ids from its own numbers."""
    seq = df.withColumn("_seq", F.monotonically_increasing_id())
    return seq.withColumns({"client_id": F.lit(client), "msg_id": source_id(F.lit(client), TRANSACTIONS, F.col("_seq"))}).drop("_seq")


def _message_ids(s: SparkSession, d: str) -> DataFrame:
    events = s.read.parquet(f"{d}/events.parquet")
    own = source_id(F.col("event_type"), TRANSACTIONS, F.col("event_id"))
    df = events.select("event_id", own.alias("id"), (F.col("event_id") % 3).alias("k"), "event_type")
    return df.select("event_id", "id", derived_id(F.col("id"), "q1é", F.col("k")).alias("derived"), stage_id(F.col("event_type"), "q2", F.col("k").cast("string")).alias("stage"))


_LONG = "unhex(printf('%016x', event_id))"
_NAMED = "unhex(printf('%08x', octet_length(encode({0})))) || encode({0})"
MESSAGE_IDS = f"""WITH e AS (SELECT event_id, event_type, event_id % 3 AS k, sha256({_NAMED.format("event_type")} || unhex('00') || {_LONG})[:32] AS id FROM events)
SELECT event_id, id, sha256(unhex(id) || {_NAMED.format("'q1é'")} || unhex(printf('%08x', k)))[:32] AS derived,
       sha256({_NAMED.format("event_type")} || {_NAMED.format("'q2'")} || {_NAMED.format("k::VARCHAR")})[:32] AS stage FROM e"""


def _q4_delta(s: SparkSession, d: str) -> DataFrame:
    folder, state = scratch(s, "bridges"), scratch(s, "state")
    bridges.follow(as_stream(tx(s, d)), folder, state, LOWER)
    return bridges.accounts(s, folder, LOWER)


def messages(df: DataFrame, ends: dict[str, tuple[str, ...]]) -> DataFrame:
    """``df`` as sent by each client of ``ends``, with the markers that it sends."""
    sent = [numbered(df, c).withColumns({"kind": F.lit("tx"), "expected": F.lit(None).cast("long")}) for c in ends]
    out = sent[0]
    for other in sent[1:]:
        out = out.unionByName(other)
    n = df.agg(F.count("*").alias("end"), F.count_if(F.col("timestamp").between(*P.window1)).alias("window1")).first().asDict()
    marks = [(c, f"{c}-{kind}", kind, n.get(kind)) for c, kinds in ends.items() for kind in kinds]
    return out.unionByName(df.sparkSession.createDataFrame(marks, "client_id string, msg_id string, kind string, expected long"), allowMissingColumns=True)


def _q3_clients(s: SparkSession, d: str) -> DataFrame:
    """Four clients: two that end, one of which knows its averages early; one that is aborted; one that never ends."""
    folder, state = scratch(s, "clients"), scratch(s, "state")
    sent = messages(tx(s, d), {"a": ("window1", "end"), "b": ("end",), "c": ("window1", "abort"), "d": ()})
    clients.follow(as_stream(sent), folder, state, P)
    return clients.results(s, folder).drop("msg_id")


def _delivered(s: SparkSession, d: str) -> DataFrame:
    """Results of the first analysis, delivered twice, the second time with a fresh checkpoint; one client is not known."""
    own, folder = numbered(tx(s, d), "a"), scratch(s, "delivered")
    small = five.q1(own, replace(P, tenant_cols=("client_id", "msg_id"))).withColumn("msg_id", derived_id(F.col("msg_id"), "q1"))
    both = small.union(small.withColumn("client_id", F.lit("nobody")))
    stream = as_stream(both.union(both), per_batch=2)
    for _ in range(2):
        delivery.deliver(stream, s.createDataFrame([("a",)], "client_id string"), folder, scratch(s, "state"))
    return delivery.delivered(s, folder).drop("client_id", "msg_id")


def _q2_any_order(s: SparkSession, d: str) -> DataFrame:
    """Accounts and transactions as two streams; each bank also has a name that sorts after its own."""
    accounts = t.sample_accounts(s, d)
    more = accounts.union(accounts.withColumn("bank_name", F.concat("bank_name", F.lit(" again"))))
    folder = scratch(s, "named")
    names.follow(as_stream(numbered(tx(s, d))), as_stream(more), folder, scratch(s, "state"))
    found = names.named(s, folder)
    largest = five.q2(found.drop("bank_name"), found.select(F.col("from_bank").alias("bank_id"), "bank_name").distinct(), P)
    return largest


def _with_bad_rows(s: SparkSession, d: str) -> str:
    """The CSV files of the transactions, and lines of four kinds that cannot be taken, chosen by the cents of the amount."""
    path = _as_csv(s, d)[0]
    line = lambda amount, account, flag: F.concat_ws(",", F.col("timestamp"), F.col("from_bank"), account, F.col("to_bank"), F.col("to_account"), amount, F.lit("Euro"), amount, F.lit("Euro"), F.lit("Wire"), F.lit(flag))
    turn = F.round(F.col("amount_paid") * 100).cast("long") % 40
    own = F.col("from_account")
    made = F.when(turn == 0, F.lit("too,few,columns")).when(turn == 1, line(F.lit("abc"), own, "0")).when(turn == 2, line(F.lit("1.5"), own, "maybe")).when(turn == 3, line(F.lit("1.5"), F.lit(""), "1"))
    lines = tx(s, d).select(made.alias(",".join(t.TRANSACTIONS.fieldNames()))).dropna()  # the column's name is each file's first line
    lines.write.mode("append").options(header=True, sep="\u0001", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def staged(s: SparkSession, d: str) -> staging.Staged:
    return staging.stage(s, _with_bad_rows(s, d), scratch(s, "staged"), P.usd)


def _reasons(s: SparkSession, d: str) -> DataFrame:
    of = staged(s, d)
    return of.rows().select(F.lit("good").alias("reason")).union(of.set_aside().select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _staged_query(name: str, p=P):
    return lambda s, d: five.run_staged(staged(s, d), t.sample_accounts(s, d), t.sample_rates(s), p)[name]


def _laid_out(s: SparkSession, d: str) -> DataFrame:
    name = f"edges_{uuid.uuid4().hex}"
    graph.lay_out(_edges(s, d), name, scratch(s, "edges"), buckets=8)
    return graph.laid_out_pairs(s, name, 3)


def _verified(s: SparkSession, d: str) -> DataFrame:
    """The first analysis held against itself with rows taken away and rows doubled."""
    expected = five.q1(tx(s, d), P)
    actual = expected.where("total_amount >= 1").union(expected.where("total_amount > 49.5"))
    return verify.compare(expected, actual)


def _fetched(s: SparkSession, d: str) -> DataFrame:
    """Rates of three days from the table; a provider is asked for the others, once for each day and currency, and says half a dollar."""
    df, known = _written(s, d), t.rates(s).where("rate_date <= '2022-09-03'")
    asked = t.fetched_rates(df, known, written_date(F.col("timestamp")), lambda wanted: dict.fromkeys(wanted, 0.5))
    return joins.in_usd(df, asked)


def _chain(s: SparkSession, d: str) -> DataFrame:
    """The fourth analysis as a chain of workers, named and configured as in a configuration file."""
    df = rows.by_currency(tx(s, d), P.usd)[0]
    for name, params in (("DateRangeFilter", {"lo": P.window1[0], "hi": P.window1[1]}), ("Spliter", {}), ("ScatterAndGather", {"threshold": 1}), ("ScatterGather", {}), ("ScatterGatherFilter", {"threshold": 3}), ("JoinQuery4", {})):
        df = worker(name, **params)(df)
    return df


_TEXT = "SELECT from_bank, from_account, to_bank, to_account, CAST(total_amount AS VARCHAR) AS total_amount FROM"
_ACTUAL = "actual AS (SELECT * FROM q1 WHERE total_amount >= 1 UNION ALL SELECT * FROM q1 WHERE total_amount > 49.5)"
SERVED: dict[str, tuple] = {
    "fn_message_ids": (_message_ids, MESSAGE_IDS),
    "stream_q4_delta": (_q4_delta, sql(ENDS, pairs_sql(3))),
    "stream_q3_clients": (_q3_clients, sql(f"SELECT client_id, q.* FROM ({Q3}) q, (VALUES ('a'), ('b')) v(client_id)")),
    "stream_delivery": (_delivered, sql(Q1)),
    "stream_q2_any_order": (_q2_any_order, sql(Q2, NAMES)),
    "staged_reasons": (
        _reasons,
        sql("SELECT ['columns', 'amount', 'flag', 'key'][1 + k] AS reason, count(*) AS n FROM (SELECT CAST(round(amount_paid * 100) AS BIGINT) % 40 AS k FROM tx) WHERE k < 4 GROUP BY k UNION ALL SELECT 'good', count(*) FROM tx"),
    ),
    "staged_q1": (_staged_query("q1"), sql(Q1)),
    "staged_q3": (_staged_query("q3"), sql(Q3)),
    "staged_q4": (_staged_query("q4", LOWER), sql(ENDS, pairs_sql(3))),
    "staged_q5": (_staged_query("q5"), sql(Q5, CONVERTED.format("w1"))),
    "q4_split": (lambda s, d: graph.pairs(_edges(s, d), 3, most_met=20), sql("SELECT * FROM pairs", pairs_sql(3))),
    "convert_fetched": (
        _fetched,
        f"{DAILY_SQL} SELECT w.* EXCLUDE (n, day) REPLACE (CASE WHEN payment_currency = 'US Dollar' THEN amount_paid ELSE amount_paid / coalesce(per_usd, 2.0) END AS amount_paid, 'US Dollar' AS payment_currency) "
        f"FROM w LEFT JOIN (SELECT * FROM ({RATES_SQL}) WHERE rate_date <= '2022-09-03') r ON rate_date = day AND currency = payment_currency",
    ),
    "worker_chain": (_chain, sql(ENDS, pairs_sql(3))),
    "params_mapping": (
        lambda s, d: five.q1(tx(s, d), QueryParams.from_mapping({"small_amount": 20.5, "usd": "Euro", "window1": list(P.window1)})),
        sql("SELECT from_bank, from_account, to_bank, to_account, amount_paid AS total_amount FROM tx WHERE payment_currency = 'Euro' AND amount_paid < 20.5"),
    ),
    "q4_laid_out": (_laid_out, sql("SELECT * FROM pairs", pairs_sql(3))),
    "verify_rows": (
        _verified,
        sql(
            f"SELECT *, 'missing' AS side FROM ({_TEXT} q1 EXCEPT ALL {_TEXT} actual) UNION ALL SELECT *, 'extra' FROM ({_TEXT} actual EXCEPT ALL {_TEXT} q1)",
            f"q1 AS ({Q1}), {_ACTUAL}",
        ),
    ),
}
