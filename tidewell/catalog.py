"""The queries of the analyses and their operators over the driver's tables, with SQL oracles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scalars
from tidewell.operators import graph, groups, joins, rows
from tidewell.params import SAMPLE, AggSpec, FilterSpec
from tidewell.plans import five
from tidewell.sources import sinks
from tidewell.sources import tables as t
from tidewell.sources.files import scratch
from tidewell.streaming import runs

P = SAMPLE
LOWER = replace(P, threshold=3)
EDGE = ", ".join(graph.EDGE)
#: Rows of a file that is sent as a stream or read as CSV, about; more rows make more files.
FILE_ROWS = 1 << 20

TX = """tx AS (
  SELECT strftime(e.ts, '%Y/%m/%d %H:%M') AS timestamp, CAST(cf.c_nationkey AS VARCHAR) AS from_bank, CAST(e.user_id AS VARCHAR) AS from_account,
         CAST(ct.c_nationkey AS VARCHAR) AS to_bank, CAST(ct.c_custkey AS VARCHAR) AS to_account, e.value AS amount_paid,
         CASE e.event_id % 5 WHEN 0 THEN 'Euro' WHEN 1 THEN 'Bitcoin' ELSE 'US Dollar' END AS payment_currency, e.event_type AS payment_format
  FROM events e JOIN customer cf ON cf.c_custkey = e.user_id JOIN customer ct ON ct.c_custkey = CAST(json_extract(e.props, '$.k') AS BIGINT)),
accounts AS (SELECT n_name AS bank_name, CAST(n_nationkey AS VARCHAR) AS bank_id FROM nation),
rates AS (SELECT * FROM (VALUES ('US Dollar', 1.0::DOUBLE), ('Euro', 1.0002::DOUBLE), ('Bitcoin', 19793.1::DOUBLE)) v(currency, per_usd)),
usd AS (SELECT * FROM tx WHERE payment_currency = 'US Dollar'),
w1 AS (SELECT * FROM tx WHERE timestamp >= '2024/01/01' AND timestamp <= '2024/01/06'),
w1u AS (SELECT * FROM usd WHERE timestamp >= '2024/01/01' AND timestamp <= '2024/01/06'),
w2u AS (SELECT * FROM usd WHERE timestamp >= '2024/01/06' AND timestamp <= '2024/01/15'),
edges AS (SELECT DISTINCT from_bank, from_account, to_bank, to_account FROM w1u)"""


def sql(body: str, more: str = "") -> str:
    return f"WITH {TX}{', ' + more if more else ''}\n{body}"


def pairs_sql(n: int) -> str:
    return (
        "pairs AS (SELECT a.from_bank, a.from_account, b.to_bank, b.to_account, count(*) AS n FROM edges a JOIN edges b "
        f"ON a.to_bank = b.from_bank AND a.to_account = b.from_account GROUP BY ALL HAVING count(*) >= {n})"
    )


ENDS = "SELECT from_bank AS bank_id, from_account AS account_id FROM pairs UNION SELECT to_bank, to_account FROM pairs"
CONVERTED = "conv AS (SELECT t.* REPLACE (CASE WHEN payment_currency = 'US Dollar' THEN amount_paid ELSE amount_paid / per_usd END AS amount_paid, 'US Dollar' AS payment_currency) FROM {} t JOIN rates ON currency = payment_currency)"
WINNER = "SELECT from_bank, from_account, amount_paid FROM usd QUALIFY row_number() OVER (PARTITION BY from_bank ORDER BY amount_paid DESC, from_account) = 1"
NAMES = "names AS (SELECT bank_id, min(bank_name) AS bank_name FROM accounts GROUP BY bank_id)"
Q1 = "SELECT from_bank, from_account, to_bank, to_account, amount_paid AS total_amount FROM usd WHERE amount_paid < 50"
Q2 = f"SELECT from_bank, from_account, bank_name, amount_paid FROM ({WINNER}) JOIN names ON bank_id = from_bank"
Q3 = "SELECT from_bank, from_account, w2u.payment_format, amount_paid FROM w2u JOIN (SELECT payment_format, avg(amount_paid::DECIMAL(18,2)) AS a FROM w1u GROUP BY payment_format) g ON g.payment_format = w2u.payment_format WHERE amount_paid < a * 0.01"
Q5 = "SELECT count(*) AS count FROM conv WHERE payment_format IN ('view', 'click') AND amount_paid < 1.0"


#: Doubles and how they are written.
PLAIN = {0.0: "0", 1e-07: "0.0000001", 1.23e-06: "0.00000123", 0.1: "0.1", 100.0: "100", 12345678.25: "12345678.25", 1e21: "1000000000000000000000", -2.5e-05: "-0.000025", 1.7976931348623157e308: "17976931348623157" + "0" * 292, 123456789012.5: "123456789012.5"}

#: The rates as the tables of the analyses give them, apart from the code under test.
RATES_SQL = """SELECT rate_date, currency, per_usd::DOUBLE AS per_usd FROM (VALUES
  ('2022-09-01', 1.4644, 5.1805, 1.314, 0.97999, 6.9, 1.0002, 0.86272, 3.3535, 79.543, 139.34, 20.189, 60.367, 3.75, 1.0, 19793.1),
  ('2022-09-02', 1.4691, 5.2035, 1.3141, 0.98175, 6.9035, 1.0011, 0.86468, 3.3755, 79.719, 140.11, 20.085, 60.427, 3.75, 1.0, 199999.0),
  ('2022-09-03', 1.4691, 5.2056, 1.3138, 0.98207, 6.9046, 1.0013, 0.86478, 3.3791, 79.75, 140.17, 20.081, 60.471, 3.75, 1.0, 19831.4),
  ('2022-09-04', 1.4695, 5.2082, 1.3139, 0.98219, 6.9047, 1.0013, 0.8649, 3.3815, 79.754, 140.22, 20.084, 60.461, 3.75, 1.0, 19952.7),
  ('2022-09-05', 1.4722, 5.1786, 1.3142, 0.98273, 6.9216, 1.0068, 0.86813, 3.4006, 79.816, 140.49, 20.018, 60.737, 3.75, 1.0, 20126.1)
) v(rate_date, "Australian Dollar", "Brazil Real", "Canadian Dollar", "Swiss Franc", "Yuan", "Euro", "UK Pound", "Shekel", "Rupee", "Yen", "Mexican Peso", "Ruble", "Saudi Riyal", "US Dollar", "Bitcoin")
UNPIVOT (per_usd FOR currency IN (COLUMNS(* EXCLUDE rate_date)))"""

#: Transactions of September 2022: the cents of the amount choose the day (1 to 7), the layout and the currency.
DAILY_SQL = f"""WITH {TX},
c AS (SELECT *, row_number() OVER () AS n, CAST(round(amount_paid * 100) AS BIGINT) AS k FROM tx),
w AS (SELECT n, '2022-09-0' || (1 + k % 7) AS day, CASE (k // 7) % 6
        WHEN 0 THEN day || 'T23:00:00-05:00' WHEN 1 THEN day || 'T10:00:00' WHEN 2 THEN day || ' 10:00:00'
        WHEN 3 THEN replace(day, '-', '/') || ' 10:00:00' WHEN 4 THEN replace(day, '-', '/') || ' 10:00' ELSE day END AS timestamp,
      from_bank, from_account, to_bank, to_account, amount_paid,
      ['US Dollar', 'Euro', 'Bitcoin', 'Saudi Riyal', 'Ruble', 'Doubloon'][CAST(1 + (k // 42) % 6 AS INT)] AS payment_currency, payment_format FROM c),
known AS (SELECT n, CASE WHEN payment_currency = 'US Dollar' THEN amount_paid ELSE amount_paid / per_usd END AS direct
          FROM w LEFT JOIN ({RATES_SQL}) r ON rate_date = day AND currency = payment_currency),
full_conv AS (SELECT w.* REPLACE (coalesce(direct, amount_paid * CASE payment_currency WHEN 'Saudi Riyal' THEN 1 / 3.75::DOUBLE WHEN 'Ruble' THEN 1 / 60.5::DOUBLE WHEN 'Bitcoin' THEN 20000.0::DOUBLE END) AS amount_paid,
              'US Dollar' AS payment_currency) FROM w JOIN known USING (n)),
conv AS (SELECT * EXCLUDE (n, day) FROM full_conv WHERE amount_paid IS NOT NULL)"""


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.sample_transactions(spark, sf_dir)


def usd(spark, sf_dir) -> DataFrame:
    return rows.by_currency(tx(spark, sf_dir), P.usd)[0]


def w1(spark, sf_dir) -> DataFrame:
    return rows.dated(tx(spark, sf_dir), *P.window1)


def _edges(spark, d):
    return five.q4_edges(tx(spark, d), P)


def _tenants(spark, d):
    both = F.explode(F.array(F.lit("a"), F.lit("b")))
    return five.q1(tx(spark, d).withColumn("client_id", both), replace(P, tenant_cols=("client_id",)))


def dealt(df: DataFrame, parts: int = 4) -> tuple[DataFrame, int]:
    """``df`` in ``parts`` partitions, or more where one would hold over ``FILE_ROWS``; and how many make up a part."""
    times = max(1, -(-df.count() // (parts * FILE_ROWS)))
    return df.repartition(parts * times, *df.columns), times  # by columns: by turns, all rows of a task would be sorted


def _as_csv(spark, d) -> tuple[str, int]:
    """Transactions in a folder of CSV files, and how many of these make up a quarter."""
    path = scratch(spark, "csv")
    full = tx(spark, d).select(
        "timestamp", "from_bank", "from_account", "to_bank", "to_account", F.col("amount_paid").alias("amount_received"),
        F.col("payment_currency").alias("receiving_currency"), "amount_paid", "payment_currency", "payment_format", F.lit("0").alias("is_laundering"),
    )
    sent, files = dealt(full)
    sent.write.option("header", True).csv(path)
    return path, files


def _csv_round(spark, d):
    """Transactions written as CSV and read again with the strict reader."""
    return t.read_transactions(spark, _as_csv(spark, d)[0])


def _ingested(spark, d, what: str):
    """Accounts, then transactions, from CSV files through streams; every row arrives, equal ones too."""
    accounts = t.sample_accounts(spark, d).select("bank_name", "bank_id", F.lit("a").alias("account_number"), F.lit("e").alias("entity_id"), F.lit("n").alias("entity_name"))
    path, out, state = (scratch(spark, x) for x in ("accounts", "out", "state"))
    accounts.write.option("header", True).csv(path)
    sent = t.stream_accounts(spark, path)
    runs.ingest(sent, "a", f"{out}/accounts", f"{state}/accounts")
    if what == "accounts":
        return runs.ingested(spark, f"{out}/accounts", sent).select("bank_name", "bank_id")
    csv, files = _as_csv(spark, d)
    sent = t.stream_transactions(spark, csv, files_per_trigger=2 * files)
    runs.ingest(sent, "a", f"{out}/tx", f"{state}/tx")
    got = runs.ingested(spark, f"{out}/tx", sent)
    if what == "q2":
        names = runs.ingested(spark, f"{out}/accounts", t.stream_accounts(spark, path))
        return five.q2(got, names, P)
    return got.select(*tx(spark, d).columns)


def _streamed(spark, d, kind: str):
    """The driver's events, as Parquet files in a folder, through a stream."""
    folder, out, state = (scratch(spark, x) for x in ("in", "out", "state"))
    batch = tx(spark, d)
    if kind == "again":  # numbered once, as the client sends them
        batch = batch.withColumn("seq", F.monotonically_increasing_id())
    sent, files = dealt(batch)
    sent.write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2 * files).parquet(folder)
    if kind == "q1":
        runs.drain(runs.q1(stream, P), out, state)
    elif kind == "q2":
        runs.latest(runs.q2(stream, t.sample_accounts(spark, d), P).select("from_bank", "from_account", "bank_name", "amount_paid"), out, state)
        return runs.newest(spark, out)
    elif kind == "q5":
        runs.latest(runs.q5(stream, t.sample_rates(spark), P), out, state)
        return runs.newest(spark, out)
    elif kind == "q3":
        return runs.staged(stream, out, state, lambda df: five.q3(df, P))
    elif kind == "q4":
        return runs.staged(stream, out, state, lambda df: five.q4(df, LOWER))
    else:
        sent = runs.numbered(stream, "a", "seq")
        runs.drain(runs.deduplicated(sent.union(sent)), out, state)
        return spark.read.parquet(out).drop("client_id", "msg_id")
    return spark.read.parquet(out)


def _sink(spark, d):
    path = scratch(spark, "csv")
    sinks.write_csv(five.q1(tx(spark, d), P), path)
    return spark.read.option("header", True).csv(path)


def _sink_count(spark, d):
    path = scratch(spark, "csv")
    sinks.write_results({"q5": five.q5(tx(spark, d), t.sample_rates(spark), P)}, path)
    return spark.read.option("header", True).csv(f"{path}/query5.csv")


def _written(spark, d):
    """The transactions moved to September 2022: in six layouts of time, several currencies, and days without a rate."""
    df = tx(spark, d).withColumn("k", F.round(F.col("amount_paid") * 100).cast("long"))
    day = F.concat(F.lit("2022-09-0"), (F.col("k") % 7 + 1).cast("string"))
    slashed, layout = F.replace(day, F.lit("-"), F.lit("/")), F.floor(F.col("k") / 7) % 6
    ends = ("T23:00:00-05:00", "T10:00:00", " 10:00:00", " 10:00:00", " 10:00")
    times = [F.concat(slashed if k in (3, 4) else day, F.lit(end)) for k, end in enumerate(ends)]
    stamp = F.get(F.array(*times, day), layout.cast("int"))
    names = F.array(*[F.lit(c) for c in ("US Dollar", "Euro", "Bitcoin", "Saudi Riyal", "Ruble", "Doubloon")])
    return df.withColumns({"timestamp": stamp, "payment_currency": F.get(names, (F.floor(F.col("k") / 42) % 6).cast("int"))}).drop("k")


def _amount(op, v):
    return lambda s, d: rows.keep(tx(s, d), FilterSpec("amount", op, v))


def _format(op, v):
    return lambda s, d: rows.keep(tx(s, d), FilterSpec("format", op, v))


ENTRIES: dict[str, tuple] = {
    "q1": (lambda s, d: five.q1(tx(s, d), P), sql(Q1)),
    "q1_sorted": (lambda s, d: five.q1(tx(s, d), P).orderBy("from_bank", "from_account"), sql(Q1)),
    "q2": (lambda s, d: five.q2(tx(s, d), t.sample_accounts(s, d), P), sql(Q2, NAMES)),
    "q3": (lambda s, d: five.q3(tx(s, d), P), sql(Q3)),
    "q4": (lambda s, d: five.q4(tx(s, d), P), sql(ENDS, pairs_sql(5))),
    "q4_t3": (lambda s, d: five.q4(tx(s, d), LOWER), sql(ENDS, pairs_sql(3))),
    "q4_unpruned": (lambda s, d: five.q4(tx(s, d), LOWER, pruned=False), sql(ENDS, pairs_sql(3))),
    "q4_edges": (_edges, sql("SELECT * FROM edges")),
    "q4_heavy_sources": (lambda s, d: graph.heavy(_edges(s, d), "from", 3), sql("SELECT from_bank, from_account, count(*) AS n FROM edges GROUP BY ALL HAVING count(*) >= 3")),
    "q4_heavy_sinks": (lambda s, d: graph.heavy(_edges(s, d), "to", 3), sql("SELECT to_bank, to_account, count(*) AS n FROM edges GROUP BY ALL HAVING count(*) >= 3")),
    "q4_two_hop": (lambda s, d: graph.pairs(_edges(s, d), 1, pruned=False), sql("SELECT * FROM pairs", pairs_sql(1))),
    "q4_pairs": (lambda s, d: graph.pairs(_edges(s, d), 3, pruned=False), sql("SELECT * FROM pairs", pairs_sql(3))),
    "q4_pruned": (lambda s, d: graph.pairs(_edges(s, d), 3), sql("SELECT * FROM pairs", pairs_sql(3))),
    "q4_salted": (lambda s, d: graph.pairs(_edges(s, d), 3, salts=8), sql("SELECT * FROM pairs", pairs_sql(3))),
    "semi_heavy": (
        lambda s, d: _edges(s, d).join(graph.heavy(_edges(s, d), "from", 3).drop("n"), ["from_bank", "from_account"], "left_semi"),
        sql("SELECT * FROM edges SEMI JOIN (SELECT from_bank, from_account FROM edges GROUP BY ALL HAVING count(*) >= 3) USING (from_bank, from_account)"),
    ),
    "q4_notebook": (
        lambda s, d: rows.ends(_notebook(s, d)).distinct(),
        sql(
            ENDS,
            "src AS (SELECT from_bank, from_account FROM edges GROUP BY ALL HAVING count(*) > 1), r AS (SELECT * FROM w1u SEMI JOIN src USING (from_bank, from_account)), "
            "pairs AS (SELECT a.from_bank, a.from_account, b.to_bank, b.to_account FROM r a JOIN r b ON a.to_bank = b.from_bank AND a.to_account = b.from_account "
            "WHERE a.from_bank <> b.to_bank OR a.from_account <> b.to_account GROUP BY ALL HAVING count(*) > 2)",
        ),
    ),
    "q5": (lambda s, d: five.q5(tx(s, d), t.sample_rates(s), P), sql(Q5, CONVERTED.format("w1"))),
    "q5_filter": (
        lambda s, d: rows.keep(joins.in_usd(w1(s, d), t.sample_rates(s)), FilterSpec("amount", "<", 1.0)),
        sql("SELECT * FROM conv WHERE amount_paid < 1.0", CONVERTED.format("w1")),
    ),
    "convert_usd": (lambda s, d: joins.in_usd(tx(s, d), t.sample_rates(s)), sql("SELECT * FROM conv", CONVERTED.format("tx"))),
    "scan_transactions": (tx, sql("SELECT * FROM tx")),
    "scan_accounts": (t.sample_accounts, sql("SELECT * FROM accounts")),
    "scan_csv": (_csv_round, sql("SELECT timestamp, from_bank, from_account, to_bank, to_account, amount_paid AS amount_received, payment_currency AS receiving_currency, amount_paid, payment_currency, payment_format, false AS is_laundering FROM tx")),
    "sink_csv": (_sink, sql(f"SELECT from_bank, from_account, to_bank, to_account, regexp_replace(CAST(total_amount AS VARCHAR), '\\.0$', '') AS total_amount FROM ({Q1})")),
    "sink_csv_q5": (_sink_count, sql(f"SELECT CAST(count AS VARCHAR) AS count FROM ({Q5})", CONVERTED.format("w1"))),
    "fn_plain_number": (
        lambda s, d: s.createDataFrame([(x,) for x in PLAIN], "x double").select("x", scalars.plain_number(F.col("x")).alias("digits")),
        "SELECT * FROM (VALUES " + ", ".join(f"({x!r}::DOUBLE, '{shown}')" for x, shown in PLAIN.items()) + ") v(x, digits)",
    ),
    "convert_daily": (lambda s, d: joins.in_usd(_written(s, d), t.rates(s), t.fallbacks(s)), DAILY_SQL + " SELECT * FROM conv"),
    "convert_daily_strict": (lambda s, d: joins.in_usd(_written(s, d), t.rates(s)), DAILY_SQL + " SELECT * EXCLUDE (n, day, direct) REPLACE (direct AS amount_paid) FROM (SELECT f.*, direct FROM full_conv f JOIN known USING (n)) WHERE direct IS NOT NULL"),
    "q5_daily": (lambda s, d: five.q5(_written(s, d), t.rates(s), replace(P, window1=("2022", "2023"), micro_amount=20.0), t.fallbacks(s)), DAILY_SQL + " SELECT count(*) AS count FROM conv WHERE payment_format IN ('view', 'click') AND amount_paid < 20"),
    "fn_tx_date_layouts": (lambda s, d: _written(s, d).select("timestamp", scalars.written_date(F.col("timestamp")).cast("string").alias("day")), DAILY_SQL + " SELECT timestamp, day FROM w"),
    "nb_shared_accounts_some": (
        lambda s, d: _all_accounts(s, d).withColumn("account", (F.col("account").cast("long") % 50).cast("string")).distinct().groupBy("account").agg(F.count("*").alias("banks")).where("banks > 1"),
        sql("SELECT account, count(*) AS banks FROM (SELECT from_bank AS bank, CAST(from_account::BIGINT % 50 AS VARCHAR) AS account FROM tx UNION SELECT to_bank, CAST(to_account::BIGINT % 50 AS VARCHAR) FROM tx) GROUP BY account HAVING count(*) > 1"),
    ),
    "project_parts": (lambda s, d: rows.without(tx(s, d), ["origin.BankID", "dest.ID"]), sql("SELECT * EXCLUDE (from_bank, to_account) FROM tx")),
    "rates_dim": (lambda s, d: t.rates(s).select(F.col("rate_date").cast("string").alias("rate_date"), "currency", "per_usd"), f"SELECT * FROM ({RATES_SQL})"),
    "project_clean": (lambda s, d: rows.without(tx(s, d), ["timestamp", "dest"]), sql("SELECT * EXCLUDE (timestamp, to_bank, to_account) FROM tx")),
    "project_blank": (lambda s, d: rows.blanked(tx(s, d), ["dest"]), sql("SELECT * REPLACE ('' AS to_bank, '' AS to_account) FROM tx")),
    "explode_pair": (lambda s, d: rows.ends(graph.pairs(_edges(s, d), 3)), sql("SELECT from_bank AS bank_id, from_account AS account_id FROM pairs UNION ALL SELECT to_bank, to_account FROM pairs", pairs_sql(3))),
    "fn_account_id": (
        lambda s, d: tx(s, d).select(scalars.account_id(F.col("from_bank"), F.col("from_account")).alias("id")).select("id", scalars.split_account_id(F.col("id"))[0].alias("bank"), scalars.split_account_id(F.col("id"))[1].alias("account")),
        sql("SELECT from_bank || '-' || from_account AS id, from_bank AS bank, from_account AS account FROM tx"),
    ),
    "fn_canonical_bank": (
        lambda s, d: tx(s, d).select(F.concat(F.lit("00"), "from_bank").alias("raw")).select("raw", scalars.canonical_bank(F.col("raw")).alias("bank")),
        sql("SELECT '00' || from_bank AS raw, from_bank AS bank FROM tx"),
    ),
    "fn_tx_date": (lambda s, d: tx(s, d).select("timestamp", scalars.written_date(F.col("timestamp")).cast("string").alias("day")), sql("SELECT timestamp, replace(timestamp[1:10], '/', '-') AS day FROM tx")),
    "fn_day": (lambda s, d: tx(s, d).select("timestamp", scalars.day(F.col("timestamp")).alias("day")), sql("SELECT timestamp, timestamp[1:10] AS day FROM tx")),
    "filter_amount_gt": (_amount(">", 50.0), sql("SELECT * FROM tx WHERE amount_paid > 50")),
    "filter_amount_lt": (_amount("<", 50.0), sql("SELECT * FROM tx WHERE amount_paid < 50")),
    "filter_amount_eq": (_amount("==", 12.5), sql("SELECT * FROM tx WHERE amount_paid = 12.5")),
    "filter_format_in": (_format("==", ("view", "click")), sql("SELECT * FROM tx WHERE payment_format IN ('view', 'click')")),
    "filter_format_not_in": (_format("!=", ("view", "click")), sql("SELECT * FROM tx WHERE payment_format NOT IN ('view', 'click') AND payment_format <> ''")),
    "filter_date_range": (w1, sql("SELECT * FROM w1")),
    "split_currency": (lambda s, d: _split(s, d), sql("SELECT CASE WHEN payment_currency = 'US Dollar' THEN 'tx.usd' ELSE 'tx.non-usd' END AS route, * FROM tx")),
    "check_keys": (lambda s, d: rows.checked(tx(s, d), ["from_bank", "to_account"]), sql("SELECT * FROM tx")),
    "join_bank_name": (lambda s, d: joins.with_bank_name(tx(s, d), t.sample_accounts(s, d)), sql("SELECT tx.*, bank_name FROM tx JOIN names ON bank_id = from_bank", NAMES)),
    "ingest_counts": (lambda s, d: groups.totals(tx(s, d)), sql("SELECT count(*) AS n, count(*) FILTER (payment_currency = 'US Dollar') AS n_usd, count(*) FILTER (payment_currency <> 'US Dollar') AS n_other FROM tx")),
    "agg_count": (lambda s, d: groups.aggregate(tx(s, d), AggSpec("count")), sql("SELECT count(*) AS count FROM tx")),
    "repartition_by": (lambda s, d: tx(s, d).repartition("from_bank"), sql("SELECT * FROM tx")),
    "tenant_q1": (_tenants, sql(f"SELECT client_id, q.* FROM ({Q1}) q, (VALUES ('a'), ('b')) v(client_id)")),
    "accounts_union": (lambda s, d: _all_accounts(s, d), sql("SELECT from_bank AS bank, from_account AS account FROM tx UNION SELECT to_bank, to_account FROM tx")),
    "nb_ts_range": (lambda s, d: tx(s, d).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")), sql("SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM tx")),
    "nb_shared_accounts": (
        lambda s, d: _all_accounts(s, d).groupBy("account").agg(F.count("*").alias("banks")).where("banks > 1"),
        sql("SELECT account, count(*) AS banks FROM (SELECT from_bank AS bank, from_account AS account FROM tx UNION SELECT to_bank, to_account FROM tx) GROUP BY account HAVING count(*) > 1"),
    ),
    "nb_group_filter": (lambda s, d: graph.partners_above(rows.dated(usd(s, d), *P.window1), 2), sql("SELECT * FROM w1u SEMI JOIN (SELECT from_bank, from_account FROM edges GROUP BY ALL HAVING count(*) > 2) USING (from_bank, from_account)")),
    "stream_ingest": (lambda s, d: _ingested(s, d, "tx"), sql("SELECT * FROM tx")),
    "stream_ingest_accounts": (lambda s, d: _ingested(s, d, "accounts"), sql("SELECT * FROM accounts")),
    "stream_ingest_q2": (lambda s, d: _ingested(s, d, "q2"), sql(Q2, NAMES)),
    "stream_dedup": (lambda s, d: _streamed(s, d, "again"), sql("SELECT * FROM tx")),
    "stream_q1": (lambda s, d: _streamed(s, d, "q1"), sql(Q1)),
    "stream_q2": (lambda s, d: _streamed(s, d, "q2"), sql(Q2, NAMES)),
    "stream_q3": (lambda s, d: _streamed(s, d, "q3"), sql(Q3)),
    "stream_q4": (lambda s, d: _streamed(s, d, "q4"), sql(ENDS, pairs_sql(3))),
    "stream_q5": (lambda s, d: _streamed(s, d, "q5"), sql(Q5, CONVERTED.format("w1"))),
}


def _split(spark, d):
    own, other = rows.by_currency(tx(spark, d), P.usd)
    return own.select(F.lit("tx.usd").alias("route"), "*").union(other.select(F.lit("tx.non-usd").alias("route"), "*"))


def _all_accounts(spark, d):
    df = tx(spark, d)
    side = lambda p: df.select(F.col(f"{p}_bank").alias("bank"), F.col(f"{p}_account").alias("account"))
    return side("from").union(side("to")).distinct()


def _notebook(spark, d):
    """Pairs counted by transfers instead of bridges, among sources with several partners."""
    busy = graph.partners_above(rows.dated(usd(spark, d), *P.window1), 1)
    return graph.pairs(busy.select(*graph.EDGE), 3, pruned=False, exclude_cycles=True)


SHORT = {"origin_bank": ("from_bank",), "origin_account": ("from_bank", "from_account"), "dest_bank": ("to_bank",), "dest_account": ("to_bank", "to_account"), "format": ("payment_format",)}
for _kind in ("max", "min", "sum", "avg", "count"):
    for _group, _keys in SHORT.items():
        _by = ", ".join(_keys)
        _own = ["from_account"] if "from_account" not in _keys else []
        if _kind in ("max", "min"):
            _order = "DESC" if _kind == "max" else "ASC"
            _cols = ", ".join([*_keys, *_own, "amount_paid"])
            _sql = f"SELECT {_cols} FROM usd QUALIFY row_number() OVER (PARTITION BY {_by} ORDER BY {', '.join([f'amount_paid {_order}', *_own])}) = 1"
        elif _kind == "count":
            _sql = f"SELECT {_by}, count(*) AS count FROM usd GROUP BY ALL"
        elif _kind == "sum":
            _sql = f"SELECT {_by}, sum(amount_paid::DECIMAL(18,2))::DOUBLE AS amount_paid FROM usd GROUP BY ALL"
        else:  # Spark's decimal average has six decimals, rounded half up
            _sql = f"SELECT {_by}, round(sum(amount_paid::DECIMAL(18,2))::DOUBLE / count(*), 6) AS amount_paid FROM usd GROUP BY ALL"
        ENTRIES[f"agg_{_kind}_{_group}"] = (lambda s, d, k=_kind, g=_group: groups.aggregate(usd(s, d), AggSpec(k, g)), sql(_sql))


def _every() -> dict[str, tuple]:
    from tidewell.catalog_served import SERVED  # it builds on this module

    return ENTRIES | SERVED


def queries() -> dict:
    return {name: build for name, (build, _) in _every().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _every().items() if text}
