"""Hand-written cases with literal results."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalars
from tidewell.operators import graph, groups, joins, rows
from tidewell.params import AggSpec, FilterSpec, QueryParams
from tidewell.plans import five
from tidewell.plans.workers import WORKERS, worker
from tidewell.sources import sinks, tables

P = QueryParams()
TX = "timestamp string, from_bank string, from_account string, to_bank string, to_account string, amount_paid double, payment_currency string, payment_format string"


def tx(spark, *items):
    """Rows from (time, from, to, amount, currency, format); accounts as bank-account."""
    made = [(t, *a.split("-"), *b.split("-"), float(x), c, f) for t, a, b, x, c, f in items]
    return spark.createDataFrame(made, TX)


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def usd(a, b, x=100, t="2022/09/01 10:00", f="Wire", c="US Dollar"):
    return (t, a, b, x, c, f)


def test_windows_are_strings(spark):
    times = ["2022/08/31 23:59", "2022/09/01 00:00", "2022/09/05 23:59", "2022/09/06", "2022/09/06 00:00", "2022/09/14 23:59", "2022/09/15 00:00"]
    df = tx(spark, *[usd("1-a", "1-b", t=t) for t in times])
    assert [r[0] for r in bag(rows.dated(df, *P.window1).select("timestamp"))] == times[1:4]
    assert [r[0] for r in bag(rows.dated(df, *P.window2).select("timestamp"))] == times[3:6]


def test_bank_ids(spark):
    df = spark.createDataFrame([("",), ("0",), ("000",), ("00410",), ("410",)], "b string")
    assert [r[0] for r in df.select(scalars.canonical_bank(F.col("b"))).collect()] == ["", "0", "0", "410", "410"]


def test_dates(spark):
    layouts = ["2022-09-01T10:00:00Z", "2022-09-01T23:00:00-05:00", "2022-09-01T10:00:00", "2022-09-01 10:00:00", "2022/09/01 10:00:00", "2022/09/01 10:00", "2022-09-01", "x"]
    df = spark.createDataFrame([(x,) for x in layouts], "t string")
    got = [r[0] for r in df.select(scalars.written_date(F.col("t")).cast("string")).collect()]
    assert got == ["2022-09-01"] * 7 + [None]


def test_q1(spark):
    df = tx(spark, usd("1-a", "2-b", 49.99), usd("1-a", "2-b", 49.99), usd("1-a", "2-b", 50), usd("1-a", "2-b", 50.01), usd("1-a", "2-b", 1, c="Euro"))
    assert bag(five.q1(df, P)) == [("1", "a", "2", "b", 49.99)] * 2


def test_q2_ties_and_names(spark):
    df = tx(spark, usd("7-z", "1-a", 5), usd("7-b", "1-a", 5), usd("8-c", "1-a", 9))
    accounts = spark.createDataFrame([("Two", "7"), ("One", "7")], "bank_name string, bank_id string")
    assert bag(five.q2(df, accounts, P)) == [("7", "b", "One", 5.0)]


def test_q3(spark):
    late = "2022/09/07 00:00"
    df = tx(spark, usd("1-a", "2-b", 100), usd("1-a", "2-b", 0.99, late), usd("1-a", "2-b", 1, late), usd("1-a", "2-b", 0.01, late, "ACH"))
    assert bag(five.q3(df, P)) == [("1", "a", "Wire", 0.99)]


def bridged(n, a="1-a", c="1-c", **more):
    return [e for k in range(n) for e in (usd(a, f"2-b{k}"), usd(a, f"2-b{k}"), usd(f"2-b{k}", c, **(more if k == 0 else {})))]


@pytest.mark.parametrize("pruned", [True, False])
def test_q4(spark, pruned):
    found = lambda edges, p=P: bag(five.q4(tx(spark, *edges), p, pruned))
    assert found(bridged(4)) == []
    assert found(bridged(5)) == [("1", "a"), ("1", "c")]
    assert found(bridged(5, c="1-a")) == [("1", "a")]
    assert found(bridged(5, c="1-a"), QueryParams(exclude_cycles=True)) == []
    assert found(bridged(5, c="3-a")) == [("1", "a"), ("3", "a")]
    assert found(bridged(5, c="1-c", **{"c": "Euro"} if False else {"t": "2022/09/08 00:00"})) == []


def test_salted_bridges(spark):
    """One bridge of 60 sources and 50 sinks: the same pairs, with no task that meets all of them."""
    df = tx(spark, *[usd(f"1-s{k}", "2-b") for k in range(60)], *[usd("2-b", f"3-t{k}") for k in range(50)])
    edge = graph.edges(df)
    one, dealt = graph.pairs(edge, 1), graph.pairs(edge, 1, salts=4)
    assert bag(one) == bag(dealt) and one.count() == 3000
    joined = dealt._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in joined


def test_q4_euro(spark):
    edges = [(t, a, b, x, "Euro" if b == "1-c" and a == "2-b0" else c, f) for t, a, b, x, c, f in bridged(5)]
    assert bag(five.q4(tx(spark, *edges), P)) == []


def test_q5(spark):
    second = "2022/09/02 10:00"
    df = tx(
        spark, usd("1-a", "2-b", 1, c="Euro"), usd("1-a", "2-b", 0.99, f="ACH"), usd("1-a", "2-b", 1), usd("1-a", "2-b", 0.1, f="Cheque"),
        usd("1-a", "2-b", 10000, second, c="Bitcoin"), usd("1-a", "2-b", 0.5, c="Foo"), usd("1-a", "2-b", 0.5, t="2022/09/05", c="Euro"),
    )
    assert bag(five.q5(df, tables.rates(spark), P)) == [(3,)]  # the last has no time, and so no layout
    late = tx(spark, usd("1-a", "2-b", 3, "2022/09/05 10:00", c="Saudi Riyal"), usd("1-a", "2-b", 3, "2022/10/05 10:00", c="Saudi Riyal"))
    converted = joins.in_usd(late, tables.rates(spark), tables.fallbacks(spark))
    assert [round(r.amount_paid, 9) for r in converted.collect()] == [0.8, 0.8]


def test_provider(spark):
    df = tx(spark, usd("1-a", "2-b", 2, "2023/01/01 00:00", c="Yen"))
    asked = []
    known = tables.fetched_rates(df, tables.rates(spark), scalars.written_date(F.col("timestamp")), lambda keys: asked.extend(keys) or {k: 0.01 for k in keys})
    assert asked == [("2023-01-01", "Yen")]
    assert round(joins.in_usd(df, known).first().amount_paid, 9) == 0.02


def test_empty(spark):
    none = spark.createDataFrame([], TX)
    accounts = spark.createDataFrame([], "bank_name string, bank_id string")
    made = five.run_all(none, accounts, tables.rates(spark), P)
    assert [bag(made[q]) for q in ("q1", "q2", "q3", "q4", "q5")] == [[], [], [], [], [(0,)]]


def test_tenants(spark):
    df = tx(spark, *bridged(5), usd("1-a", "2-b", 1))
    both = df.withColumn("client_id", F.explode(F.array(F.lit("x"), F.lit("y"))))
    p = QueryParams(tenant_cols=("client_id",))
    for query in (five.q1, five.q3, five.q4):
        one = bag(query(df, P))
        assert bag(query(both, p)) == sorted((c, *r) for c in "xy" for r in one)


def test_aggregates_and_specs(spark):
    df = tx(spark, usd("1-a", "2-b", 1.1), usd("1-c", "2-b", 2.2), usd("3-a", "2-b", 5, f="ACH"))
    assert bag(groups.aggregate(df, AggSpec("min", "origin_bank"))) == [("1", "a", 1.1), ("3", "a", 5.0)]
    assert bag(groups.aggregate(df, AggSpec("sum", "format"))) == [("ACH", 5.0), ("Wire", 3.3)]
    assert bag(groups.totals(df)) == [(3, 3, 0)]
    for bad in (lambda: AggSpec("max"), lambda: AggSpec("median", "format"), lambda: FilterSpec("amount", "!=", 1.0), lambda: FilterSpec("format", "==", ()), lambda: QueryParams(threshold=0), lambda: QueryParams.from_mapping({"x": 1}), lambda: worker("Nothing")):
        with pytest.raises(ValueError):
            bad()


def test_workers(spark):
    df = tx(spark, *bridged(5))
    p = worker("Spliter")(df)
    pairs = worker("ScatterGatherFilter", threshold=5)(worker("ScatterGather")(worker("ScatterAndGather", threshold=5)(p)))
    assert bag(worker("JoinQuery4")(pairs)) == [("1", "a"), ("1", "c")]
    assert worker("Cleaner", names=["dest"])(df).columns == [c for c in df.columns if not c.startswith("to_")]
    assert len(WORKERS) == 14


def test_missing_keys(spark):
    df = tx(spark, usd("-a", "2-b"))
    with pytest.raises(Exception, match="empty from_bank"):
        rows.checked(df, ["from_bank"]).collect()


def test_csv(spark, tmp_path):
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    (tmp_path / "good.csv").write_text(head + '2022/09/01 00:00,00410,"a,""b",000,c,1.5,Euro,12345678.25,US Dollar,Wire,1\n')
    row = tables.read_transactions(spark, str(tmp_path / "good.csv")).first()
    assert (row.from_bank, row.from_account, row.to_bank, row.amount_paid, row.is_laundering) == ("410", 'a,"b', "0", 12345678.25, True)
    for k, bad in enumerate(["2022/09/01 00:00,1,a,2,c,abc,Euro,1,US Dollar,Wire,1\n", "2022/09/01 00:00,1,a\n", "2022/09/01 00:00,1,a,2,c,1,Euro,1,US Dollar,Wire,maybe\n"]):
        (tmp_path / f"bad{k}.csv").write_text(head + bad)
        with pytest.raises(Exception):
            tables.read_transactions(spark, str(tmp_path / f"bad{k}.csv")).collect()
    (tmp_path / "acc.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nB,007,1,2,E\n")
    assert tables.read_accounts(spark, str(tmp_path / "acc.csv")).first().bank_id == "007"
    sinks.write_csv(spark.createDataFrame([(1.23e13, "x")], "a double, b string"), str(tmp_path / "out"), single=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().a == "12300000000000"


def test_run_writes_five_results(spark, tmp_path):
    from tidewell import __main__

    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    (tmp_path / "t.csv").write_text(head + "2022/09/01 00:00,01,a,2,c,1,US Dollar,0.0000001,US Dollar,Wire,0\n" * 2)
    (tmp_path / "a.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nB,1,1,2,E\n")
    (tmp_path / "p.json").write_text('{"threshold": 2}')
    __main__.main(["--transactions", f"{tmp_path}/t.csv", "--accounts", f"{tmp_path}/a.csv", "--output", f"{tmp_path}/out", "--parameters", f"{tmp_path}/p.json"])
    got = {n: spark.read.csv(f"{tmp_path}/out/query{n}.csv", header=True) for n in range(1, 6)}
    assert bag(got[1]) == [("1", "a", "2", "c", "0.0000001")] * 2
    assert bag(got[2]) == [("1", "a", "B", "0.0000001")]
    assert bag(got[5]) == [("2",)] and got[4].count() == 0


def test_differences(spark):
    one = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    two = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    assert bag(sinks.differences(one, two)) == [(1, "left"), (3, "right")]
    assert bag(sinks.differences(one, one)) == []


def test_plans_push_down(spark):
    d = "/root/testdata/sf0.001"
    plan = five.q1(tables.sample_transactions(spark, d), P)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(value,50.0)" in plan and "Python" not in plan
    assert "event_id" in plan and "c_mktsegment" not in plan
    pruned = graph.pairs(five.q4_edges(tables.sample_transactions(spark, d), P), 3)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in pruned and "CartesianProduct" not in pruned
