"""Streams kept up to date, clients' markers, ids, delivery, staging, layouts and verification, step by step."""

import shutil
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewell import __main__ as command
from tidewell import catalog
from tidewell import catalog_served as served
from tidewell.functions.ids import derived_id, source_id
from tidewell.operators import graph
from tidewell.params import QueryParams
from tidewell.plans import five
from tidewell.sources import counts, files, sinks, staging, tables, verify
from tidewell.streaming import bridges, clients, delivery, names
from tidewell.streaming.logs import Logs

TX = "timestamp string, from_bank string, from_account string, to_bank string, to_account string, amount_paid double, payment_currency string, payment_format string"
P = QueryParams(threshold=2)


def tx(spark, edges, amount=10.0, day="2022/09/02", **more):
    return spark.createDataFrame([(day, "1", a, "2" if b.startswith("v") else "1", b, amount, "US Dollar", "Wire") if not a.startswith("v") else (day, "2", a, "1", b, amount, "US Dollar", "Wire") for a, b in edges], TX).withColumns({k: F.lit(v) for k, v in more.items()})


def bag(df):
    return sorted(map(str, map(tuple, df.collect())))


def stream_of(spark, folder, df, k):
    """A batch put into a folder, and the folder as a stream of one file a batch."""
    df.coalesce(1).write.parquet(f"{folder}/{k:03}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


BATCHES = [
    [("a", "v1"), ("v1", "c"), ("a", "v1")], [("a", "v2"), ("x", "v1")], [("v2", "c"), ("v1", "d")], [("x", "v2"), ("v2", "d"), ("a", "v3"), ("v3", "a")],
    [("v1", "a"), ("x", "v3"), ("c", "v1")], [("v3", "e"), ("v1", "e")],
]


@pytest.mark.parametrize("p", [P, replace(P, threshold=1, exclude_cycles=True, tenant_cols=("client_id",))])
def test_fourth_analysis_after_each_batch(spark, tmp_path, monkeypatch, p):
    """After each batch the result is that of all rows so far, also over added-up logs and a batch that was cut off."""
    monkeypatch.setattr(bridges, "FOLD_EVERY", 3)
    folder, state, seen = str(tmp_path / "logs"), str(tmp_path / "state"), None
    for k, edges in enumerate(BATCHES):
        batch = tx(spark, edges, client_id="c1" if k % 2 else "c2") if p.tenant_cols else tx(spark, edges)
        batch = batch.union(tx(spark, [("q", "v1"), ("v1", "q")], day="2022/10/01", **({"client_id": "c1"} if p.tenant_cols else {})))
        stream = stream_of(spark, tmp_path / "in", batch, k)
        if k == 4:  # cut off after its edges: nothing of it counts, and it is taken again
            was, step = bag(bridges.accounts(spark, folder, p)), Logs.commit
            monkeypatch.setattr(Logs, "commit", lambda *_: 1 / 0)
            with pytest.raises(Exception):
                bridges.follow(stream, folder, state, p)
            monkeypatch.setattr(Logs, "commit", step)
            assert bag(bridges.accounts(spark, folder, p)) == was
        bridges.follow(stream, folder, state, p)
        seen = batch if seen is None else seen.union(batch)
        assert bag(bridges.accounts(spark, folder, p)) == bag(five.q4(seen, p))
        if k == 2:  # as if Spark had not noted the batch that it had just added up
            shutil.rmtree(f"{state}/commits")
            bridges.follow(stream, folder, state, p)
            assert bag(bridges.accounts(spark, folder, p)) == bag(five.q4(seen, p))
    assert len(Logs(spark, folder).numbers("pairs")) < 3


def test_fourth_analysis_takes_transactions_back(spark, tmp_path):
    """Accounts enter at the threshold and leave below it; an edge stays while one of its transactions does."""
    folder, state = str(tmp_path / "logs"), str(tmp_path / "state")
    path = [("a", "v1"), ("v1", "c"), ("a", "v2"), ("v2", "c"), ("a", "v2")]
    for k, (edges, weight, want) in enumerate([(path, 1, 2), ([("a", "v2")], -1, 2), ([("a", "v2")], -1, 0), ([("a", "v3"), ("v3", "c")], 1, 2), ([("v1", "c")], -1, 0)]):
        stream = stream_of(spark, tmp_path / "in", tx(spark, edges, w=weight), k)
        bridges.follow(stream, folder, state, P, weight="w")
        assert bridges.accounts(spark, folder, P).count() == want


def test_fourth_analysis_joins_changes_only(spark, tmp_path):
    folder, state = str(tmp_path / "logs"), str(tmp_path / "state")
    fan = [(f"s{k}", f"v{j}") for k in range(20) for j in range(4)] + [(f"v{j}", f"t{k}") for k in range(20) for j in range(4)]
    for k, edges in enumerate([fan, [("s1", "v9")]]):
        bridges.follow(stream_of(spark, tmp_path / "in", tx(spark, edges), k), folder, state, P)
    sizes = [spark.read.parquet(f"{folder}/{name}/batch=1").count() for name in ("edges", "first", "second", "pairs")]
    assert sizes == [1, 1, 0, 0]


def test_streams_grow_in_files_not_in_batches(spark, monkeypatch):
    """More rows make more files of the same size; a batch takes several, and all rows arrive."""
    monkeypatch.setattr(catalog, "FILE_ROWS", 50, raising=False)
    stream, sizes = served.as_stream(spark.range(1000).withColumn("odd", F.col("id") % 2)), []
    folder = served.scratch(spark, "state")
    stream.writeStream.foreachBatch(lambda df, _: sizes.append([r.n for r in df.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()])).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    assert [len(x) for x in sizes] == [5] * 4 and sum(map(sum, sizes)) == 1000 and max(map(max, sizes)) < 100


def marked(spark, *marks):
    return spark.createDataFrame([(c, f"{c}{kind}", kind, n) for c, kind, n in marks], "client_id string, msg_id string, kind string, expected long")


def sent(spark, client, rows_):
    """``rows_``: (number, day, amount, format)."""
    made = [(day, "1", "a", "2", "b", amount, "US Dollar", form, client, f"{client}{n}", "tx", None) for n, day, amount, form in rows_]
    return spark.createDataFrame(made, TX + ", client_id string, msg_id string, kind string, expected long")


EARLY, LATE = "2022/09/03", "2022/09/10"


def test_third_analysis_by_client(spark, tmp_path):
    """Rows wait for their client's averages, then flow; markers may come before the rows they count; restarts change nothing."""
    folder, state = str(tmp_path / "logs"), str(tmp_path / "state")
    empty = marked(spark, ("a", "end", 0)).where("false")
    steps = [
        sent(spark, "a", [(1, LATE, 0.5, "Wire"), (2, EARLY, 100.0, "Wire")]),
        marked(spark, ("a", "window1", 2), ("b", "abort", None)),
        sent(spark, "b", [(1, EARLY, 100.0, "Wire"), (2, LATE, 0.1, "Wire")]),
        sent(spark, "c", [(1, EARLY, 100.0, "Wire"), (2, LATE, 0.1, "Wire"), (3, LATE, 5.0, "Wire")]),
        sent(spark, "a", [(3, EARLY, 60.0, "Wire"), (4, EARLY, 1.0, "ACH")]),
        sent(spark, "a", [(5, LATE, 0.79, "Wire"), (6, LATE, 0.81, "Wire"), (7, LATE, 0.001, "ACH"), (8, LATE, 0.001, "Cheque")]),
        marked(spark, ("a", "end", 8), ("c", "end", 4)),
        sent(spark, "c", [(4, LATE, 0.2, "Wire")]),
        sent(spark, "a", [(9, LATE, 0.0, "Wire")]),
    ]
    want = [[], [], [], [], [0.5], [0.5, 0.001, 0.79], [0.5, 0.001, 0.79], [0.5, 0.001, 0.79, 0.1, 0.2], [0.5, 0.001, 0.79, 0.1, 0.2]]
    for k, step in enumerate(steps):
        stream = stream_of(spark, tmp_path / "in", step.unionByName(empty, allowMissingColumns=True).select(*sent(spark, "a", []).columns) if "timestamp" in step.columns else sent(spark, "a", []).unionByName(step, allowMissingColumns=True), k)
        if k in (1, 5):
            commit, Logs.commit = Logs.commit, lambda *_: 1 / 0
            try:
                with pytest.raises(Exception):
                    clients.follow(stream, folder, state, P)
            finally:
                Logs.commit = commit
        clients.follow(stream, folder, state, P)
        assert sorted(r.amount_paid for r in clients.results(spark, folder).collect()) == sorted(want[k]), k
    assert {r.log: r.n for r in clients.held(spark, folder).collect()} == dict.fromkeys(["marks", "counts", "sums", "backlog", "ready"], 0)


def test_abort_leaves_other_clients_alone(spark, tmp_path):
    folder, state = str(tmp_path / "logs"), str(tmp_path / "state")
    both = lambda: sent(spark, "a", [(1, EARLY, 100.0, "Wire"), (2, LATE, 0.5, "Wire")]).union(sent(spark, "b", [(1, EARLY, 100.0, "Wire"), (2, LATE, 0.5, "Wire")]))
    steps = [both().unionByName(marked(spark, ("a", "window1", 1), ("b", "window1", 1)), allowMissingColumns=True), both().where("false").unionByName(marked(spark, ("b", "abort", None)), allowMissingColumns=True)]
    left = []
    for k, step in enumerate(steps):
        clients.follow(stream_of(spark, tmp_path / "in", step, k), folder, state, P)
        left.append(sorted(r.client_id for r in clients.results(spark, folder).collect()))
    assert left == [["a", "b"], ["a"]]
    assert spark.read.parquet(f"{folder}/results").where("client_id = 'b'").count() == 0


def test_delivery_adds_no_row_twice(spark, tmp_path, monkeypatch):
    known = spark.createDataFrame([("a",), ("b",)], "client_id string")
    one = lambda *ids: spark.createDataFrame([(c, m, f"{c}{m}") for c, m in ids], "client_id string, msg_id string, value string")
    folder, got = str(tmp_path / "out"), lambda: sorted(r.value for r in delivery.delivered(spark, folder).collect())
    stream = stream_of(spark, tmp_path / "in", one(("a", "1"), ("a", "1"), ("z", "1")), 0)
    delivery.deliver(stream, known, folder, f"{tmp_path}/s1")
    assert got() == ["a1"]
    stream = stream_of(spark, tmp_path / "in", one(("a", "1"), ("b", "1"), ("a", "2")), 1)
    monkeypatch.setattr(files, "put_text", lambda *_, **__: 1 / 0)  # cut off before it counts
    with pytest.raises(Exception):
        delivery.deliver(stream, known, folder, f"{tmp_path}/s1")
    monkeypatch.undo()
    assert got() == ["a1"]
    for state in ("s1", "s2", "s1"):
        delivery.deliver(stream, known, folder, f"{tmp_path}/{state}")
        assert got() == ["a1", "a2", "b1"]
    assert not files.put_text(spark, f"{folder}/manifests/0.txt", "other", replace=False)


def test_ids_do_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", F.concat(F.lit("é"), F.col("id") % 7).alias("c"))
    ids = lambda d: d.select("id", source_id(F.col("c"), 0, F.col("id")).alias("s")).select("id", "s", derived_id(F.col("s"), "x", F.col("id") % 3).alias("d"))
    assert bag(ids(df.repartition(1))) == bag(ids(df.repartition(13, "c")))
    assert ids(df).select("s").union(ids(df).select("d")).distinct().count() == 1000
    lone = spark.range(1).select(source_id(F.lit("ab"), 0, F.lit(1)), source_id(F.lit("a"), 0, F.lit(1)), source_id(F.lit("a"), 1, F.lit(1)), derived_id(F.lit("00" * 16), "ab", 1), derived_id(F.lit("00" * 16), "a", 1)).first()
    assert len(set(lone)) == 5 and all(len(x) == 32 for x in lone)


@pytest.mark.parametrize("order", ["tx first", "names first", "mixed"])
def test_names_may_come_late(spark, tmp_path, order):
    sides = {"tx": [[("m1", "1"), ("m2", "2")], [("m3", "1"), ("m4", "9")]], "names": [[("1", "beta"), ("2", "gamma")], [("1", "alpha"), ("3", "delta")]]}
    kinds = {"tx": "msg_id string, from_bank string", "names": "bank_id string, bank_name string"}
    turns = {"tx first": "tx tx names names", "names first": "names names tx tx", "mixed": "names tx names tx"}[order].split()
    put = {side: iter(batches) for side, batches in sides.items()}
    streams = {}
    for side, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{side}/none")
        streams[side] = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{side}")
    for k, side in enumerate(turns):
        spark.createDataFrame(next(put[side]), kinds[side]).write.parquet(f"{tmp_path}/{side}/{k}")
        names.follow(streams["tx"], streams["names"], f"{tmp_path}/out", f"{tmp_path}/state")
    assert bag(names.named(spark, f"{tmp_path}/out").select("msg_id", "bank_name")) == ["('m1', 'alpha')", "('m2', 'gamma')", "('m3', 'alpha')"]


def test_named_transactions_lie_on_disk_once(spark, tmp_path):
    """Neither a state of all transactions nor a copy of them for each name; a message that comes twice is named once."""
    sides = {"tx": ([(f"m{k % 40}", str(k % 5)) for k in range(50)], "msg_id string, from_bank string"), "names": ([(str(b), f"{n}{b}") for b in range(4) for n in "cab"], "bank_id string, bank_name string")}
    for side, (made, kind) in sides.items():
        spark.createDataFrame(made, kind).repartition(3).write.parquet(f"{tmp_path}/{side}")
    streams = [spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{side}") for side, (_, kind) in sides.items()]
    for _ in range(2):
        names.follow(*streams, f"{tmp_path}/out", f"{tmp_path}/state")
    assert not list((tmp_path / "state").rglob("*.delta"))
    kept = [spark.read.parquet(str(f)) for f in (tmp_path / "out").rglob("*.parquet")]
    assert sum(df.count() for df in kept if "msg_id" in df.columns) == 50
    assert sorted(map(tuple, names.named(spark, f"{tmp_path}/out").collect())) == sorted((f"m{k}", str(k % 5), f"a{k % 5}") for k in range(40) if k % 5 < 4)


HEADER = ",".join(tables.TRANSACTIONS.fieldNames())
LINES = {
    None: ["2022/09/02 10:00,007,a,2,b,1.5,Euro,12.5,US Dollar,Wire,0", "2022/09/12 10:00,7,a,2,b,1.5,Euro,0.01,US Dollar,Wire,TRUE", '2022/09/02 10:00,7,"x, ""y""",2,b,1.5,Euro,3.5,Euro,ACH,1'],
    "columns": ["2022/09/02 10:00,7,a", "2022/09/02 10:00,7,a,2,b,1.5,Euro,12.5,US Dollar,Wire,0,more"],
    "amount": ["2022/09/02 10:00,7,a,2,b,abc,Euro,12.5,US Dollar,Wire,0", "2022/09/02 10:00,7,a,2,b,1.0,Euro,,US Dollar,Wire,0"],
    "flag": ["2022/09/02 10:00,7,a,2,b,1.5,Euro,12.5,US Dollar,Wire,maybe"],
    "key": ["2022/09/02 10:00,7,,2,b,1.5,Euro,12.5,US Dollar,Wire,0"],
}


@pytest.fixture
def csv(tmp_path):
    (tmp_path / "tx").mkdir()
    (tmp_path / "tx" / "1.csv").write_text("\n".join([HEADER, *(x for own in LINES.values() for x in own)]) + "\n")
    (tmp_path / "accounts.csv").write_text("Bank Name,Bank ID,Account,Entity ID,Entity Name\nSeven,7,a,e,n\n")
    return tmp_path


def test_bad_rows_lie_aside(spark, csv):
    of = staging.stage(spark, str(csv / "tx"), str(csv / "staged"))
    assert of.counts == {"read": 9, "good": 3, "columns": 2, "amount": 2, "flag": 1, "key": 1}
    aside = {(r.reason, r.record) for r in of.set_aside().collect()}
    assert {reason for reason, _ in aside} == set(staging.REASONS)
    assert all((reason, line) in aside for reason, own in LINES.items() for line in own if reason == "columns")
    assert all(r.file.endswith("1.csv") for r in of.set_aside().collect())
    good = of.rows().orderBy("amount_paid").collect()
    assert [(r.from_bank, r.from_account, r.is_laundering) for r in good] == [("7", "a", True), ("7", 'x, "y"', True), ("7", "a", False)]
    with pytest.raises(counts.CountMismatch):
        counts.reconcile("x", 3, {"good": 2})


def test_files_to_stage_grow_in_number_not_in_size(spark, monkeypatch):
    """Lines that cannot be taken are written by the tasks that make them, not by one; each file has its header."""
    d = "/root/testdata/sf0.001"
    n, made = served.tx(spark, d).count(), served.tx(spark, d).repartition(5)
    monkeypatch.setattr(catalog, "FILE_ROWS", 50, raising=False)
    monkeypatch.setattr(served, "tx", lambda *_: made)
    path = served._with_bad_rows(spark, d)
    held = [f.read_text().splitlines() for f in Path(path).glob("*.csv")]
    assert all(lines[0] == HEADER for lines in held) and max(map(len, held)) < 100 < n
    assert len([lines for lines in held if any(x == "too,few,columns" or "abc" in x for x in lines)]) > 1
    of = staging.stage(spark, path, served.scratch(spark, "staged"))
    assert of.counts["good"] == n and min(of.counts.values()) > 0 and of.counts["read"] == sum(map(len, held)) - len(held)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_five_results_from_one_scan(spark, csv):
    """The files are parsed once; each analysis reads the folders of its route and days."""
    of = staging.stage(spark, str(csv / "tx"), str(csv / "staged"))
    results = five.run_staged(of, tables.read_accounts(spark, str(csv / "accounts.csv")), tables.rates(spark), QueryParams())
    assert not any("csv" in plan(results[q]).lower().replace("accounts.csv", "") for q in ("q1", "q3", "q4", "q5"))
    for q in ("q1", "q3", "q4"):
        assert "(route#" in plan(results[q]) and "= usd" in plan(results[q])
    assert "day#" in plan(results["q4"]).split("PartitionFilters: [")[1].split("]")[0]
    strict = tables.read_transactions(spark, str(csv / "tx"))
    assert [r["n"] for r in of.rows().agg(F.count("*").alias("n")).collect()] == [3]
    with pytest.raises(Exception):
        strict.collect()
    assert {q: df.count() for q, df in results.items()} == {"q1": 2, "q2": 1, "q3": 1, "q4": 0, "q5": 1}


def test_results_appear_together(spark, csv):
    out = str(csv / "out")
    report = command.run(spark, str(csv / "tx"), str(csv / "accounts.csv"), out)
    assert report == {"read": 9, "good": 3, "columns": 2, "amount": 2, "flag": 1, "key": 1, "q1": 2, "q2": 1, "q3": 1, "q4": 0, "q5": 1}
    assert spark.read.option("header", True).csv(f"{out}.bad").count() == 6
    before = spark.read.text(f"{out}/query1.csv").count()
    one = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(Exception):
        sinks.write_together({"q1": one, "q2": one.select(F.raise_error(F.lit("no")).cast("int").alias("x"))}, out)
    assert spark.read.text(f"{out}/query1.csv").count() == before
    assert sorted(n for n in files.listed(spark, str(csv)) if n.startswith("out")) == ["out", "out.bad"]
    with pytest.raises(ValueError):
        command.run(spark, str(csv / "tx"), str(csv / "accounts.csv"), out, strict=True)
    assert verify.verify(spark, out, out) == []
    shutil.copytree(out, f"{out}2")
    sinks.write_csv(spark.read.option("header", True).csv(f"{out}/query1.csv").limit(1), f"{out}2/query1.csv")
    shutil.rmtree(f"{out}2/query5.csv")
    wrong = verify.verify(spark, out, f"{out}2")
    assert len(wrong) == 2 and wrong[0].startswith("query1.csv: 1 missing, 0 extra") and wrong[1] == "query5.csv: not there"


def test_verify_compares_bags(spark):
    made = [(k % 5, None if k % 3 else "x", k / 7) for k in range(200)]
    df = lambda rows_: spark.createDataFrame(rows_, "a int, b string, c double")
    assert verify.compare(df(made), df(made[::-1]).withColumn("c", F.col("c") + 1e-9)).count() == 0
    found = verify.compare(df(made), df(made[1:] + made[-1:]), buckets=8)
    assert sorted(r.side for r in found.collect()) == ["extra", "missing"]
    with pytest.raises(ValueError):
        verify.compare(df(made), df(made).drop("a"))


def test_hops_laid_out_do_not_move(spark, tmp_path):
    edges = tx(spark, [(f"s{k}", f"v{j}") for k in range(9) for j in range(3)] + [(f"v{j}", f"t{k}") for k in range(9) for j in range(3)]).select(*graph.EDGE)
    graph.lay_out(edges, "laid_out_test", str(tmp_path / "edges"), buckets=8)
    hops = graph.two_hops(spark, "laid_out_test")
    assert hops.count() == 243 and "Exchange" not in plan(hops) and "Join" in plan(hops)
    assert bag(graph.laid_out_pairs(spark, "laid_out_test", 3)) == bag(graph.pairs(edges, 3)) != []


def test_hot_bridges_alone_are_split(spark):
    """A bridge of 30 sources and 30 sinks goes to several tasks, one of two by two to one; the pairs stay the same."""
    edges = tx(spark, [(f"s{k}", "v1") for k in range(30)] + [("v1", f"t{k}") for k in range(30)] + [("s1", "v2"), ("s2", "v2"), ("v2", "t1"), ("v2", "t2")]).select(*graph.EDGE)
    via = ["via_bank", "via_account"]
    first = edges.where("to_account like 'v%'").select("from_bank", "from_account", F.col("to_bank").alias("via_bank"), F.col("to_account").alias("via_account"))
    second = edges.where("from_account like 'v%'").select(F.col("from_bank").alias("via_bank"), F.col("from_account").alias("via_account"), "to_bank", "to_account")
    dealt, sent = graph.split_bridges(first, second, via, 100)
    sizes = {(r.via_account, r["_salt"]): r.n for r in dealt.groupBy("via_account", "_salt").agg(F.count("*").alias("n")).collect()}
    assert len([k for k in sizes if k[0] == "v1"]) > 3 and [k for k in sizes if k[0] == "v2"] == [("v2", 0)]
    assert sent.where("via_account = 'v1'").count() == 270 and sent.where("via_account = 'v2'").count() == 2
    assert bag(graph.pairs(edges, 1, most_met=100)) == bag(graph.pairs(edges, 1))


@pytest.mark.parametrize("name", ["q2", "q3", "q4", "q5"])
def test_tenants_are_kept_apart(spark, name):
    """Each client's result is that of its own rows; an edge or average of one never helps another."""
    d, p = "/root/testdata/sf0.001", replace(served.LOWER, tenant_cols=("client_id",), threshold=1, multiplier=0.1)
    all_rows = served.tx(spark, d).withColumn("client_id", F.when(F.col("from_account").cast("long") % 3 == 0, "a").otherwise("b"))
    accounts, rates = tables.sample_accounts(spark, d), tables.sample_rates(spark)
    build = {"q2": lambda t, p: five.q2(t, accounts, p), "q3": five.q3, "q4": five.q4, "q5": lambda t, p: five.q5(t, rates, p)}[name]
    own = replace(p, tenant_cols=())
    want = [str((c, *r)) for c in "ab" for r in build(all_rows.where(F.col("client_id") == c), own).collect()]
    assert bag(build(all_rows, p)) == sorted(want) != []
