import shutil

from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.sources import tables
from tidewell.streaming import runs


def test_restart_takes_each_row_once(spark, tmp_path):
    one = lambda k: spark.createDataFrame([(k, f"m{k}")], "a int, b string")
    one(1).write.parquet(f"{tmp_path}/in/1")
    read = lambda: spark.readStream.schema("a int, b string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    for k in (2, 3):
        runs.drain(runs.deduplicated(runs.numbered(read().withColumn("n", F.col("a")), "c", "n")), f"{tmp_path}/out", f"{tmp_path}/state")
        one(k).write.parquet(f"{tmp_path}/in/{k}")
        one(1).write.parquet(f"{tmp_path}/in/again{k}")
    runs.drain(runs.deduplicated(runs.numbered(read().withColumn("n", F.col("a")), "c", "n")), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.a for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_equal_transactions_all_arrive(spark, monkeypatch):
    rows = [("t", "1", 5.0), ("t", "1", 5.0), ("t", "2", 5.0)]
    monkeypatch.setattr(catalog, "tx", lambda s, d: s.createDataFrame(rows, "timestamp string, from_bank string, amount_paid double"))
    assert sorted(map(tuple, catalog.queries()["stream_dedup"](spark, "").collect())) == rows


def test_ingest_numbers_by_file_and_position(spark, tmp_path):
    """Equal rows of a file all arrive; a batch that is taken again changes nothing; new files go on."""
    (tmp_path / "in").mkdir()
    put = lambda name, *lines: (tmp_path / "in" / name).write_text("\n".join(["a,b,c,d,e", *lines]) + "\n")
    put("1.csv", "x,1,a,e,n", "x,1,a,e,n", "y,2,a,e,n")
    run = lambda: runs.ingest(tables.stream_accounts(spark, str(tmp_path / "in")), "me", f"{tmp_path}/out", f"{tmp_path}/state")
    got = lambda: runs.ingested(spark, f"{tmp_path}/out", tables.stream_accounts(spark, str(tmp_path / "in")))
    run()
    assert sorted(r.bank_name for r in got().collect()) == ["x", "x", "y"]
    shutil.rmtree(tmp_path / "state" / "commits")  # as if the run had died before it noted the batch
    put("2.csv", "x,1,a,e,n")
    run()
    rows = got().collect()
    assert sorted(r.bank_name for r in rows) == ["x", "x", "x", "y"]
    assert len({r.msg_id for r in rows}) == 4 and {r.client_id for r in rows} == {"me"}


def test_latest_keeps_a_whole_result(spark, tmp_path):
    one = lambda k: spark.createDataFrame([("a", k)], "g string, n int").write.parquet(f"{tmp_path}/in/{k}")
    for k in (1, 2, 3):
        one(k)
        stream = spark.readStream.schema("g string, n int").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        runs.latest(stream.groupBy("g").agg(F.sum("n").alias("n")), f"{tmp_path}/out", f"{tmp_path}/state")
        assert [tuple(r) for r in runs.newest(spark, f"{tmp_path}/out").collect()] == [("a", k * (k + 1) // 2)]
