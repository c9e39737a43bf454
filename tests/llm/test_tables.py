"""Archives, mixing, neighbours and the pipeline against brute force."""

import base64
import gzip
import hashlib
import io
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import mixing, neighbours, warc


def test_archives_round_trip(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, "é\r\n\r\nWARC/1.1"), (4, "u\nv", None), (5, "u", ""), (6, "u", "x" * 400_000), (6, "u", "x" * 400_000), (None, "u", "same"), (None, "u", "lone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    whole, index = warc.archive(df)
    got = warc.read_back(index, warc.new_dir(spark, "warc")).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    newest = defaultdict(list)
    for p, _, h in rows:
        if p is not None:
            newest[h or ""].append(p)
    want = []
    for p, _, h in rows:
        top = max(newest[h or ""], default=None)
        again = top is not None and p != top
        want.append((p, len((h or "").encode()), digest(h), "revisit" if again else "response", top if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    for r in index.collect():
        with open(r.archive, "rb") as file:
            file.seek(r.offset)
            one = gzip.GzipFile(fileobj=io.BytesIO(file.read(r.length))).read()
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
        with open(r.archive.removesuffix(".warc.gz") + ".index") as side:
            assert f"{r.offset}\t{r.length}\t{'-' if r.page_id is None else r.page_id}\t{r.record_type}\n" in side
    assert sum(r.n for r in whole.collect()) == len(rows)
    small = warc.plan(df, least_bytes=5)
    assert small.where("revisit").count() == 0


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    _, index = warc.archive(none)
    assert warc.read_back(index, warc.new_dir(spark, "warc")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 4099])
def test_permutations(spark, n):
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("x")).alias("a"), mixing.permuted(F.col("id"), F.lit(n), F.lit("y")).alias("b"))
    rows = df.collect()
    assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(n))
    assert n < 100 or sum(r.a == r.b for r in rows) < n / 20


def fair(sizes):
    """Targets by handing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 2 * sizes[s]]
        for s in over or list(open_):
            target[s] = 2.0 * sizes[s] if over else unit * weight[s]
            left -= target[s] if over else 0
            open_.discard(s)
    return target


def test_places_of_permutations(spark):
    for n in (1, 5, 777):
        there = mixing.permuted(F.col("id"), F.lit(n), F.lit("x"))
        assert all(r.id == r.back for r in spark.range(n).select("id", mixing.place_of(there, F.lit(n), F.lit("x")).alias("back")).collect())


def test_binomial_draws(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        got = np.array([r.k for r in spark.range(600).select(mixing.ones(F.lit(n).cast("long"), F.col("id")).alias("k")).collect()])
        assert got.min() >= 0 and got.max() <= n
        assert abs(got.mean() - n / 2) <= 4 * (n / 4 / 600) ** 0.5 and abs(got.var() - n / 4) <= 0.25 * n


def packed_rows(df):
    sizes = mixing.measured(df)
    sources = mixing.targets(sizes)
    return sizes, sources, mixing.packed(sizes, sources)


def test_mixing_meets_targets(spark, docs, odd_docs):
    many = [(k, " ".join(["w"] * n), s) for k, (n, s) in enumerate([(10, "a"), (40, "b"), (7, "b"), (127, "c"), (128, "d"), (129, "e"), (5000, "f"), (1, None), (0, "g")] + [(40, f"s{k}") for k in range(12)])]
    for df in (docs, odd_docs, spark.createDataFrame(many, "doc_id long, text string, source string").repartition(3)):
        sizes, sources, rows = packed_rows(df)
        of = {r.source: r for r in sources.collect()}
        want = fair({s: r.source_size for s, r in of.items()})
        assert {s: round(r.target, 6) for s, r in of.items()} == {s: round(t, 6) for s, t in want.items()}
        taken, by_row = defaultdict(int), defaultdict(int)
        for p in rows.join(sizes, "rid").collect():
            taken[p.source] += p.words
            by_row[p.rid] += p.words
        for s, t in want.items():
            assert abs(taken[s] - t) <= 0.5
        size = {r.rid: r.size for r in sizes.collect()}
        assert all(n <= 2 * size[rid] for rid, n in by_row.items())


def test_mixing_takes_what_its_slots_say(docs, monkeypatch):
    """``taken`` from the slots, by hand: every word of every block that a slot takes is a word of one document."""
    monkeypatch.setattr(mixing, "BLOCK", 32)
    monkeypatch.setattr(mixing, "SHARD", 64)
    sizes, sources, rows = packed_rows(docs)
    slots = mixing.mix(sources).collect()
    owner = defaultdict(dict)
    for p in mixing.parts(sizes, sources).collect():
        for j in range(p.words):
            owner[p.rank, p.block][p.offset + j] = (p.rid, p.first + j)
    want, passes = defaultdict(int), defaultdict(list)
    for s in slots:
        passes[s.rank, s["pass"]].append(s.block)
        for at, (rid, _) in owner[s.rank, s.block].items():
            want[rid] += at < s.slot_words
    got = defaultdict(int)
    for p in rows.collect():
        got[p.rid] += p.words
    assert dict(got) == {rid: n for rid, n in want.items() if n}
    assert all(len(set(blocks)) == len(blocks) for blocks in passes.values())  # no block again before all others
    every = {r.rid: r.size for r in sizes.collect() if r.size}
    for key, own in owner.items():
        assert sorted(own) == list(range(len(own)))
    assert sum(map(len, owner.values())) == sum(every.values())
    for s in sources.collect():
        numbers = sorted(x.slot for x in slots if x.rank == s.rank)
        assert numbers == list(range(s.slots))


def test_mixing_shards_and_reruns(docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 16)
    monkeypatch.setattr(mixing, "FAN_BITS", 3)
    monkeypatch.setattr(mixing, "DRAW_SLOTS", 50)
    sources = mixing.targets(mixing.measured(docs))
    slots = mixing.mix(sources).collect()
    again = mixing.mix(mixing.targets(mixing.measured(docs.repartition(5)))).collect()
    assert sorted(slots) == sorted(again)
    assert len(slots) == sum(r.slots for r in sources.collect())
    per, shards = defaultdict(int), 1 << (-(-len(slots) // 16) - 1).bit_length()
    for s in slots:
        per[s.shard] += 1
    mean = len(slots) / shards
    assert set(per) <= set(range(shards)) and max(per.values()) < mean + 6 * mean**0.5
    one = sorted(tuple(r) for r in mixing.mixed(docs).collect())
    assert one == sorted(tuple(r) for r in mixing.mixed(docs.repartition(6)).collect())
    sizes, _, rows = packed_rows(docs)
    assert sum(len(r[1].split()) for r in one) == sum(r.words for r in rows.collect())


def test_mixing_keeps_each_rows_own_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "s", k // 2) for k in range(6)] + [(2, "d e", "t", 9)], "doc_id long, text string, source string, more long")
    got = mixing.mixed(df).collect()
    taken = {r.doc_id: 0 for r in got}
    for r in got:
        taken[r.doc_id] += len(r.text.split())
    assert {r.more for r in got if r.doc_id == 1} == {0, 1, 2} and all(r.more == 9 for r in got if r.doc_id == 2)


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hit = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = x @ x[k]
        score[k] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        own = got[ids[k]]
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(abs(r.score - score[list(ids).index(r.vec_id)]) < 1e-12 for r in own)
        hit, total = hit + len(set(best) & {r.vec_id for r in own}), total + 20
    assert hit >= 0.9 * total


def test_neighbours_of_few_and_of_spread_norms(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 400)
    rng = np.random.default_rng(3)
    frame = lambda x: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    few = neighbours.search(frame(rng.standard_normal((15, 64))), F.col("vec_id") >= 0).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(a, b) for a in range(15) for b in range(15) if a != b]
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:300] *= 2.0 ** rng.uniform(-1, 0, (300, 1))
    x[7] *= 10
    got = defaultdict(set)
    for r in neighbours.search(frame(x), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for k in range(0, 600, 20):
        score = x @ x[k]
        score[k] = -np.inf
        assert len(got[k]) == 20
        hit += len(got[k] & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.9 * 600


def brute_neighbours(rows, dim, asked):
    """Per asked row its id and the ids of its 20 nearest others; every row a candidate."""
    valid = [(i, np.array([*v, *[0.0] * (dim - len(v))])) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for k, (i, q) in enumerate(valid):
        if i is not None and asked(i):
            near = sorted((-(x * q).sum(), j is None, j or 0) for n, (j, x) in enumerate(valid) if n != k)[:20]
            out.append((i, tuple(None if none else j for _, none, j in near)))
    return sorted(out)


def test_neighbours_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 8)
    good = [(k, [1.0, 0.0, 0.0]) for k in range(0, 50)]  # ties: one hot bucket, spread over the shards
    rows = good + good[:5] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [float("nan"), 1.0, 1.0]), (160, [None, 1.0, 1.0]), (180, [float("inf"), 0.0, 0.0])]
    rows += [(200, [1.0]), (None, [2.0, 0.0, 0.0]), (220, []), (240, [1e-200, 1e-200, 0.0]), (260, [1e160, 0.0, 1.0]), (280, [1e-310, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("x")).repartition(3)
    got = defaultdict(list)
    for n, r in enumerate(neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank", "vec_id").collect()):
        got[r.query_id].append(r.vec_id)
    want = defaultdict(list)
    for i, near in brute_neighbours(rows, 3, lambda i: i % 20 == 0):
        want[i] += near
    assert {i: sorted(map(str, ids)) for i, ids in got.items()} == {i: sorted(map(str, ids)) for i, ids in want.items()}
    assert set(got) == {0, 20, 40, 200, 240, 260, 280}
    assert neighbours.search(df.where("vec_id < 0").repartition(3), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(df.where("vec_id in (0, 1)").dropDuplicates(["vec_id"]).repartition(4), F.col("vec_id") % 20 == 0).count() == 1
    assert neighbours.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0


def test_probes_come_in_order_and_once():
    for hashes, most in ((3, 27), (8, 500)):
        order = neighbours.template(hashes, 10_000)[:most]
        assert len({tuple(r) for r in order}) == len(order) == most
        assert not any(r[j] and r[2 * hashes - 1 - j] for r in order for j in range(hashes))
    one = neighbours.Functions(5, 3, tables=2)
    points = np.random.default_rng(1).standard_normal((4, 6))
    probed = one.probes(points, neighbours.template(3, 27))
    assert (probed[:, :, 0] == one.keys(points)).all()
    cells = np.floor(one.cells(points)).astype(int)
    for p in range(4):
        for t in range(2):
            with np.errstate(over="ignore"):
                around = {int(((cells[p, t] + np.array([a, b, c])) * one.mix[t]).sum() + one.salt[t]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)}
            assert set(probed[p, t].tolist()) == around


def test_neighbours_without_a_setting_that_finds_enough(spark, monkeypatch):
    """Where no number of projections and probes reaches the target, all rows are scored."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 100)
    monkeypatch.setattr(neighbours, "HASHES", (64,))
    monkeypatch.setattr(neighbours, "PROBES", 1)
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((240, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    kept = neighbours.settle(neighbours.valid(df, "vec_id", "embedding"))
    assert neighbours.fitted(kept, kept.where("vec_id % 20 = 0"), 8, 240, kept.agg(F.max("length")).first()[0], 20) is None
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert dict(got) == {i: list(near) for i, near in brute_neighbours(rows, 8, lambda i: i % 20 == 0)}


def test_neighbours_that_cluster_need_few_candidates(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((150, 16)), 40, axis=0) + 0.05 * rng.standard_normal((6000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.settle(neighbours.valid(df, "vec_id", "embedding"))
    top = rows.agg(F.max("length")).first()[0]
    hashes, probes = neighbours.fitted(rows, rows.where("vec_id % 20 = 0"), 16, 6000, top, 20)
    assert hashes > 4
    functions = neighbours.Functions(16, hashes)
    probed = functions.probes(neighbours.as_queries(x[::20]), neighbours.template(hashes, probes))
    keys = functions.keys(neighbours.as_points(x, np.log(np.linalg.norm(x, axis=1)), top))
    share = np.mean([(neighbours.min_rank(probed[k], keys, 10_000) < 10_000).mean() for k in range(len(probed))])
    assert share < 0.25


def test_pipeline_follows_its_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        counts.append(docs.count())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=str) == sorted(map(tuple, last.collect()), key=str)
    assert 0 < counts[1] < counts[0] < 200 and counts[2] == counts[1]
