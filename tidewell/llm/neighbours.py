"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Inner products become distances: with M the largest norm, a vector ``x`` is hashed as
``(x / M, sqrt(1 - |x|^2 / M^2))`` and a query as ``(q / |q|, 0)``; the nearest by
distance is then the one with the largest inner product. Norms are cut into ranges of
ratio ``RANGE``, each with an M of its own, so that a few long vectors do not push all others
to one distance; a query does not depend on M, so the ranges share the tables. Each of ``TABLES`` tables hashes
by a number of Gaussian projections, shifted and cut into cells of ``WIDTH``. A query looks
into its own bucket and into those around it, in the order of their estimated success: the
sum of squared distances from the query to the cell borders that the perturbation crosses,
least first. The order is the one of the borders' expected distances by rank, the same for
all queries; which borders have which rank is each query's own.

How many projections and probes: for a bounded sample of ``SAMPLE_QUERIES`` queries the nearest are
found exactly, and for each number of projections that is tried the fewest probes are taken that find ``TARGET`` of
these. The cheapest pair is used, by the share of ``SAMPLE_ROWS`` sampled rows that become
candidates and the number of probes. Clustered vectors so get many projections and few
candidates; directions that hardly cluster need a large share of all rows whatever the index.

The search: vectors are dealt to shards of about ``SHARD_ROWS`` by hash. A directory says which shards have
rows in a bucket, so a query goes to those shards alone where it has candidates. A task holds one shard's vectors and
streams the shard's queries past them: what the tables hold in a query's buckets is merged
and ranked again by the exact inner product of the original vectors, in double precision. So vectors
move once, and a hot bucket is spread over the shards. No candidate is dropped. A query that finds fewer than there are to be had,
``nearest`` or all others, is scored against all rows, in the same shards.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part; a vector shorter than the longest counts as if filled up with zeros; rows that share an id,
or have none, are separate rows, each a candidate of all others and, if asked, a query; ties go to the smaller id (null last);
norms are compared as logarithms, so tiny and huge components do no harm (a score that is no number
counts as the least); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import join_small, settle, table

TABLES, WIDTH = 6, 2.0
#: Numbers of projections that are tried; the most buckets probed in a table.
HASHES, PROBES = range(4, 26, 2), 2048
TARGET = 0.96
SAMPLE_QUERIES, SAMPLE_ROWS = 64, 512
#: What a probe costs, in candidates.
PROBE_COST = 4.0
NEAREST = 20
SEED = 11
RANGE = 2**0.25
SHARD_ROWS = 16_384
#: Queries that are scored against a shard at a time.
STEP = 64

INDEXED = "rid long, vec_id long, v array<double>, keys array<long>"
FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def template(hashes: int, count: int) -> np.ndarray:
    """The ``count`` likeliest perturbations, a row each: 1 for each border crossed, by its rank (nearest first)."""
    m = hashes
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    rows, heap = [np.zeros(2 * m, np.int64)], [(expected[0], (0,))]
    while heap and len(rows) < count:
        cost, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - j in chosen for j in chosen):  # the two borders of one cell
            rows.append(np.bincount(chosen, minlength=2 * m))
        last = chosen[-1]
        if last + 1 < 2 * m:
            more = cost + expected[last + 1]
            heapq.heappush(heap, (more, (*chosen, last + 1)))
            heapq.heappush(heap, (more - expected[last], (*chosen[:-1], last + 1)))
    return np.array(rows)


class Functions:
    """The projections of all tables for vectors of ``dim`` components and one more."""

    def __init__(self, dim: int, hashes: int, tables: int = TABLES, width: float = WIDTH):
        rng = np.random.default_rng(SEED)
        self.lines = rng.standard_normal((dim + 1, tables * hashes)) / width
        self.shift = rng.random((tables, hashes))
        self.mix = rng.integers(1, 1 << 62, (tables, hashes), dtype=np.int64) | 1
        self.salt = rng.integers(1, 1 << 62, tables, dtype=np.int64)

    def cells(self, points: np.ndarray) -> np.ndarray:
        """Where points fall in the tables' cells: (points, tables, hashes), with fractions."""
        return (points @ self.lines).reshape(len(points), *self.shift.shape) + self.shift

    def keys(self, points: np.ndarray) -> np.ndarray:
        """(points, tables): one number for the bucket that each table puts a point in."""
        with np.errstate(over="ignore"):
            return (np.floor(self.cells(points)).astype(np.int64) * self.mix).sum(-1) + self.salt

    def probes(self, points: np.ndarray, order: np.ndarray) -> np.ndarray:
        """(points, tables, probes): the buckets around each point, by the template ``order``."""
        cells = self.cells(points)
        whole = np.floor(cells)
        part = cells - whole
        rank = np.argsort(np.concatenate([part, 1 - part], -1), axis=-1)
        with np.errstate(over="ignore"):
            step = np.take_along_axis(np.broadcast_to(np.concatenate([-self.mix, self.mix], -1), rank.shape), rank, -1)
            base = (whole.astype(np.int64) * self.mix).sum(-1) + self.salt
            return base[..., None] + step @ order.T


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def as_points(x: np.ndarray, length: np.ndarray, top: float) -> np.ndarray:
    """Vectors as points of the unit sphere; ``length`` and ``top`` are logarithms of norms."""
    step = math.log(RANGE)
    longest = top - np.floor((top - length) / step) * step
    largest = np.abs(x).max(1, keepdims=True)
    x = x / largest * np.exp(np.log(largest[:, 0]) - longest)[:, None]
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])


def as_queries(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(rid, vec_id, v, length)``: the rows that take part; ``length`` is the logarithm of the norm."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("vec_id"), v.alias("v")).where("v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    largest = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("largest", largest)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("largest")) * (x / F.col("largest")))
    return rows.select("rid", "vec_id", "v", (F.log("largest") + F.log(square) / 2).alias("length"))


def fitted(rows: DataFrame, asked: DataFrame, dim: int, n: int, top: float, nearest: int) -> tuple[int, int] | None:
    """The numbers of projections and probes, from exact results of a bounded sample of queries; None if none finds ``TARGET`` of these."""
    by = F.xxhash64("vec_id")
    queries = asked.orderBy(by, "rid").limit(SAMPLE_QUERIES).collect()
    others = rows.orderBy(F.xxhash64(by, F.lit(SEED)), "rid").limit(SAMPLE_ROWS).collect()
    filled = lambda vs: np.array([[*v, *[0.0] * (dim - len(v))] for v in vs]).reshape(-1, dim)
    q, own = filled([r.v for r in queries]), np.array([r.rid for r in queries])

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.nan_to_num(q @ matrix(batch.column("v"), dim).T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            scores[own[:, None] == rids] = -np.inf
            for k, (old, ids) in enumerate(best):
                s, i = np.concatenate([old, scores[k]]), np.concatenate([ids, rids])
                top_k = np.argsort(-s, kind="stable")[:nearest]
                best[k] = s[top_k], i[top_k]
        for k, (s, ids) in enumerate(best):
            yield pa.RecordBatch.from_pydict({"k": np.full(len(s), k, np.int32), "rid": ids, "score": s})

    near = rows.select("rid", "v").mapInArrow(closest, "k int, rid long, score double")
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.desc("score"), "rid"))
    near = settle(near.withColumn("rank", rank).where((F.col("rank") <= nearest) & (F.col("score") > float("-inf"))).select("k", "rid"))
    near = rows.join(F.broadcast(near), "rid").select("k", "v", "length").collect()  # nearest x SAMPLE_QUERIES rows at most
    if not near:
        return HASHES[0], 1
    of = np.array([r.k for r in near])
    found = as_points(filled([r.v for r in near]), np.array([r.length for r in near]), top)
    rest = as_points(filled([r.v for r in others]), np.array([r.length for r in others]), top)
    best = None
    for hashes in HASHES:
        functions, order = Functions(dim, hashes), template(hashes, PROBES)
        probed, missing = functions.probes(as_queries(q), order), len(order)
        first = lambda keys, k: min_rank(probed[k], keys, missing)
        met = functions.keys(found)
        ranks = np.sort(np.concatenate([first(met[of == k], k) for k in range(len(q))]))
        enough = int(ranks[math.ceil(TARGET * len(ranks)) - 1]) + 1
        if enough > missing:
            continue
        keys = functions.keys(rest)
        share = np.mean([(first(keys, k) < enough).mean() for k in range(len(q))])
        cost = share * n + enough * TABLES * PROBE_COST
        if best is None or cost < best[0]:
            best = cost, hashes, enough
    return best[1:] if best else None


def min_rank(probed: np.ndarray, keys: np.ndarray, missing: int) -> np.ndarray:
    """For rows with ``keys`` (rows, tables): the first probe of a query, ``probed`` (tables, probes), that meets each."""
    out = np.full(len(keys), missing)
    for t in range(len(probed)):
        order = np.argsort(probed[t], kind="stable")
        at = np.minimum(np.searchsorted(probed[t], keys[:, t], sorter=order), len(order) - 1)
        rank = np.where(probed[t][order[at]] == keys[:, t], order[at], missing)
        out = np.minimum(out, rank)
    return out


class Shard:
    """One shard's vectors and the tables over them."""

    def __init__(self, rids, ids, no_id, x, keys):
        self.rids, self.ids, self.no_id, self.x = rids, ids, no_id, x
        order = np.argsort(keys.ravel(), kind="stable")
        self.rows = order // keys.shape[1]
        self.keys, self.first = np.unique(keys.ravel()[order], return_index=True)
        self.ends = np.append(self.first[1:], keys.size)
        with np.errstate(over="ignore"):
            self.reach = np.sqrt((x * x).sum(1).max())

    def candidates(self, probed: np.ndarray) -> np.ndarray:
        """The rows in the probed buckets, merged."""
        at = np.minimum(np.searchsorted(self.keys, probed), len(self.keys) - 1)
        at = np.unique(at[self.keys[at] == probed])
        sizes = self.ends[at] - self.first[at]
        place = np.repeat(self.first[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        seen = np.zeros(len(self.rids), bool)
        seen[self.rows[place]] = True
        return np.flatnonzero(seen)

    def nearest(self, rid: int, q: np.ndarray, among: np.ndarray | None, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``count`` nearest, of the rows ``among`` or all."""
        among = np.arange(len(self.rids)) if among is None else among
        among = among[self.rids[among] != rid]
        if not len(among):
            return among, np.zeros(0)
        with np.errstate(over="ignore", invalid="ignore"):
            rough = np.nan_to_num(self.x[among] @ q if 4 * len(among) < len(self.x) else (self.x @ q)[among], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            if len(among) > count:
                error = 1e-15 * len(q) * self.reach * np.linalg.norm(q)
                least = -np.partition(-rough, count - 1)[count - 1]
                among = among[rough >= least - error] if np.isfinite(error) else among
            exact = np.nan_to_num((self.x[among] * q).sum(1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)  # one order of addition, so that copies tie
        best = np.lexsort((self.rids[among], self.ids[among], self.no_id[among], -exact))[:count]
        return among[best], exact[best]


def scorer(functions: Functions, order: np.ndarray, dim: int, nearest: int):
    """Streams a shard's queries past its vectors; rows come sorted by shard, vectors (``kind`` 0) first."""

    def answers(shard: Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(0, batch.num_rows, STEP):
            part = batch.slice(k, STEP)
            q, rids, ids, every = matrix(part.column("v"), dim), part.column("rid").to_numpy(), part.column("vec_id").to_pylist(), part.column("every").to_pylist()
            probed = functions.probes(as_queries(q), order).reshape(len(q), -1)
            out = []
            for j in range(len(q)):
                rows, scores = shard.nearest(int(rids[j]), q[j], None if every[j] else shard.candidates(probed[j]), nearest)
                out.append((np.full(len(rows), rids[j]), [ids[j]] * len(rows), rows, scores))
            rows = np.concatenate([o[2] for o in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[0] for o in out])), pa.array([i for o in out for i in o[1]], pa.int64()), pa.array(shard.rids[rows]),
                 pa.array(shard.ids[rows], mask=shard.no_id[rows]), pa.array(np.concatenate([o[3] for o in out]))], schema=FOUND
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, shard = None, [], None
        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shards[a] != current:
                    current, parts, shard = shards[a], [], None
                own = batch.slice(a, b - a)
                if kinds[a] == 0:
                    ids = own.column("vec_id")
                    parts.append((own.column("rid").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), matrix(own.column("v"), dim), matrix(own.column("keys"), TABLES)))
                elif parts:
                    shard = shard or Shard(*(np.concatenate(c) for c in zip(*parts)))
                    yield from answers(shard, own)

    return run


def search(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``nearest`` found of each row for which ``is_query`` (over ``vec_id``) holds."""
    rows = settle(valid(df, id_col, vector_col))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max("length").alias("top")).first()
    n, dim, top = facts.n, facts.dim or 1, facts.top or 0.0
    asked = rows.where(is_query)
    fit = fitted(rows, asked, dim, n, top, nearest)
    hashes, probes = fit or (HASHES[0], 1)
    functions, order = Functions(dim, hashes), template(hashes, probes)
    shards = max(1, -(-n // SHARD_ROWS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = as_points(matrix(batch.column("v"), dim), batch.column("length").to_numpy(), top)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(functions.keys(points).ravel()), TABLES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("vec_id"), batch.column("v"), keys], names=["rid", "vec_id", "v", "keys"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                keys = functions.probes(as_queries(matrix(part.column("v"), dim)), order).reshape(part.num_rows, -1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("rid"), lists], names=["rid", "keys"])

    shard = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard")
    indexed = rows.mapInArrow(index, INDEXED).select("rid", "vec_id", "v", "keys", shard)
    buckets = indexed.select(F.explode("keys").alias("key"), "shard").distinct()
    directory = settle(buckets.groupBy("key").agg(F.array_sort(F.collect_list("shard")).alias("shards")))
    probed = asked.select("rid", "v").mapInArrow(probe, "rid long, keys array<long>").select("rid", F.explode("keys").alias("key"))
    # Many buckets lie in the same shards, so each query's sets of shards are merged before they become rows.
    routes = join_small(probed, directory, "key").groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_set("shards"))).alias("shards"))
    routes = routes.select("rid", F.explode("shards").alias("shard"))
    vectors = indexed.select("shard", F.lit(0).alias("kind"), "rid", "vec_id", "v", "keys", F.lit(False).alias("every"))

    def answered(routes: DataFrame, every: bool) -> DataFrame:
        queries = asked.join(routes, "rid").select("shard", F.lit(1).alias("kind"), "rid", "vec_id", "v", F.lit(None).cast("array<long>").alias("keys"), F.lit(every).alias("every"))
        dealt = vectors.union(queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
        found = dealt.mapInArrow(scorer(functions, order, dim, nearest), "query long, query_id long, rid long, vec_id long, score double")
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid"))
        return settle(found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query", "query_id", "rank", "vec_id", "score"))

    everywhere = lambda few: few.select("rid", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    if fit is None:  # no setting finds enough: every query against all rows
        return answered(everywhere(asked), True).select("query_id", "rank", "vec_id", "score")
    found = answered(routes, False)
    full = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(nearest, n - 1))
    short = settle(asked.select("rid").join(full, F.col("rid") == F.col("query"), "left_anti"))
    if n > 1 and short.count():
        more = answered(everywhere(short), True)
        found = found.join(short, found["query"] == short.rid, "left_anti").union(more)
    return found.select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
