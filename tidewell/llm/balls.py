"""Centroid clustering: ball k-means, exact in whole numbers.

A cluster is a ball: its centroid and a radius, the distance of its farthest member. Another centroid matters to
a ball only if it lies within twice the radius: those are the ball's neighbours. Sorted by
their distance they cut the ball into a stable core, whose members lie nearer than half way to the nearest
neighbour and are compared with nothing, and annuli: a member of the annulus between half way to neighbour ``t``
and half way to ``t + 1`` is compared exactly with the first ``t`` neighbours. All bounds are squares of
whole numbers, rounded to the safe side, so the result is that of comparing every vector with every centroid.

Components become ``floor(UNIT * x)``. The start is the ``K`` vectors with the least SHA-256 of ``<SEED>:<vec_id>``. In each of
``ROUNDS`` rounds every vector goes to the nearest centroid (ties: the smaller number) and every centroid
that has vectors becomes the floor of their mean, component by component; then vectors are assigned once more.

The vectors with their clusters are written to the shared folder in each round, and the round before is
removed once the next is whole, so a lost task is computed again from files. Sums and radii are partial
aggregates; the driver sees a row for each cluster. Before a round the radius is that of the last round plus
the centroid's way.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take no part,
nor do those with a component beyond ``LARGEST``, whose distances would not fit a long; fewer than ``K``
vectors make as many centroids; repeated vectors count as often as they occur, and
of equal keys the one with the smaller components starts first; null ids come last among the starts; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import new_dir, remove_dir, table

DIM, K, ROUNDS = 64, 40, 5
UNIT, SEED = 256, "2"
#: The squared distance of any two vectors within it is below 2 ** 62.
LARGEST = (1 << 27) / UNIT
STATE = "vec_id long, v array<int>, cluster int, distance long"


def quantised(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """``(vec_id, v)``: the vectors that take part, in whole numbers."""
    x = F.col("embedding")
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * UNIT).cast("int"))
    return vectors.where((F.size(x) == dim) & F.coalesce(fits, F.lit(False))).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


def root_above(square: int) -> int:
    """The least whole number whose square is ``square`` or more."""
    return isqrt(square - 1) + 1 if square > 0 else 0


def neighbours(centroids: np.ndarray, radii: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each ball: its neighbours by distance, and the least squared distance of a member to whom each matters.

    A radius is a bound from above; None is no bound.
    """
    found = []
    for i, radius in enumerate(radii):
        apart = ((centroids - centroids[i]) ** 2).sum(1)
        quarter = (apart + 3) // 4  # a member at d2 is affected if apart <= 4 * d2
        order = np.lexsort((np.arange(len(centroids)), apart))
        order = order[order != i]
        if radius is not None:
            order = order[[int(quarter[j]) <= radius * radius for j in order]]
        found.append((order, quarter[order]))
    return found


def nearest(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector and its squared distance, from the cluster that each is in; how many comparisons it took."""
    best, compared = own.astype(np.int64), len(x)
    distance = ((x - centroids[own]) ** 2).sum(1)
    for i in np.unique(own):
        order, quarter = near[i]
        members = np.flatnonzero(own == i)
        reach = np.searchsorted(quarter, distance[members], side="right")  # the annulus; 0 is the stable core
        by_reach = np.argsort(-reach, kind="stable")
        members, reach = members[by_reach], reach[by_reach]
        for t in range(int(reach[0])):
            outer = members[: np.searchsorted(-reach, -t, side="left")]
            away = ((x[outer] - centroids[order[t]]) ** 2).sum(1)
            better = (away < distance[outer]) | ((away == distance[outer]) & (order[t] < best[outer]))
            distance[outer[better]], best[outer[better]] = away[better], order[t]
            compared += len(outer)
    return best, distance, compared


def assigned(state: DataFrame, centroids: np.ndarray, radii: list[int | None]) -> DataFrame:
    """``state`` with every vector in the cluster of its nearest centroid."""
    near = neighbours(centroids, radii)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
                cluster, distance, _ = nearest(x, batch.column("cluster").to_numpy(zero_copy_only=False), centroids, near)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(run, STATE)


def totals(state: DataFrame, dim: int = DIM) -> dict[int, tuple]:
    """Of each cluster that has vectors: their number, the sums of their components, the greatest distance and the distances' sum."""
    sums = [F.sum(F.get("v", F.lit(k)).cast("long")).alias(f"s{k}") for k in range(dim)]
    inertia = F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")
    rows = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), inertia, *sums).collect()  # a row for each cluster
    return {r.cluster: (r.n, [r[f"s{k}"] for k in range(dim)], r.far, int(r.inertia)) for r in rows}


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, np.ndarray, dict[int, tuple]]:
    """``(vec_id, v, cluster, distance)`` of all vectors that take part, the final centroids, and the clusters' ``totals``."""
    spark = vectors.sparkSession
    state = quantised(vectors, dim).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")})
    centroids = first_centroids(state, k)
    if not len(centroids):
        return state.where(F.lit(False)), centroids, {}
    radii: list[int | None] = [None] * len(centroids)
    path, found = None, {}
    for no in range(rounds + 1):
        to = new_dir(spark, "balls")
        assigned(state, centroids, radii).write.parquet(to)
        state = spark.read.schema(STATE).parquet(to)
        if path is not None:
            remove_dir(spark, path)
        path, found = to, totals(state, dim)
        if no < rounds:
            moved = centroids.copy()
            for i, (n, sums, _, _) in found.items():
                moved[i] = [s // n for s in sums]  # the floor, also below zero
            way = ((moved - centroids) ** 2).sum(1)
            radii = [root_above(found[i][2] if i in found else 0) + root_above(int(way[i])) for i in range(len(centroids))]
            centroids = moved
    return state, centroids, found


def op11_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids, found = cluster(table(spark, sf_dir, "embeddings"))
    inertia = sum(x[3] for x in found.values())
    rows = [(i, found[i][3], inertia, sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids) if i in found]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The same in SQL: every vector against every centroid."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT rid, n, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{r} c USING (i) GROUP BY rid, n),
a{r} AS MATERIALIZED (SELECT rid, n, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, n) = 1)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT n, i, sum(x) AS s, count(*) AS k FROM a{r} JOIN x USING (rid) GROUP BY n, i),
c{r + 1} AS MATERIALIZED (SELECT c.n, c.i, coalesce(CASE WHEN s < 0 AND s % k <> 0 THEN s // k - 1 ELSE s // k END, x)::BIGINT AS x FROM c{r} c LEFT JOIN m{r} m ON m.n = c.n AND m.i = c.i)""")
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor({UNIT} * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c) AND abs(c) <= {LARGEST})) = {DIM}),
x AS MATERIALIZED (SELECT rid, unnest(range({DIM})) AS i, unnest(v) AS x FROM e),
c0 AS MATERIALIZED (SELECT n, i, x FROM (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS n FROM e QUALIFY n < {K}) JOIN x USING (rid)),
{", ".join(steps)},
p AS (SELECT n, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY n)
SELECT vec_id, n::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{ROUNDS} JOIN e USING (rid) JOIN p USING (n)"""
