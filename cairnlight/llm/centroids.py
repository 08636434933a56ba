"""Centroid clustering of integer vectors with Elkan's bounds, equal to the plain assignment in every tie.

Each vector keeps an upper bound on the distance to its centroid and a lower bound for each centroid. When centroids move,
the bounds move with them; by the triangle inequality a vector whose upper bound is under half the way from its centroid
to the next one stays without a distance, and of the other centroids only those that neither a lower bound nor half the
way between centroids rules out are measured. Upper bounds are rounded up, lower ones down, and both must be passed
strictly, so what might tie is measured; distances that decide are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm.common import materialize, table

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Components beyond this have no exact squared distance of 64 bits.
LIMIT = 1 << 26
#: Relative error that covers the roundings of a square root or a sum in doubles, with room.
SLACK = 1e-12
STATE = "vec_id {kind}, v array<int>, cluster int, upper float, lower array<float>"


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v.astype(np.int64) - c
    return (d * d).sum(axis=-1)


def assigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters, bounds and how many distances were measured, after the centroids moved by ``moved``."""
    k = len(centroids)
    lower = down(np.maximum(lower.astype(np.float64) - moved, 0))
    upper = up(upper.astype(np.float64) + moved[cluster])
    half = np.sqrt(squared(centroids[:, None], centroids[None]).astype(np.float64)) / 2 * (1 - SLACK)
    near = np.where(np.eye(k, dtype=bool), np.inf, half).min(axis=1)
    cluster = cluster.copy()
    at = np.flatnonzero(upper >= near[cluster])
    if not len(at):
        return cluster, upper, lower, 0
    x, own = v[at], cluster[at]
    best = squared(x, centroids[own])
    high, low, measured = up(np.sqrt(best.astype(np.float64))), lower[at], len(at)
    low[np.arange(len(at)), own] = down(np.sqrt(best.astype(np.float64)))
    for j in range(k):
        ask = np.flatnonzero((own != j) & (low[:, j] <= high) & (half[own, j] <= high))
        if not len(ask):
            continue
        d = squared(x[ask], centroids[j])
        measured += len(ask)
        low[ask, j] = down(np.sqrt(d.astype(np.float64)))
        win = (d < best[ask]) | ((d == best[ask]) & (j < own[ask]))
        to = ask[win]
        own[to], best[to] = j, d[win]
        high[to] = up(np.sqrt(d[win].astype(np.float64)))
    cluster[at], upper[at], lower[at] = own, high, low
    return cluster, upper, lower, measured


def _step(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, last: bool) -> DataFrame:
    """The next state, or (vec_id, cluster, distance) at the end. Centroids go along with the tasks: k x dims integers."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            v = np.asarray(b.column(1).flatten()).reshape(n, dims)
            lower = np.asarray(b.column(4).flatten()).reshape(n, k)
            cluster, upper, lower, _ = assigned(v, np.asarray(b.column(2)), np.asarray(b.column(3)), lower, centroids, moved)
            if last:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster), pa.array(squared(v, centroids[cluster]))], names=["vec_id", "cluster", "distance"])
            else:
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster), pa.array(upper), pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))], names=["vec_id", "v", "cluster", "upper", "lower"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id {kind}, cluster int, distance long" if last else STATE.format(kind=kind))


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (floor of scale times each component) of the vectors that have ``dims`` finite components."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits: Column = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LIMIT))
    return vectors.filter(fits).select("vec_id", scaled.cast("array<int>").alias("v"))


def seeds(kept: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The k vectors of least sha256 of seed:vec_id, in that order (equal ids by components); fewer if there are fewer."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in kept.orderBy(hashed, "v").limit(k).select("v").collect()], np.int64)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each non-empty cluster: k rows of sums reach the driver. Sums hold up to 2 ** 36
    vectors of a cluster; beyond that the engine's overflow error ends the job."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect():
        out[r.cluster] = [x // r.n for x in r.s]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    ``vectors`` have vec_id and embedding; other columns, whatever their names, are not read. Vectors that are null, of
    another length, or with a null or non-finite component are left out, as are those with a component that scales to
    2 ** 26 or more in size. Repeated and null ids are vectors of their own. No vectors give no rows. Rows never move:
    each round reads a state of (dims + k) * 4 bytes a vector and writes the next in its place.
    """
    kept = integers(vectors, dims, scale)
    centroids = seeds(kept, k, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    none = F.array_repeat(F.lit(0.0).cast("float"), len(centroids))
    state = kept.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).cast("float").alias("upper"), none.alias("lower"))
    moved = np.zeros(len(centroids))
    for _ in range(rounds):
        state = materialize(_step(state, centroids, moved, False), "clusters", replaces=[state])
        new = _means(state, centroids)
        moved = np.sqrt(squared(new, centroids).astype(np.float64)) * (1 + SLACK)
        centroids = new
    return materialize(_step(state, centroids, moved, True), "clusters", replaces=[state]), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    per = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*(F.lit(x).cast(kind) for x in values)).cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select(
        "vec_id", "cluster", "distance", of([per.get(j, 0) for j in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(per.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


_ASSIGN = """a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, c := c)) AS m FROM
  (SELECT rid, c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - s.v[i]) * (k.v[i] - s.v[i])))::BIGINT AS d FROM k, c{r} s) GROUP BY rid)"""
_MOVE = """c{n} AS MATERIALIZED (SELECT s.c, coalesce(g.v, s.v) AS v FROM c{r} s LEFT JOIN
  (SELECT c, list(q ORDER BY i) AS v FROM (SELECT c, i, ((t - ((t % n) + n) % n) // n)::BIGINT AS q FROM
    (SELECT a.m.c AS c, i, sum(k.v[i])::HUGEINT AS t, count(*) AS n FROM a{r} a JOIN k USING (rid), range(1, 65) x(i) GROUP BY a.m.c, i)) GROUP BY c) g USING (c))"""
ORACLE_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM k) WHERE c < {CLUSTERS}),
{", ".join(f"{_ASSIGN.format(r=r)}, {_MOVE.format(r=r, n=r + 1)}" for r in range(ROUNDS))}, {_ASSIGN.format(r=ROUNDS)}
SELECT k.vec_id, a.m.c::INTEGER AS cluster, a.m.d::BIGINT AS distance, sum(a.m.d) OVER (PARTITION BY a.m.c)::BIGINT AS cluster_inertia,
  sum(a.m.d) OVER ()::BIGINT AS inertia, sha256(list_aggregate(list_transform(s.v, lambda x: x::VARCHAR), 'string_agg', ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN k USING (rid) JOIN c{ROUNDS} s ON s.c = a.m.c
"""
QUERIES = {"op13_centroids": op13_centroids}
ORACLE = {"op13_centroids": ORACLE_SQL}
