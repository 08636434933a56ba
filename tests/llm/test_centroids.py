"""Elkan's bounds against the plain assignment, with ties, repeats, odd vectors and every count of clusters."""

import hashlib
import math

import numpy as np
import pytest

from cairnlight.llm import centroids as C
from tests.compare import same

VECTORS = "vec_id long, embedding array<float>, cluster int, v string"


def plain(rows, k, rounds):
    """(vec_id, cluster, distance) by measuring everything, in whole numbers."""
    kept = []
    for vec, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) and abs(x) * 64 < C.LIMIT for x in e):
            kept.append((vec, [math.floor(64 * float(np.float32(x))) for x in e]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in first[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, a) in zip(kept, got) if a == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((str(i), a, d) for (i, _), (d, a) in zip(kept, assign())), cents


def odd_vectors(n, spread, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-spread, spread + 1, 64) / 64]) for i in range(n)]
    rows += [(i, list(rows[i % 5][1])) for i in range(n, n + 20)]  # copies under other ids
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, None), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65)]
    rows += [(904, [None] + [1.0] * 63), (905, [math.nan] + [1.0] * 63), (906, [math.inf] * 64), (907, [1e30] * 64), (908, [float(C.LIMIT) / 64 - 1] * 64), (909, [-0.001] * 64)]
    return rows


@pytest.mark.parametrize("n, spread, k, rounds", [(60, 1, 16, 3), (200, 40, 16, 3), (6, 3, 64, 2), (90, 2, 1, 3), (90, 0, 4, 3)])
def test_equals_measuring_everything(spark, n, spread, k, rounds):
    rows = odd_vectors(n, spread, n)
    df = spark.createDataFrame([(i, e, 7, "x") for i, e in rows], VECTORS)
    got, cents = C.cluster(df, k, rounds)
    want, means = plain(rows, k, rounds)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    assert cents.tolist() == means


def test_bounds_spare_distances_and_keep_ties():
    rng = np.random.default_rng(3)
    middle = rng.integers(-1000, 1000, (16, 64))
    v = (middle[rng.integers(0, 16, 4000)] + rng.integers(-20, 21, (4000, 64))).astype(np.int32)
    v[:200] = (middle[0] + middle[1]) // 2  # as far from one as from the other, or nearly
    own, high, low = np.zeros(4000, np.int32), np.full(4000, np.inf, np.float32), np.zeros((4000, 16), np.float32)
    cents, moved = middle.astype(np.int64), np.zeros(16)
    spent = []
    for _ in range(3):
        own, high, low, n = C.assigned(v, own, high, low, cents, moved)
        spent.append(n)
        d = ((v[:, None].astype(np.int64) - cents) ** 2).sum(-1)
        assert (own == d.argmin(1)).all()
        assert (low.astype(float) ** 2 <= d * (1 + 1e-9)).all()
        new = cents + rng.integers(-1, 2, cents.shape)
        moved = np.sqrt(((new - cents) ** 2).sum(1)) * (1 + C.SLACK)
        cents = new
    assert spent[1] < 4000 and spent[2] < 4000 and spent[0] < 4000 * 16


def test_sql_twin(spark, sf):
    same(spark, C.op13_centroids, C.ORACLE_SQL, sf)


def test_sql_twin_on_odd_vectors(spark, table_dir):
    rows = [(i, e, 1, None) for i, e in odd_vectors(40, 5, 1) if i != 907 and i is not None]
    d = table_dir(embeddings=spark.createDataFrame(rows, VECTORS).coalesce(1))
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    done = con.execute(C.ORACLE_SQL)
    cols = [c[0] for c in done.description]
    want = sorted(tuple(map(str, r)) for r in done.fetchall())
    assert sorted(tuple(map(str, r)) for r in C.op13_centroids(spark, d).select(cols).collect()) == want


def test_no_vectors(spark, table_dir):
    d = table_dir(embeddings=spark.createDataFrame([(1, None, 1, None)], VECTORS))
    assert C.op13_centroids(spark, d).collect() == []
