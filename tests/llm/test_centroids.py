import hashlib
import math
import random

import numpy as np
import pytest

from cadenza.llm import centroids
from cadenza.llm.centroids import cluster, drifts, keys_of


def brute(rows, k, rounds, dims, scale, seed=3):
    """(id, cluster, distance, cluster inertia, inertia, centroid digest) by whole comparisons in Python integers; compared vectors of a plain run."""
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    end = [near(v) for _, v in kept]
    per = {j: sum(d for d, c in end if c == j) for j in range(len(at))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for (i, _), (d, c) in zip(kept, end, strict=True)), key=str)


def check(spark, rows, k, rounds, dims, scale=1024):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, key string").repartition(3)
    got = cluster(df, clusters=k, rounds=rounds, dims=dims, scale=scale)
    assert sorted(map(tuple, got.rows.collect()), key=str) == brute(rows, k, rounds, dims, scale)
    return got


def test_clouds(spark):
    r = random.Random(1)
    middles = [[r.gauss(0, 2) for _ in range(6)] for _ in range(7)]
    rows = [(i, [x + r.gauss(0, 0.6) for x in r.choice(middles)]) for i in range(700)]
    got = check(spark, rows, 8, 10, 6)
    assert got.compared[0] == 700 and sum(got.compared[1:]) < 0.6 * 700 * len(got.compared[1:])  # the heap spares most comparisons


def test_ties_repeats_and_odd_vectors(spark):
    r = random.Random(2)
    rows = [(i % 60, [float(r.randrange(3)) for _ in range(2)]) for i in range(150)]  # many equal vectors, equal distances and equal ids
    rows += [(None, [1.0, 1.0]), (None, [0.0, 2.0]), (500, None), (501, []), (502, [1.0]), (503, [1.0, None]), (504, [float("nan"), 1.0]), (505, [float("-inf"), 1.0]), (506, [1.0, 2.0, 3.0])]
    rows += [(600, [-0.0005, -1e-30])] * 3
    check(spark, rows, 8, 10, 2)
    check(spark, rows, 5, 0, 2)
    check(spark, rows, 1, 4, 2)


def test_few_vectors_and_none(spark):
    check(spark, [(1, [0.5, 2.0]), (2, [-3.25, 1.0]), (3, [9.0, 9.0])], 8, 10, 2)
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = cluster(df.limit(0), dims=2)
    assert got.rows.count() == 0 and got.rows.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster(df, dims=64).rows.count() == 0


def test_a_centroid_that_loses_all(spark):
    """An empty centroid stays where it was."""
    rows = [(i, [float(i % 2) * 10 + (i % 7) / 50, 0.0]) for i in range(40)]
    check(spark, rows, 12, 10, 2)


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 100000.0 + i, 130000.0 - i]) for i in range(30)]
    check(spark, rows, 4, 5, 2)
    with pytest.raises(Exception, match="scale the vectors down"):
        cluster(spark.createDataFrame([(1, [3e38] * 64)], "vec_id long, embedding array<float>")).rows.collect()


def test_whole_table_with_other_sizes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    got = cluster(df, clusters=5, rounds=3)
    assert sorted(map(tuple, got.rows.collect()), key=str) == brute(rows, 5, 3, 64, 1024)


def test_bounds_are_safe():
    """No vector whose nearest centroid changes, or ties, is left in a heap."""
    r = np.random.default_rng(3)
    v = r.integers(-50, 50, (3000, 3))
    c = r.integers(-50, 50, (6, 3))
    drift = np.zeros(6)
    own, key = keys_of(centroids.distances(v, c), drift)
    for _ in range(20):
        now = c + r.integers(-2, 3, c.shape)
        drift = drift + drifts(c, now)
        c = now
        d = centroids.distances(v, c)
        least = np.sort(d, axis=1)
        left = key > drift[own]
        assert (d.argmin(axis=1)[left] == own[left]).all() and (least[left, 0] < least[left, 1]).all()
    assert not drifts(c, c).any()


def test_popping_reads_a_range_of_keys(spark, monkeypatch):
    """The heap's top reaches the Parquet reader as a filter on cluster and key."""
    seen = []
    real = centroids._put
    monkeypatch.setattr(centroids, "_put", lambda rows, *a: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), real(rows, *a))[1])
    r = random.Random(3)
    cluster(spark.createDataFrame([(i, [r.random(), r.random()]) for i in range(200)], "vec_id long, embedding array<float>"), clusters=3, dims=2)
    assert len(seen) > 2 and all("LessThanOrEqual(key" in p and "EqualTo(cluster" in p for p in seen[1:])
