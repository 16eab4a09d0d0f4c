import hashlib

import numpy as np
import pytest

from lorespark.llm import cluster

COLUMNS = "vec_id long, embedding array<double>, label int, v string, norms string, cluster string, wide int"


def brute(rows, n=8, rounds=10):
    """Plain integers, every centroid tried for every vector."""
    kept = [(i, [cluster._floor_of(x, 1024) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=key)[:n]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((i, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        made = assign()
        for k in range(len(centres)):
            mine = [v for _, c, _, v in made if c == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    made = assign()
    cap = lambda x: min(x, cluster.MOST)
    sums = {k: cap(sum(cap(d) for _, c, d, _ in made if c == k)) for k in range(len(centres))}
    every = cap(sum(cap(d) for _, _, d, _ in made))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, cap(d), sums[k], every, digest[k]) for i, k, d, _ in made), key=str)


def found(df):
    return sorted((tuple(r) for r in cluster.clustered_vectors(df).collect()), key=str)


def test_given_vectors_equal_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 150")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert found(df) == brute(rows)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    near = [(i, (rng.normal(0, 0.02, 64) + (i % 5)).tolist()) for i in range(60)]
    odd = [(60, None), (61, [1.0] * 63), (62, [1.0] * 65), (63, [None, *[1.0] * 63]), (64, [float("nan")] * 64), (65, [float("inf"), *[0.0] * 63]), (66, []), (None, [0.5] * 64), (67, [-0.0004] * 64)]
    rows = near + odd + near[:3] + near[:1] * 20
    df = spark.createDataFrame([(i, e, 1, "v", "n", "c", 3) for i, e in rows], COLUMNS)
    assert found(df.repartition(5)) == brute(rows)
    assert found(df.limit(3)) == brute(rows[:3])
    assert cluster.clustered_vectors(df.where("false")).count() == 0
    assert cluster.clustered_vectors(df.where("vec_id between 60 and 66")).count() == 0


@pytest.mark.parametrize("size", [1e5, 1e30, 1e300])
def test_components_of_any_size(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, size if i % 3 else 1, 64)).tolist()) for i in range(40)]
    df = spark.createDataFrame([(i, e, 1, "v", "n", "c", 3) for i, e in rows], COLUMNS)
    assert found(df) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float((i * 7) % 4)] * 64) for i in range(40)]
    df = spark.createDataFrame([(i, e, 1, "v", "n", "c", 3) for i, e in rows], COLUMNS)
    assert found(df) == brute(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    scale = np.repeat(rng.uniform(1, 900, (40, 8)), 8, axis=1)
    v = (rng.normal(0, 1, (40, 64)) * scale).astype(np.int64)
    points = np.concatenate([v[i % 8] + rng.integers(-20, 20, (1, 64)) for i in range(300)])
    bounds = cluster.lower_bounds(cluster.segment_norms(points), cluster.segment_norms(v[:8]))
    exact = ((points[:, None, :] - v[None, :8]) ** 2).sum(axis=2)
    assert (bounds <= exact).all()
    k, d, taken = cluster.nearest(points, cluster.segment_norms(points), v[:8])
    assert (k == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all() and taken < 0.5 * exact.size
