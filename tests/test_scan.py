import math

import pytest

from lorespark.operators.scan import blocks, compare, nearest


def cosine(a, b):
    both = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return 0.0 if len(a) != len(b) or not a or both == 0 else sum(x * y for x, y in zip(a, b, strict=True)) / both


def rows(n):
    """Vectors of two widths, many copies, zeros, an empty one."""
    made = [(i, [float((i * 7 + j * j) % 5 - 2) for j in range(4 if i % 3 else 3)]) for i in range(n)]
    return [*made, (n, []), (n + 1, [0.0, 0.0, 0.0])]


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 20])
def test_nearest_equals_brute_force(spark, block_bytes):
    own = rows(60)
    lost = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 1.0, 1.0]), (903, [float("inf"), 1.0, 1.0])]
    v = spark.createDataFrame(own + lost, "id long, embedding array<float>").repartition(3)
    q = v.where("id % 4 = 0").selectExpr("id as query_id", "embedding")
    found = sorted(tuple(r) for r in nearest(v, q, 5, apart=True, block_bytes=block_bytes).select("query_id", "rank", "id", "sim").collect())
    want = []
    for i, e in own:
        if i % 4 == 0:
            best = sorted((-round(cosine(e, f), 9), j) for j, f in own if j != i)[:5]
            want += [(i, k + 1, j, -s + 0.0) for k, (s, j) in enumerate(best)]
    assert [(a, b, c) for a, b, c, _ in found] == [(a, b, c) for a, b, c, _ in sorted(want)]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(found, sorted(want), strict=True))


def test_threshold_keeps_every_hit(spark):
    own = rows(40)
    v = spark.createDataFrame([(f"é{i}", e) for i, e in own], "id string, embedding array<double>")
    q = v.selectExpr("id as query_id", "embedding")
    found = sorted((r["query_id"], r["id"]) for r in compare(v, q, threshold=0.3, block_bytes=100).collect())
    assert found == sorted((f"é{i}", f"é{j}") for i, e in own for j, f in own if cosine(e, f) >= 0.3)


def test_blocks_are_bounded_and_nothing_is_no_error(spark):
    v = spark.createDataFrame(rows(50), "id long, embedding array<double>").coalesce(1)
    assert max(len(r["matrix"]) for r in blocks(v, 256).collect()) <= 256
    none = v.where("false")
    assert nearest(none, v.selectExpr("id as query_id", "embedding"), 3).count() == 0
    assert nearest(v, none.selectExpr("id as query_id", "embedding"), 3).count() == 0
