import math
import zlib

import numpy as np

from lorespark.llm import shard


def test_sizes_and_slots_are_exact(spark, documents):
    for block in (1 << 16, 10):
        rows = shard.shard_rows(documents.repartition(5), 8, rows_per_block=block).collect()
        held = {}
        for r in rows:
            held.setdefault(r["shard"], []).append(r["slot"])
        sizes = [len(v) for v in held.values()]
        assert len(rows) == documents.count() and max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in held.values())


def test_awkward_rows(awkward, nothing):
    rows = shard.sharded_documents(awkward, 8).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r["doc_id"] == 3:
            assert r["size"] == 1 and r["text_crc32"] == 0
        if r["doc_id"] == 7 and r["size"] == 8:
            assert r["text_crc32"] == zlib.crc32(b"one two")
    assert shard.shard_rows(nothing, 8).count() == 0
    assert shard.shard_rows(awkward, 3).columns == [c for c in awkward.columns if c not in ("shard", "slot")] + ["shard", "slot"]


def test_columns_and_texts_are_carried(awkward):
    own = awkward
    made = shard.shard_rows(own, 3)
    assert made.columns == [c for c in own.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert made.drop("shard", "slot").exceptAll(own.drop("shard", "slot")).count() == 0 and made.count() == own.count()


def test_dealt_rows_are_uniform(spark):
    rows = spark.range(12).repartition(3)
    seen = np.zeros((12, 12))
    for seed in range(120):
        for r in shard.shard_rows(rows, 2, seed=seed, rows_per_block=3).collect():
            seen[r["id"], 6 * r["shard"] + r["slot"]] += 1
    # 120 draws over 12 places: chi-square of 121 degrees of freedom, far tail
    assert (seen.sum(axis=0) == 120).all() and ((seen - 10) ** 2 / 10).sum() < 190


def test_matrix_has_the_given_margins():
    sizes, capacity = np.array([5, 0, 9, 2, 4]), np.array([7, 7, 6])
    m = np.array([shard.matrix_row(p, sizes, capacity, 3) for p in range(5)])
    assert (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == capacity).all()


def test_every_place_is_as_likely(spark):
    seen = np.zeros((6, 6))
    for seed in range(400):
        m = [shard.matrix_row(p, np.array([3, 3]), np.array([1] * 6), seed) for p in range(2)]
        seen[0] += m[0]
    assert abs(seen[0] / 400 - 0.5).max() < 0.1


def test_chance_of_a_large_deviate():
    from fractions import Fraction

    for good, bad, drawn in ((30, 50, 20), (900, 400, 700)):
        p = drawn / (good + bad)
        total = math.comb(good + bad, drawn)
        for x in range(max(0, drawn - bad), min(good, drawn) + 1, 7):
            exact = float(Fraction(math.comb(good, x) * math.comb(bad, drawn - x), total))
            made = math.exp(shard._log_binomial(x, good, p) + shard._log_binomial(drawn - x, bad, p) - shard._log_binomial(drawn, good + bad, p))
            assert exact < 1e-200 or abs(made / exact - 1) < 1e-10


def test_large_deviates():
    rng = np.random.default_rng(1)
    x = [shard._hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(x) - 750) < 5 and 8 < np.std(x) < 20
