import random
from pathlib import Path

import numpy as np

from lorespark.llm import near


def shingles(text):
    w = (text or "").split()
    out = {}
    for k in range(max(1, len(w) - 4) if w else 0):
        key = tuple(w[k:k + 5])
        out[key] = out.get(key, 0) + 1
    return out


def alike(a, b):
    both = set(a) & set(b)
    plain = len(both) / max(1, len(a) + len(b) - len(both))
    least = sum(min(a[k], b[k]) for k in both)
    return max(plain, least / max(1, sum(a.values()) + sum(b.values()) - least))


def brute(rows):
    nodes = {}
    for i, t in rows:
        if i is not None:
            nodes[t or ""] = min(i, nodes.get(t or "", i))
    sets = [(n, shingles(t)) for t, n in nodes.items()]
    parent = {n: n for n, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, sa) in enumerate(sets):
        for b, sb in sets[:k]:
            if sa and sb and alike(sa, sb) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, root(nodes[t or ""]) if (t or "") in nodes else None) for i, t in rows), key=str)


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 6)):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(99)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, "copy of a text " * 9) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["class_id"]) for r in near.near_classes(docs).collect()), key=str)
    assert got == brute(rows)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in got})


def test_awkward_rows(awkward, nothing):
    got = sorted(((r["doc_id"], r["class_id"]) for r in near.near_classes(awkward).collect()), key=str)
    ids = [i for i, _ in got]
    assert len(ids) == awkward.count()
    assert {c for i, c in got if i in (3, 4)} == {3} and {c for i, c in got if i == 5} == {5}
    assert near.near_classes(nothing).count() == 0
    kept = near.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 2").count() <= 1 and kept.where("doc_id is null and text is not null").count() == 1
    assert near.keep_one(nothing).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    elements = np.sort(rng.choice(2**40, 300, replace=False).astype(np.uint64))
    wa, wb = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    a, b = wa > 0, wb > 0
    made = near.dart_signatures(np.concatenate([elements[a], elements[b]]), np.concatenate([wa[a], wb[b]]), np.array([0, a.sum(), a.sum() + b.sum(), a.sum() + b.sum()]), 4096)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((made[0] == made[1]).mean() - want) < 0.04 and not made[2].any()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    labels = {r["node"]: r["label"] for r in near.components(links).collect()}
    assert {labels[i] for i in range(41)} == {0} and labels[101] == 100


def test_components_count_as_they_write(spark):
    """One execution a turn: the driver keeps the plan and the tasks of each that it starts."""
    links = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long").coalesce(1)
    known = spark._jsparkSession.sharedState().statusStore().executionsCount
    before = known()
    near.components(links)
    assert 1 < known() - before <= 6


def test_a_small_table_is_written_in_few_files(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    labels = near.components(spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long"))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    newest = max((p for p in Path(folder).glob("rdd-*")), key=lambda p: int(p.name[4:]))
    assert labels.count() == 9 and len(list(newest.glob("part-*"))) == 1


def test_partner_of_a_single_member_of_a_large_class_is_found(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    core = words(300)
    rows = [(k, f"{core} {words(6)}") for k in range(120)]
    rows += [(200 + k, f"{words(75)} {rows[9 * k + 4][1]}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert {c for _, c in want} == {0}
    for more in ({}, {"rounds": 0, "block_bytes": 10_000}):
        assert sorted(((r["doc_id"], r["class_id"]) for r in near.near_classes(docs, **more).collect()), key=str) == want


def test_maps_leave_no_similar_pair_out():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**48, int(rng.integers(1, 9000))).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[int(len(base) * rng.random() * 0.3):], rng.integers(0, 2**48, int(len(base) * rng.random() * 0.3)).astype(np.uint64)]))]
    n, maps = np.array([len(s) for s in sets]), [near.parity_map(s) for s in sets]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    good = near.within_reach(n, maps, a, b, 0.8)
    same = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert good[same / (n[a] + n[b] - same) >= 0.8].all() and good.mean() < 0.1


def test_plain_copies_of_other_weights_are_found(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(words + words[150:] * 60)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert {c for _, c in want} == set(range(0, 24, 2))
    assert sorted(((r["doc_id"], r["class_id"]) for r in near.near_classes(docs).collect()), key=str) == want
