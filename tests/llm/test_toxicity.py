import itertools
import time

import numpy as np
import pyarrow as pa

from lorespark.llm import kernels as K
from lorespark.llm import toxicity


def test_long_chains_are_cut_without_loss():
    rng = np.random.default_rng(8)
    bounds = np.concatenate([[0], np.cumsum([40, 0, 7, 100, 8, 1, 16, 9])])
    for scale in (1.0, 30.0):
        odds, a = np.exp(rng.normal(size=bounds[-1]) * scale), np.exp(rng.normal(size=(2, 2)) * 2)
        for segment in (1, 2, 8, 64):
            assert np.allclose(toxicity.filtered(odds, bounds, a, segment), toxicity.filtered(odds, bounds, a, 1000), rtol=1e-9)


def test_a_text_of_a_million_words_takes_seconds():
    rng = np.random.default_rng(8)
    began = time.perf_counter()
    p = toxicity.marginals(rng.normal(size=1_000_000), np.array([0, 1_000_000]), np.array([[0.3, -1.0], [-0.5, 0.8]]))
    assert time.perf_counter() - began < 5 and (p > 0).all() and (p < 1).all()


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(2)
    lengths = [4, 1, 0, 3]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    emission, trans = rng.normal(size=bounds[-1]), rng.normal(size=(2, 2))
    got = toxicity.marginals(emission, bounds, trans)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        total, ones = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(emission[a + i] * s for i, s in enumerate(path)) + sum(trans[s, t] for s, t in itertools.pairwise(path)))
            total += w
            ones += w * np.array(path)
        assert np.allclose(got[a:b], ones / total)


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    e, gold, trans = rng.normal(size=(5, 3)), rng.integers(0, 2, (5, 3)).astype(float), rng.normal(size=(2, 2))
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = False
    gold *= mask

    def value(e, trans):
        out = 0.0
        for c in range(3):
            n = int(mask[:, c].sum())
            score = lambda p: sum(e[i, c] * s for i, s in enumerate(p)) + sum(trans[s, t] for s, t in itertools.pairwise(p))  # noqa: B023, E731
            out += score([int(x) for x in gold[:n, c]]) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=n)))
        return out

    d_e, d_t = toxicity._gradient(e, gold, mask, trans, 1.0)
    for i in np.ndindex(2, 2):
        up = trans.copy()
        up[i] += 1e-5
        assert abs((value(e, up) - value(e, trans)) / 1e-5 - d_t[i]) < 1e-3
    up = e.copy()
    up[2, 1] += 1e-5
    assert abs((value(up, trans) - value(e, trans)) / 1e-5 - d_e[2, 1]) < 1e-3


def corpus(spark):
    words = [f"plain{i}" for i in range(50)]
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 30))
        if i % 3 == 0:
            text[int(rng.integers(30))] = "Nasty" + ("!" if i % 2 else "")
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_spans_on_held_out_documents(spark, awkward, nothing):
    docs, labels = corpus(spark)
    rows = toxicity.scored_documents(docs, labels).collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] % 3 == 0) for r in rows if r["held_out"])
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        if r["doc_id"] % 3 == 0:
            a, b = map(int, r["spans"].split(",")[0].split("-"))
            assert text[r["doc_id"]][a:b].strip("!") == "Nasty"
    model = toxicity.fit(docs, labels)
    made = toxicity.score(awkward, model)
    assert made.count() == awkward.count() and made.columns[-4:] == ["score", "predicted", "n_spans", "spans"] and all(0 <= r["score"] <= 1 for r in made.collect())
    assert toxicity.score(nothing, model).count() == 0


def test_without_labels(spark, awkward, nothing):
    docs, labels = corpus(spark)
    assert {r["score"] for r in toxicity.scored_documents(awkward, labels.where("false")).collect()} == {0.5}
    assert toxicity.scored_documents(docs, labels.where("toxic = 0")).where("predicted = 1").count() == 0
    assert toxicity.scored_documents(nothing, labels).count() == 0


def test_nothing_is_removed_without_a_model(spark, awkward, nothing):
    docs, labels = corpus(spark)
    for known in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert toxicity.remove_toxic(docs, toxicity.fit(docs, known)).count() == docs.count()
    model = toxicity.fit(docs, labels)
    left = toxicity.remove_toxic(docs.selectExpr("*", "7 as score", "8 as predicted", "'x' as spans", "9 as n_spans"), model)
    assert left.where("score <> 7 or predicted <> 8 or spans <> 'x' or n_spans <> 9").count() == 0
    assert {r["doc_id"] for r in left.collect()} == {i for i in range(600) if i % 3}
    assert toxicity.remove_toxic(awkward, model).count() == awkward.count() and toxicity.remove_toxic(nothing, model).count() == 0


def test_repeated_rows_and_long_texts_do_not_swell_the_sample(spark):
    from lorespark.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(1, f"b{k}") for k in range(50)] + [(2, "x" * 5000), (3, None), (4, "four"), (6, "six")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    rows, _ = labelled_sample(docs, labels, "toxic", 10, max_bytes=16 * 1000)
    held = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert held.items() <= {1: "b0", 3: "", 4: "four", 6: "six"}.items() and 2 not in held and len(held) >= 2


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scored_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95


def test_words_are_trimmed():
    data, offsets = K.column_bytes(pa.array(["«Ab», !! x", None, ""]))
    _, s, e, bounds = toxicity.token_features(data, offsets)
    assert bounds.tolist() == [0, 3, 3, 3] and bytes(data[s[2]:e[2]]) == b"x"
