import numpy as np

from lorespark.llm import quality


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = quality.Model(None, 0.3, rng.normal(size=quality._SIZE), rng.normal(size=(quality._SIZE, quality.RANK)))
    index, values, bounds = rng.integers(0, quality._SIZE, 12), rng.normal(size=12), np.array([0, 5, 12])
    out, _ = quality.machine(model, index, values, bounds)
    for a, b, got in ((0, 5, out[0]), (5, 12, out[1])):
        pairs = sum(values[i] * values[j] * model.factors[index[i]] @ model.factors[index[j]] for i in range(a, b) for j in range(i + 1, b))
        assert abs(0.3 + (model.linear[index[a:b]] * values[a:b]).sum() + pairs - got) < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.scored_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored_documents(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality.scored_documents(nothing, labels).count() == 0
    assert {r["score"] for r in quality.scored_documents(awkward, labels.where("false")).collect()} == {0.5}
