import pytest


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        made.append(docs)
    return made


def test_stages_keep_columns_and_only_remove(stages):
    docs = stages[0]
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0


def test_texts_change_in_the_substring_stage_alone(stages):
    for before, after in ((0, 1), (1, 2), (3, 4)):
        assert stages[after].exceptAll(stages[before]).count() == 0
    changed = stages[3].select("doc_id", "text").exceptAll(stages[2].select("doc_id", "text"))
    assert changed.count() <= stages[3].count() // 2


def test_no_leaks_or_copies_are_left(spark, sf_dir, stages):
    from lorespark.llm import decontaminate, near

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.find_leaks(stages[4], benchmark).count() == 0
    assert near.near_classes(stages[2]).where("doc_id <> class_id").count() == 0
    assert stages[4].select("doc_id").distinct().count() == stages[5].select("doc_id").distinct().count()


def test_run_returns_the_last_stage(spark, sf_dir, stages):
    import corpus_pipeline

    made = corpus_pipeline.run(spark, sf_dir)
    assert made.columns == stages[5].columns and made.count() == stages[5].count()


def test_stages_equal_brute_force(spark, sf_dir, stages):
    """Each stage on its own input: scores, all pairs, all windows and plain search."""
    from lorespark.llm import toxicity
    from tests.llm import test_near, test_substring

    rows = [[(r["doc_id"], r["text"]) for r in s.select("doc_id", "text").collect()] if k < 5 else None for k, s in enumerate(stages)]
    model = toxicity.fit(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(rows[1]) == sorted((r["doc_id"], r["text"]) for r in toxicity.score(stages[0], model).collect() if r["predicted"] == 0)
    assert sorted(i for i, _ in rows[2]) == sorted({c for _, c in test_near.brute(rows[1])})
    made, words = {}, test_substring.brute(rows[2], 50)
    left = dict(rows[3])
    for i, n, gone, _ in words:
        made[i] = (n, gone)
    for i, t in rows[2]:
        n, gone = made[i]
        assert (left[i] == t if not gone else len(left[i].split()) == n - gone) if n > gone or not gone else i not in left
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    plain = {i: " ".join(t.lower().split()) for i, t in rows[3]}
    holds = {i for i, t in plain.items() if any(w in t for item in items for w in [item[a:a + 64] for a in range(0, max(1, len(item) - 63), 8)])}
    near = {i for i, t in plain.items() if any(item[a:a + 15] in t for item in items for a in range(0, max(1, len(item) - 14), 5))}
    gone = {i for i, _ in rows[3]} - {i for i, _ in rows[4]}
    assert holds <= gone <= near and holds
    packed = stages[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows[4]} and all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)


def test_stages_on_awkward_rows(spark, awkward, nothing, tmp_path):
    import corpus_pipeline

    passage = awkward.where("doc_id = 9").selectExpr("1L as item_id", "text", "2 as _key")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    passage.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (awkward, nothing):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            assert stage.__doc__ and "ull" in stage.__doc__ and "empty" in stage.__doc__, name
            made = stage(spark, docs, str(tmp_path))
            rows = made.collect()
            assert bool(rows) == (docs is awkward)
            if k < 4:
                assert made.columns == docs.columns
                for r in rows:
                    assert (r["score"], r["_n"], r["_spans"], r["_key"], r["text_key"], r["n_spans"]) == (1.0, 2, "s", 3, 4, 1)
    first = corpus_pipeline.STAGES[0][1](spark, awkward, str(tmp_path))
    assert first.count() == awkward.count()  # no label of a toxic document: nothing goes
    left = corpus_pipeline.STAGES[3][1](spark, awkward, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in left), key=str) == sorted([3, 4, 5, 6, 7, 7, 8, None], key=str)
