import zlib

import numpy as np

from lorespark.llm import language as L


def plain(model, text):
    """The network by its definition: every window, filter and place."""
    data = np.frombuffer(text.encode(), np.uint8)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    sums = np.zeros(len(model.languages))
    for at in range(0, max(len(data) - 3, 1), L.STRIDE):
        row = np.zeros(L.WINDOW, np.uint8)
        row[: len(lower[at:at + L.WINDOW])] = lower[at:at + L.WINDOW]
        pooled = []
        for w, width in enumerate(L.WIDTHS):
            for f in range(L.FILTERS):
                answers = [model.biases[w][f] + sum(model.answers[w][j][model.symbol[row[i + j]], f] for j in range(width)) for i in range(L.WINDOW - width + 1)]
                pooled.append(max(max(answers), 0.0))
        z = np.exp(np.array(pooled) @ model.dense + model.offset)
        letters = sum(97 <= b <= 122 or b >= 128 for b in row)
        sums += letters * z / z.sum()
    return sums / sums.sum()


def model_of(seed=1):
    rng = np.random.default_rng(seed)
    rows = rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), (40, L.WINDOW))
    return L.train(rows, np.arange(40) % 3, ["x", "y", "z"], epochs=1)


def test_prediction_equals_the_definition(spark):
    model = model_of()
    rng = np.random.default_rng(2)
    texts = ["a", "Bad cab", "".join(rng.choice(list("abcdefghij QÄ\n"), 600)), "h" * 253, "g" * 256 + "fed", "é" * 130]
    rows = {r["doc_id"]: r for r in L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        p = plain(model, t)
        assert rows[i]["lang_pred"] == model.languages[int(p.argmax())] and abs(rows[i]["score"] - p.max()) < 1e-4


def test_windows_hold_every_run_of_bytes():
    for n in (0, 1, 3, 4, 255, 256, 257, 508, 509, 510, 2000):
        _, first = L.windows(np.zeros(n, np.uint8), np.array([0, n]))
        seen = {(a + i) for a in first.tolist() for i in range(L.WINDOW - 3) if a + i + 4 <= n}
        assert seen == set(range(max(n - 3, 0))) and len(first) == (n > 0) * (1 + max(n - 4, 0) // 253)


def test_training_learns_which_bytes_stand_together():
    rng = np.random.default_rng(3)
    rows = rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), (200, L.WINDOW))
    y = np.arange(200) % 2
    rows[y == 0, 3:6] = np.frombuffer(b"aZb", np.uint8)
    rows[y == 1, 7:10] = np.frombuffer(b"bZa", np.uint8)
    model = L.train(rows[:150], y[:150], ["a", "b"], epochs=40)
    p = L.probabilities(model, rows[150:], L._pairs(model.answers, model.biases))
    assert (p.argmax(axis=1) == y[150:]).mean() > 0.95


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.98


def test_only_learnable_rows_are_learned_from(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "held out words", "secret") for i in held] + [(None, "no id", "none"), (3 if 3 not in held else 4, None, "void")]
    rows += [(i, "some plain words " * (i % 3 + 1), "en") for i in range(200) if i not in held] * 3 + [(1000, "12 34", "digits")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows, y, names = L.sample(docs, per_language=50)
    assert names == ["en"] and len(windows) <= 50 * L.PER_DOCUMENT and set(y.tolist()) == {0}
    assert {r["lang_pred"] for r in L.predicted_languages(docs).collect()} == {"en", "und"}


def test_awkward_rows(spark, awkward, nothing):
    rows = L.predicted_languages(awkward).collect()  # no language is known
    assert len(rows) == awkward.count() and {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}
    model = model_of()
    rows = L.predict(awkward, model).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5) or (r["doc_id"] is None and r["score"] == 0)) and 0 <= r["score"] <= 1
    assert L.predict(nothing, model).count() == 0 and L.predicted_languages(nothing).count() == 0
    odd = spark.createDataFrame([(1, "123 !?"), (2, "日本"), (3, "\U0001f600")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in L.predict(odd, model).orderBy("doc_id").collect()] == [True, False, True]
