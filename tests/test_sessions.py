from lorespark.streaming import sessions

RUN = "session string, at long, task string, capability string, runtime string, output string, verified boolean, agent string"
NOTE = "session string, at long, task string, hint string, score int"


def write_runs(spark, folder, rows):
    spark.createDataFrame(rows, RUN).write.mode("append").parquet(folder)


def numbers(log):
    return sorted((r["session"], r["seq"], r["body"]) for r in log.collect())


def test_documents_of_runs_and_reflections(spark):
    runs = spark.createDataFrame([("s", 1, "t1", "coding", "cpu", "done", True, "ann"), (None, 2, None, None, None, None, None, None)], RUN)
    a, b = (r.asDict() for r in sessions.executions(runs).orderBy("at").collect())
    assert (a["title"], a["body"], a["confidence"]) == ("coding on cpu", "done", 100)
    assert a["metadata"] == {"session": "s", "task": "t1", "capability": "coding", "runtime": "cpu", "verified": "true", "agent": "ann"}
    assert (b["session"], b["title"], b["body"], b["confidence"]) == ("", " on ", "", 0) and "agent" not in b["metadata"] and "task" not in b["metadata"]
    (c,) = sessions.reflections(spark.createDataFrame([("s", 1, "t1", "shorter", 70)], NOTE)).collect()
    assert (c["doc_type"], c["title"], c["body"], c["confidence"]) == ("reflection", "reflection for t1", "shorter", 70)


def test_numbers_go_on_over_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "SNAPSHOT", 2)
    source, folder = f"{tmp_path}/in", f"{tmp_path}/session"
    known = spark.createDataFrame([("a", 7), ("a", 9), ("old", 3)], "session string, seq int")
    want, last = [], {"a": 9, "old": 3}
    for run in range(6):
        names = ["a"] * (20 if run != 3 else 0) + (["b"] if run % 2 else []) + (["old"] if run == 5 else [])
        rows = [(s, 100 * run + i, "t", "c", "r", f"{run}.{i:02}", True, None) for i, s in enumerate(names)]
        write_runs(spark, source, rows)
        for s, at, *_, body, _, _ in rows:
            last[s] = last.get(s, 0) + 1
            want.append((s, last[s], body))
        log = sessions.record(sessions.executions(spark.readStream.schema(RUN).parquet(source)), folder, known)
        assert numbers(log) == sorted(want)
    assert [r["body"] for r in sessions.history(log, "b").collect()] == ["1.20", "3.00", "5.20"]
    assert sessions.history(log, "a", "reflection").count() == 0
    assert all(r["metadata"]["seq"] == str(r["seq"]) and r["id"] == f"{r['session']}-{r['seq']}" for r in log.collect())


def test_a_batch_written_again_keeps_its_numbers(spark, tmp_path):
    folder = f"{tmp_path}/session"
    docs = lambda k: sessions.executions(spark.createDataFrame([(s, i, "t", "c", "r", f"{k}.{i}", True, None) for s in ("a", "b") for i in range(3)], RUN))
    for n in (0, 1, 1, 2, 2):
        sessions.record_batch(docs(n), n, folder)
    want = sorted((s, 3 * n + i + 1, f"{n}.{i}") for s in ("a", "b") for n in range(3) for i in range(3))
    assert numbers(spark.read.parquet(f"{folder}/log")) == want
    sessions.record_batch(docs(3).where("false"), 3, folder)  # an empty batch
    sessions.record_batch(docs(4), 4, folder)
    assert max(r["seq"] for r in spark.read.parquet(f"{folder}/log").collect()) == 12
