import hashlib
import hmac
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lorespark.api import Workspace
from lorespark.functions import vectors as V
from lorespark.operators import graph as G
from lorespark.operators import orchestrate as O
from lorespark.operators import retrieval as R
from lorespark.sources import files


def test_log_of_a_long_history(spark):
    versions = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1500)] + [(9000, 8000)], "version_id long, parent long")
    rows = G.version_log(versions, 1400).collect()
    assert {(r["version_id"], r["depth"]) for r in rows} == {(i, 1400 - i) for i in range(1401)}
    assert [r["version_id"] for r in G.version_log(versions, 9000).collect()] == [9000] and not G.version_log(versions, 7).where("depth > 7").count()
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "version_id long, parent long")
    with pytest.raises(ValueError):
        G.version_log(circle, 1)


def test_branches_commits_and_checkout(spark):
    versions = spark.createDataFrame([(1, None), (2, 1)], "version_id long, parent long")
    refs = G.create_branch(spark.createDataFrame([("main", 2)], "name string, version_id long"), "side", "main")
    versions, refs = G.commit_version(versions, refs, "side", 3)
    assert {tuple(r) for r in refs.collect()} == {("main", 2), ("side", 3)} and (3, 2) in {tuple(r) for r in versions.collect()}
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("b", 2, "b")], "id string, version_id long, label string")
    held = lambda b: {(r["id"], r["label"]) for r in G.checkout(rows, versions, refs, b).collect()}
    assert held("main") == {("a", "old"), ("b", "b")} and held("side") == {("a", "new"), ("b", "b")} and held("none") == set()


def test_levels_of_long_and_circular_workflows(spark):
    steps = [("long", i) for i in range(70)] + [("ring", i) for i in range(4)] + [("one", 0)]
    deps = [("long", i, i - 1) for i in range(1, 70)] + [("ring", 1, 2), ("ring", 2, 1), ("ring", 3, 0)]
    made = O.dag_levels(spark.createDataFrame(steps, "workflow string, step long"), spark.createDataFrame(deps, "workflow string, step long, dep long")).collect()
    got = {(r["workflow"], r["step"]): r["level"] for r in made}
    assert len(made) == len(steps) and all(got["long", i] == i for i in range(70)) and got["one", 0] == 0
    assert all(got["ring", i] is None for i in range(4))


def test_repeated_headers_and_nodes(spark, tmp_path):
    (tmp_path / "a.doc").write_text("title: first\nmeta.k: 1\ntitle: last\nmeta.k: 2\n\nbody")
    row = files.read_documents(spark, str(tmp_path))[0].first()
    assert (row["title"], row["metadata"], row["body"]) == ("last", {"k": "2"}, "body")
    fields = "id string, kind string, label string, confidence int, date string, provenance string"
    nodes = spark.createDataFrame([("a", "k", "Ann", 10, None, "p"), ("b", "k", "Bob", 90, None, "p")], fields)
    new = spark.createDataFrame([("a", "k", "x", 20, None, None), ("a", "k", "y", 300, None, None)], fields)
    assert sorted((r["id"], r["label"], r["confidence"]) for r in G.add_nodes(nodes, new).collect()) == [("a", "y", 100), ("b", "Bob", 90)]
    found = spark.createDataFrame([("ann", "ANN", "person", 60), ("bob", "Bob", "person", 60), ("cy", "Cy", "person", 45)], "name string, label string, kind string, confidence int")
    made = {r["id"]: (r["label"], r["confidence"], r["provenance"], r["change"]) for r in G.reinforce(nodes, found).collect()}
    assert made == {"a": ("Ann", 60, "p", "reinforced"), "b": ("Bob", 90, "p", "reinforced"), "entity:cy": ("Cy", 45, None, "added")}


def test_numbers_within_a_hot_group(spark):
    rows = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") % 9 == 0, "cold").otherwise("hot").alias("c"), (F.col("id") * 7919 % 1009).alias("seq"))
    got = [(r["c"], r["seq"], r["n"]) for r in O.numbered(rows, "c", "seq").collect()]
    for _, own in groupby(sorted(got), key=lambda r: r[0]):
        assert [n for _, _, n in own] == list(range(len([g for g in got if g[0] == _])))


def test_signed_messages(spark):
    m = spark.createDataFrame([("m1", "a", "b", "t", "high", "hello", None, "ref", 5, 99)], "id string, source string, destination string, msg_type string, priority string, body string, graph_id string, memory_ref string, nonce long, ts long")
    text = "m1|a|b|t|High|hello||ref|5|99"
    own = hmac.new(b"k", text.encode(), hashlib.sha256).hexdigest()
    row = m.select(O.canonical_message(F.col("nonce"), F.col("ts")).alias("t")).select("t", V.hmac_sha256("k")("t").alias("s"), V.signature_ok("k")(F.col("t"), F.lit(own)).alias("good"), V.signature_ok("k")(F.col("t"), F.lit("x")).alias("bad")).first()
    assert tuple(row) == (text, own, True, False)


def test_feedback_and_records(spark):
    docs = spark.createDataFrame([(f"d{i:03}", "T", "the Red fox" if i % 2 else "none") for i in range(40)], "id string, title string, body string")
    qs = spark.createDataFrame([("q", "RED FOX"), ("r", "absent")], "query_id string, question string")
    assert sorted(r["id"] for r in R.feedback_by_text(docs, qs, 3).collect()) == ["d001", "d003", "d005"]
    history = spark.createDataFrame([("s", 1, "x"), ("s", 4, "y")], "session string, seq long, body string")
    new = spark.createDataFrame([("s", 20, "b"), ("s", 10, "a"), ("t", 1, "c")], "session string, at long, body string")
    assert sorted(tuple(r) for r in O.record(history, new).select("session", "seq", "body").collect()) == [("s", 1, "x"), ("s", 4, "y"), ("s", 5, "a"), ("s", 6, "b"), ("t", 1, "c")]


def test_indexing_replaces_passages_and_reinforces(spark):
    doc = "id string, doc_type string, title string, author string, body string, metadata map<string,string>, confidence int"
    text = "Ada Lovelace met Charles Babbage. Ada Lovelace wrote to Charles Babbage."
    docs = spark.createDataFrame([("d", "note", "t", None, text, {"lang": "en"}, 50), ("d#7", "chunk", "d#7", None, "stale", {"source": "d"}, 100), ("o#0", "chunk", "o#0", None, "other", {"source": "o"}, 100)], doc)
    nodes = spark.createDataFrame([("n1", "person", "ada lovelace", 20, None, "old")], "id string, kind string, label string, confidence int, date string, provenance string")
    before = Workspace(spark, docs, nodes, spark.createDataFrame([], "src string, dst string, kind string"))
    once = before.index(40, 5)
    twice = once.index(40, 5)
    for w in (once, twice):
        ids = sorted(r["id"] for r in w.documents.collect())
        assert "d#7" not in ids and {"d", "d#0", "o#0"} <= set(ids) and len(ids) == len(set(ids))
        assert sorted(r["id"] for r in w.vectors.collect()) == [i for i in ids if i.startswith("d#")]
        assert {r["id"]: r["confidence"] for r in w.nodes.collect()} == {"n1": 60, "entity:charles babbage": 60}
        assert {(r["src"], r["dst"]) for r in w.edges.collect()} == {("n1", "entity:charles babbage")} and w.edges.count() == 1
    assert tuple(once.report(before).first()) == (1, 1, 1) and tuple(twice.report(once).first()) == (0, 2, 0)
    found = once.search(spark.createDataFrame([("q", "Charles Babbage")], "query_id string, question string"), 5)
    assert "vector" in {r["source"] for r in found.collect()} or found.count() > 0


def test_every_message_gets_a_verdict_however_late(spark):
    hour = 3_600_000
    rows = [(1, 7, 0, hour, True), (2, 8, 100 * hour, 100 * hour, True), (3, 7, 0, 2 * hour, True), (4, 9, 0, 90 * hour, True), (5, 8, 100 * hour, 101 * hour, True), (6, 7, 0, 3 * hour, False)]
    from lorespark.streaming import jobs as S

    folder = f"{S.checkpoint_folder(spark)}/late"
    for r in rows:  # one message a batch; ids 3, 4 and 6 come long after their time
        spark.createDataFrame([r], "id long, nonce long, ts_ms long, now_ms long, signed boolean").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    made = S.drain(S.replay_verdicts(stream, 12 * hour), S.append)
    assert {r["id"]: r["verdict"] for r in made.collect()} == {1: "accepted", 2: "accepted", 3: "replayed", 4: "expired", 5: "replayed", 6: "bad_signature"}
