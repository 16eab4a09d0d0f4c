import random

import pytest

from lorespark.operators import orchestrate as O
from lorespark.operators import retrieval as R
from lorespark.sources import files
from lorespark.streaming import jobs as S


def documents(spark, rows):
    return spark.createDataFrame([(i, t, b, 100) for i, t, b in rows], "id string, title string, body string, confidence int")


def asked(spark, text):
    return spark.createDataFrame([("q", text)], "query_id string, question string")


def order(df):
    return [r["id"] for r in df.orderBy("score", ascending=False).collect()]


def test_title_rare_terms_and_length(spark):
    docs = documents(spark, [("t", "photon", "light"), ("b", "light", "photon words"), ("c", "other", "light light")])
    assert order(R.keyword_hits(docs, asked(spark, "photon")))[0] == "t"
    long = documents(spark, [("rare", "x", "zebra " + "filler " * 200), ("common", "x", "kernel"), ("k2", "x", "kernel kernel"), ("k3", "x", "kernel")])
    assert order(R.keyword_hits(long, asked(spark, "zebra kernel")))[0] == "rare"
    assert R.keyword_hits(docs, asked(spark, "nothing")).count() == 0


def test_fusion_by_identity_and_name(spark):
    hit = "query_id string, id string, title string, snippet string, score double, source string"
    rows = [("q", "1", "Kernel", "s", 3.0, "keyword"), ("q", "2", "Kernel", "s", 2.0, "keyword"), ("q", "3", "Graph", "s", 1.0, "keyword"), ("q", None, "kernel", "n", 1.0, "graph"), ("q", None, "graph", "n", 2.0, "graph")]
    out = {(r["id"], r["title"]): r["score"] for r in R.fuse(spark.createDataFrame(rows, hit), 10).collect()}
    assert len(out) == 4 and (None, "kernel") in out
    assert out[("3", "Graph")] == pytest.approx(1 / 63 + 1 / 61, abs=1e-6)


def test_mmr(spark):
    rows = [("q", "1", "Kernel memory", "a b", 1.0, 1), ("q", "2", "Kernel memory", "a b", 0.99, 2), ("q", "3", "Scheduler", "c d", 0.5, 3)]
    hits = spark.createDataFrame(rows, "query_id string, id string, title string, snippet string, score double, rank int")
    place = lambda lam: [r["id"] for r in R.mmr(hits, lam, 2).orderBy("place").collect()]
    assert place(1.0) == ["1", "2"] and place(0.5) == ["1", "3"]


def test_metrics(spark):
    runs = spark.createDataFrame([("q", i + 1, x) for i, x in enumerate("axby")], "query_id string, rank int, item string")
    truth = spark.createDataFrame([("q", x) for x in "abc"], "query_id string, item string")
    m = R.ranking_metrics(runs, truth, 4).first()
    assert m["precision"] == 0.5 and m["recall"] == pytest.approx(2 / 3) and m["ap"] == pytest.approx(5 / 9) and m["rr"] == 1


def test_synonyms(spark):
    terms = R.synonym_terms(asked(spark, "scheduler priorities"), R.synonym_table(spark), 3)
    assert [r["term"] for r in terms.orderBy("place").collect()] == ["dispatch", "dispatcher", "importance"]
    assert R.expand_queries(asked(spark, "x y"), terms.where("false")).first()["question"] == "x y"


def test_policy_and_consensus(spark):
    req = spark.createDataFrame([(1, "s", ["r"], "graph.read", {}), (2, "s", [], "graph.read", {"a": "1"}), (3, "s", ["r"], "graph.read", {"a": "0"}), (4, "s", [], "x", {})], "request_id int, subject string, roles array<string>, action string, attributes map<string,string>")
    grants = spark.createDataFrame([("r", "graph.*")], "role string, permission string")
    rules = spark.createDataFrame([("graph.read", "a", "1", False), ("graph.read", "a", "0", True)], "action string, attribute_key string, attribute_value string, deny boolean")
    assert {r["request_id"]: r["decision"] for r in O.evaluate_policy(req, grants, rules).collect()} == {1: "allow", 2: "allow", 3: "deny", 4: "deny"}
    seen = spark.createDataFrame([("t", 1, 95, "A"), ("t", 2, 95, "A"), ("t", 3, 20, "B")], "task string, seq int, score int, hint string")
    c = O.consensus(seen, "task").first()
    assert c["score"] == 70 and c["n_hints"] == 2 and c["majority_hint"] == "A" and c["agreement"] == pytest.approx(192 / 213)


def test_graph_file_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "concept", "B\tx", 90, None, "p"), ("a", "person", "A", 5, "2020", None)], "id string, kind string, label string, confidence int, date string, provenance string")
    edges = spark.createDataFrame([("a", "b", "references")], "src string, dst string, kind string")
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = files.read_graph(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in n.collect()} == {("b", "concept", "B x", 90, None, "p"), ("a", "person", "A", 5, "2020", None)}
    assert e.count() == 1


def test_document_files_round_trip(spark, tmp_path):
    rows = [("d1", "note", "a title: with\nlines", None, "body\n\nmore", {"k": "v\\n"}, [0.5, 1.0], 7)]
    docs = spark.createDataFrame(rows, "id string, doc_type string, title string, author string, body string, metadata map<string,string>, embedding array<float>, confidence int")
    for r in files.document_files(docs).collect():
        (tmp_path / f"{r['id']}.doc").write_text(r["content"])
    (tmp_path / "bad.doc").write_bytes(b"\xff\xfe")
    good, bad = files.read_documents(spark, str(tmp_path))
    assert [tuple(r) for r in good.collect()] == [tuple(rows[0])]
    assert bad.count() == 1


def test_definitions():
    steps = files.workflow_steps("workflow: w\nstep a: retrieval\nstep b: reasoning <- a\n")
    assert steps == [(0, "a", "retrieval", []), (1, "b", "reasoning", ["a"])]
    for bad in ("workflow: w\nstep a: x <- b", "workflow: w\nstep a: x\nstep a: y", "workflow: w", "step a: x"):
        with pytest.raises(ValueError):
            files.workflow_steps(bad)
    assert files.agent_manifest("id: a\ncapabilities: [x, y]\ntools:\n  - t") == {"id": "a", "capabilities": ["x", "y"], "tools": ["t"]}


def test_replay_guard_against_a_plain_loop(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), rng.randrange(5000), 0) for i in range(300)]
    rows = [(i, n, t, t + rng.choice((0, 100, 900, 1500))) for i, n, t, _ in rows]
    spark.createDataFrame(rows, "id long, nonce long, ts_ms long, now_ms long").selectExpr("*", "id % 7 <> 0 as signed").coalesce(1).write.parquet(str(tmp_path / "m"))
    got = {r["id"]: r["verdict"] for r in S.drain(S.replay_verdicts(S.read_stream(spark, str(tmp_path / "m")), 1000), S.append).collect()}
    last, want = {}, {}
    for i, n, t, now in sorted(rows, key=lambda r: (r[3], r[0])):
        if i % 7 == 0:
            want[i] = "bad_signature"
        elif abs(now - t) > 1000:
            want[i] = "expired"
        elif n in last and now - last[n] <= 1000:
            want[i] = "replayed"
        else:
            want[i], last[n] = "accepted", t
    assert got == want


def test_fusion_of_long_lists_equals_ranking_them_whole(spark):
    import random

    from lorespark.operators import retrieval as R

    rng = random.Random(5)
    rows = []
    for q in ("a", "b"):
        for source, many in (("keyword", 900), ("vector", 700), ("graph", 500)):
            for i in rng.sample(range(1200), many):
                ident = None if source == "graph" else f"d{i}"
                rows.append((q, ident, f"Name {i if i % 50 else 0}", f"{source} text", round(rng.random() * 5, 9), source))
    rows.append(("c", "d1", "One", "alone", 1.0, "keyword"))

    def plain(limit):
        out = []
        for q in ("a", "b", "c"):
            mine = [r for r in rows if r[0] == q]
            names = {}
            for r in mine:
                if r[1] is not None:
                    names.setdefault(r[2].lower(), set()).add(r[1])
            sums, best = {}, {}
            for k, source in enumerate(("keyword", "vector", "graph")):
                ordered = sorted((r for r in mine if r[5] == source), key=lambda r: (-r[4], r[2], r[1] or "", r[3]))
                for rank, r in enumerate(ordered, 1):
                    name = r[2].lower()
                    key = r[1] or (next(iter(names[name])) if len(names.get(name, ())) == 1 else "name:" + name)
                    sums[key] = sums.get(key, 0) + 1 / (60 + rank)
                    best[key] = max(best.get(key, (False,)), (r[1] is not None, r[4], -k, -rank, r[1], r[2]))
            listed = sorted(((-round(s, 9), best[key][5], best[key][4] or "") for key, s in sums.items()))[:limit]
            out += [(q, t, i, -s) for s, t, i in listed]
        return out

    hits = spark.createDataFrame(rows, "query_id string, id string, title string, snippet string, score double, source string").repartition(6)
    for limit in (1, 3):
        made = [(r["query_id"], r["title"], r["id"] or "", r["score"]) for r in R.fuse(hits, limit).orderBy("query_id", "rank").collect()]
        assert made == plain(limit)
