from lorespark.streaming import feed
from lorespark.streaming import jobs as S

NODE = "id string, kind string, label string, confidence int"
EDGE = "src string, dst string, kind string"


def test_feed_is_followed_and_replays_change_nothing(spark, tmp_path):
    one = spark.createDataFrame([("a", "k", "A", 1), ("b", "k", "B", 2), ("c", "k", None, None)], NODE)
    two = spark.createDataFrame([("a", "k", "A2", 1), ("c", "k", None, None), ("d", "k", "D", 4)], NODE)
    edges = spark.createDataFrame([("a", "c", "r"), ("a", "c", "r")], EDGE)
    folder = f"{tmp_path}/feed"
    feed.publish(feed.node_changes(one.where("false"), one), folder, 1)
    feed.publish(feed.node_changes(one, two), folder, 2)
    feed.publish(feed.edge_changes(edges.where("false"), edges), folder, 3)
    feed.publish(feed.edge_changes(edges.where("false"), edges), folder, 3)  # a repeated attempt
    want = [("doc-c", "c", None, None, 3), ("node:a", "a", "A2", 1, 3), ("node:d", "d", "D", 4, 2)]
    known = spark.createDataFrame([("doc-c", "c"), ("x", "unknown")], "id string, node string")
    for files in (1, 1000):
        made = feed.follow_to(feed.follow(spark, folder, files), known)
        assert sorted(tuple(r) for r in made.collect()) == want
    out, rows = f"{tmp_path}/out", spark.read.schema(feed.FEED).parquet(folder)
    for n in (0, 1, 1, 0):  # batches written again
        S.append(feed.touched(rows.where("version <= 2" if n == 0 else "version = 3")), n, out)
    assert sorted(tuple(r) for r in feed.reindexed(spark.read.parquet(out), known).collect()) == want


def test_unchanged_graphs_give_no_change(spark):
    one = spark.createDataFrame([("a", "k", "A", 1)], NODE)
    edges = spark.createDataFrame([("a", "c", "r")], EDGE)
    assert feed.node_changes(one, one).count() == 0 and feed.edge_changes(edges, edges).count() == 0
    assert [r["change"] for r in feed.edge_changes(edges, edges.where("false")).collect()] == ["removed", "removed"]


def test_edges_of_two_versions_are_grouped_not_joined(spark):
    one = spark.createDataFrame([("a", "b", "r"), ("a", "b", "r"), ("b", "c", "r"), ("x", None, "r"), ("c", "a", "s")], EDGE)
    two = spark.createDataFrame([("a", "b", "r"), ("b", "c", "t"), ("x", None, "r"), ("c", "a", "s"), ("c", "a", "s")], EDGE)
    made = feed.edge_changes(one, two)
    want = [("added", "b", "t"), ("added", "c", "t"), ("removed", "b", "r"), ("removed", "c", "r")]
    assert sorted((r["change"], r["node"], r["kind"]) for r in made.collect()) == want
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
