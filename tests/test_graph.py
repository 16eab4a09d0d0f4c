import random
import re

import pytest
from pyspark.sql import functions as F

from lorespark.operators import graph as G
from lorespark.plans.graph_query import GraphQuery, edge_kind

NODE = "id string, kind string, label string, confidence int, date string, provenance string"
EDGE = "src string, dst string, kind string"


def graph(spark, nodes, edges):
    full = [(n, "concept", n, 50, None, None) if isinstance(n, str) else n for n in nodes]
    return spark.createDataFrame(full, NODE), spark.createDataFrame([(*e, "references") if len(e) == 2 else e for e in edges], EDGE)


def ranks(df):
    return {r["id"]: r["rank"] for r in df.collect()}


def test_star_hub_has_most_and_mass_is_one(spark):
    r = ranks(G.pagerank(*graph(spark, ["h", "a", "b", "c"], [("a", "h"), ("b", "h"), ("c", "h")]), iterations=30))
    assert max(r, key=r.get) == "h" and sum(r.values()) == pytest.approx(1)


def test_dangling_edges_do_not_leak_mass(spark):
    n, e = graph(spark, ["a", "b"], [("a", "b"), ("a", "missing")])
    clean = ranks(G.pagerank(n, e.where("dst <> 'missing'")))
    leaky = ranks(G.pagerank(n, e))
    assert sum(leaky.values()) == pytest.approx(1) and leaky["b"] == pytest.approx(clean["b"])


def test_personalized_on_every_node_is_pagerank(spark):
    n, e = graph(spark, ["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")])
    seeds = n.selectExpr("'q' as query_id", "id")
    assert ranks(G.personalized_pagerank(n, e, seeds, iterations=20)) == pytest.approx(ranks(G.pagerank(n, e, iterations=20)))


def test_personalized_follows_seeds_and_ignores_unknown(spark):
    n, e = graph(spark, list("abcxyz"), [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z")])
    r = ranks(G.personalized_pagerank(n, e, spark.createDataFrame([("q", "a"), ("q", "nobody")], "query_id string, id string")))
    assert set(r) == {"a", "b", "c"} and sum(r.values()) > 0.999  # nothing for nodes that no seed leads to
    assert G.personalized_pagerank(n, e, spark.createDataFrame([("q", "nobody")], "query_id string, id string")).count() == 0


def test_corroborated_node_outranks_one_path(spark):
    n, e = graph(spark, list("sabdce"), [("s", "a"), ("s", "b"), ("a", "d"), ("b", "d"), ("s", "c"), ("c", "e")])
    r = ranks(G.personalized_pagerank(n, e, spark.createDataFrame([("q", "s")], "query_id string, id string")))
    assert r["d"] > r["e"]


def test_bfs_orphans_and_removals(spark):
    n, e = graph(spark, ["a", "b", "c", "o"], [("a", "b"), ("b", "c"), ("a", "c"), ("c", "gone")])
    assert {(r["id"], r["hops"]) for r in G.bfs(n, e, spark.createDataFrame([("a",)], "id string")).collect()} == {("b", 1), ("c", 1)}
    assert [r["id"] for r in G.orphans(n, e).collect()] == ["o"]
    left, edges = G.remove_nodes(n, e, spark.createDataFrame([("c",)], "id string"))
    assert left.count() == 3 and edges.count() == 1
    assert G.remove_edge(e, "a", "b", "references").count() == 3


def test_merge_takes_the_higher_confidence(spark):
    ours = spark.createDataFrame([("1", "concept", "A", 60, None, None), ("2", "concept", "B", 70, None, None)], NODE)
    theirs = spark.createDataFrame([("9", "concept", "a", 95, None, None), ("8", "concept", "C", 80, None, None)], NODE)
    rows = {r["identity"]: r for r in G.merge_nodes(ours, theirs).collect()}
    assert len(rows) == 3 and rows["concept:a"]["confidence"] == 95 and rows["concept:a"]["label"] == "A" and rows["concept:a"]["conflict"]
    assert sum(r["added"] for r in rows.values()) == 1
    assert {r["identity"]: r["confidence"] for r in G.merge_nodes(ours, theirs, "ours").collect()}["concept:a"] == 60


def test_empty_graph(spark):
    n, e = graph(spark, [], [])
    assert G.pagerank(n, e, iterations=2).count() == 0
    assert GraphQuery(kind="*", related="*").run(n, e).count() == 0


@pytest.fixture(scope="module")
def demo(spark):
    nodes = [
        ("t", "concept", "Transformer", 96, "2017-06-12", None), ("a", "algorithm", "Attention", 93, "2015-09-01", None),
        ("r", "algorithm", "RNN", 55, None, None), ("v", "person", "Vaswani", 90, None, "paper"),
    ]
    return graph(spark, nodes, [("t", "a"), ("t", "r"), ("t", "v", "created_by"), ("t", "t", "depends_on")])


def labels(df, section="primary"):
    return [r["label"] for r in df.collect() if r["section"] == section]


def test_find_related_filter(demo):
    found = GraphQuery("Concept", "transf", related="Algorithm", where=lambda c: c >= 90).run(*demo)
    assert labels(found) == ["Transformer"] and labels(found, "related") == ["Attention"]


def test_via_and_self_loop(demo):
    assert labels(GraphQuery("concept", related="*", via="CreatedBy").run(*demo), "related") == ["Vaswani"]
    assert labels(GraphQuery("concept", related="*", via="DependsOn").run(*demo), "related") == []
    assert edge_kind("depends-on") == "depends_on" and edge_kind("Cites") == "cites"


def test_bounds_order_and_limit(demo):
    n, _ = demo
    assert labels(GraphQuery(before="2016-01-01").run(n)) == ["Attention"]
    assert labels(GraphQuery(after="2016-01-01").run(n)) == ["Transformer"]
    assert labels(GraphQuery(ascending=True, limit=1).run(n)) == ["RNN"]
    assert labels(GraphQuery(where=lambda c: (c > 50) & (c < 92)).run(n)) == ["Vaswani", "RNN"]
    assert labels(GraphQuery(limit=0).run(n)) == []


def test_a_hub_is_dealt_to_cells_and_ranks_stay(spark):
    """One node has half of all edges, out and in."""
    hub = [("h", f"n{i}", "k") for i in range(2000)] + [(f"n{i}", "h", "k") for i in range(0, 2000, 2)]
    rest = [(f"n{i}", f"n{(i * 7 + j) % 2000}", "k") for i in range(0, 2000, 4) for j in (1, 2)]
    edges = spark.createDataFrame(hub + rest, "src string, dst string, kind string")
    nodes = spark.createDataFrame([("h",)] + [(f"n{i}",) for i in range(2000)], "id string")
    links = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    dealt = G.in_cells(links, 50)
    assert dealt.count() == links.count() and dealt.where("src <> 'h'").agg(F.max("cells")).first()[0] == 1
    sizes = sorted(r["count"] for r in dealt.repartition(4, "src", "cell").groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[1]
    seeds = nodes.where("id in ('h', 'n8')").select(F.lit("q").alias("query_id"), "id")
    for by, tp in (([], nodes.select("id", F.lit(1.0 / 2001).alias("tp"))), (["query_id"], seeds.withColumn("tp", F.lit(0.5)))):
        one, many = ({r["id"]: r["rank"] for r in G._rank(nodes, edges, tp, by, 0.85, 4, per_cell).collect()} for per_cell in (10**6, 50))
        assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-12
        assert abs(sum(many.values()) - 1) < 1e-9


def test_rounds_go_over_nodes_that_links_lead_to(spark, monkeypatch):
    """Ranks equal a plain power iteration; the links of nodes without any to them are summed once, and no round reads them."""
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(60)]
    pairs = [(f"n{i}", f"n{rng.randrange(30, 60)}") for i in range(30) for _ in range(6)]  # these are led to by none
    pairs += [(f"n{rng.randrange(30, 40)}", f"n{rng.randrange(30, 50)}") for _ in range(25)] + [("n31", "n31"), ("n30", "gone"), ("gone", "n40"), ("n0", "n31"), ("n0", "n31")]
    n, e = graph(spark, ids, pairs)
    seeds = {"a": {"n0": 0.5, "n31": 0.5}, "b": {"n59": 1.0}, "c": {"n3": 1.0}}
    live = [p for p in pairs if "gone" not in p]
    outs = {i: sum(s == i for s, _ in live) for i in ids}

    def plain(tp):
        rank = dict(tp)
        for _ in range(2):
            lost = sum(r for i, r in rank.items() if not outs[i])
            new = {i: (0.15 + 0.85 * lost) * tp.get(i, 0.0) for i in ids}
            for s, d in live:
                new[d] += 0.85 * rank.get(s, 0.0) / outs[s]
            rank = new
        return rank

    read = []
    whole = G.in_cells
    monkeypatch.setattr(G, "in_cells", lambda links, per_cell: read.append(links.count()) or whole(links, per_cell))
    for few in (10, 10**6):
        tp = spark.createDataFrame([(q, i, v) for q, s in seeds.items() for i, v in s.items()], "query_id string, id string, tp double")
        got = {(r["query_id"], r["id"]): r["rank"] for r in G._rank(n, e, tp, ["query_id"], 0.85, 2, few).collect()}
        want = {(q, i): r for q, s in seeds.items() for i, r in plain(s).items()}
        assert all(got.get(k, 0.0) == pytest.approx(r, abs=1e-12) for k, r in want.items())
        assert all(k in want for k in got)
    uniform = plain({i: 1 / 60 for i in ids})
    assert ranks(G.pagerank(n, e, iterations=2)) == pytest.approx(uniform, abs=1e-12)
    inner = {s for s, d in live if s in {d for _, d in live}}
    assert read == [len({p for p in live if p[0] in inner})] * 3 and 0 < read[0] < 40


@pytest.mark.parametrize("few", [1, 10**6])
def test_estimated_sizes_of_rounds_do_not_square(spark, capsys, few):
    n, e = graph(spark, ["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")])
    shares = spark.createDataFrame([("q", "a", 1.0), ("p", "b", 1.0)], "query_id string, id string, tp double")

    def digits(rounds):
        G._rank(n, e, shares, ["query_id"], 0.85, rounds, few).explain("cost")
        return max(int(x) for x in re.findall(r"sizeInBytes=[\d.]+E\+(\d+)", capsys.readouterr().out) or [1])

    assert digits(9) < 3 * digits(4)  # each round's estimate was the square of the last one's: of 30 rounds it filled the driver


def test_rounds_over_few_links_start_no_jobs_of_their_own(spark):
    n, e = graph(spark, list("abcdo"), [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("c", "d")])
    seeds = spark.createDataFrame([("q", "a"), ("p", "b"), ("p", "d"), ("r", "o")], "query_id string, id string")

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"rounds {rounds}", "")
        got = {(r["query_id"], r["id"]): r["rank"] for r in G.personalized_pagerank(n, e, seeds, iterations=rounds).collect()}
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds {rounds}"))

    (short, first), (long, second) = jobs(1), jobs(40)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert first == second > 0
    assert {k[1] for k in long if k[0] == "q"} == set("abcd") and {k for k in long if k[0] == "r"} == {("r", "o")}
    assert all(sum(v for k, v in got.items() if k[0] == q) == pytest.approx(1) for got in (short, long) for q in "pqr")
