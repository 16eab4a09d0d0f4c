import pytest

from lorespark.operators import session_graph as S

TURNS = [
    ("s", 1, "assistant", "Kernel boots"),
    ("s", 2, "user", "Plan the Scheduler"),
    ("s", 3, "assistant", "Scheduler depends on Memory. Acme Corp"),
    ("s", 4, "user", "More"),
    ("s", 5, "tool", "MEMORY uses Scheduler and Memory calls Scheduler"),
    ("s", 6, "assistant", None),
    ("t", 1, "user", "Memory near Scheduler"),
]


@pytest.fixture(params=[1, 4096])
def graph(spark, request, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", request.param)
    return S.session_graph(spark.createDataFrame(TURNS, "session string, seq int, role string, body string"))


def test_counts_are_pooled_and_the_first_extraction_is_the_source(graph):
    nodes = {(r["session"], r["name"]): (r["label"], r["kind"], r["confidence"], r["provenance"], r["n_calls"]) for r in graph.nodes.collect()}
    assert nodes[("s", "kernel")] == ("Kernel", "concept", 45, "run:", 2)
    assert nodes[("s", "scheduler")] == ("Scheduler", "concept", 90, "run:Plan the Scheduler", 3)
    assert nodes[("s", "memory")] == ("Memory", "concept", 75, "run:Plan the Scheduler", 3)
    assert nodes[("s", "acme corp")] == ("Acme Corp", "organization", 45, "run:Plan the Scheduler", 2)
    assert nodes[("t", "memory")] == ("Memory", "concept", 45, "run:Memory near Scheduler", 2)


def test_edges_are_the_session_s_own(graph):
    edges = {(r["session"], r["src"], r["dst"]): r["kind"] for r in graph.edges.collect()}
    assert edges[("s", "scheduler", "memory")] == "depends_on"
    assert edges[("s", "memory", "scheduler")] == "references"
    assert edges[("t", "memory", "scheduler")] == "related_to"


def test_report(graph):
    rows = {(r["session"], r["call"]): (r["added"], r["reinforced"]) for r in graph.report().collect()}
    assert rows[("s", 0)] == (1, 0) and rows[("s", 1)] == (4, 0) and rows[("s", 2)] == (1, 2) and rows[("s", 3)] == (0, 6)


def test_empty(spark):
    none = S.session_graph(spark.createDataFrame([], "session string, seq int, role string, body string"))
    assert none.nodes.count() == none.edges.count() == none.report().count() == 0
