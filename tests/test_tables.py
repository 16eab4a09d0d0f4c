import pytest

from lorespark.functions import tables
from lorespark.operators import corpus as C
from lorespark.operators import retrieval as R

TEXT = "One sentence here. Another one!\n\nA second paragraph, with 2 + 2 = 4 and 3 * 3 = 8.\n\n" + "x" * 50


@pytest.fixture
def docs(spark):
    tables.register(spark)
    rows = spark.createDataFrame([("1", TEXT), ("2", None), ("3", ""), ("4", "short")], "id string, body string")
    rows.createOrReplaceTempView("table_docs")
    yield rows
    spark.catalog.dropTempView("table_docs")


@pytest.mark.parametrize(("how", "size", "overlap"), [("recursive", 20, 5), ("adaptive", 30, 0), ("paragraph", 800, 3)])
def test_sql_equals_the_operator(spark, docs, how, size, overlap):
    found = spark.sql(f"SELECT id, at, chunk FROM table_docs, LATERAL text_chunks(body, how => '{how}', size => {size}, overlap => {overlap})")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, C.chunk_rows(docs, how, size, overlap).collect()))
    assert {r["id"] for r in found.collect()} == {"1", "4"}


def test_rows_without_chunks_stay_in_an_outer_join(spark, docs):
    found = spark.sql("SELECT id, at FROM table_docs LEFT JOIN LATERAL text_chunks(body) ON true").collect()
    assert {(r["id"], r["at"]) for r in found} == {("1", 0), ("2", None), ("3", None), ("4", 0)}


@pytest.mark.parametrize(("arguments", "told"), [("body, how => 'other'", "how must be one of"), ("body, size => 0", "size must be at least 1"), ("body, size => length(body)", "size must be a constant"), ("body, overlap => -1", "overlap must be at least 0"), ("1", "text must be a string")])
def test_arguments_are_judged_at_analysis(spark, docs, arguments, told):
    with pytest.raises(Exception, match=told):
        spark.sql(f"SELECT * FROM table_docs, LATERAL text_chunks({arguments})")


def test_equations(spark, docs):
    found = spark.sql("SELECT id, at, equation, holds FROM table_docs, LATERAL text_equations(body)").collect()
    assert sorted(map(tuple, found)) == [("1", 0, "2 + 2 = 4", True), ("1", 1, "3 * 3 = 8", False)]


def test_another_embedder(spark, docs):
    rows = docs.selectExpr("id", "body AS text")
    lengths = R.embedder(lambda texts: [(len(t), 0, 0) for t in texts], 3)
    assert {r["id"]: r["embedding"] for r in lengths(rows).collect()} == {"1": [1.0, 0.0, 0.0], "2": [0.0] * 3, "3": [0.0] * 3, "4": [1.0, 0.0, 0.0]}
    with pytest.raises(Exception, match="a vector has 2 numbers, not 3"):
        R.embedder(lambda texts: [(1, 2) for _ in texts], 3)(rows).collect()


def test_workspace_takes_an_embedder(spark):
    from lorespark.api import Workspace

    docs = spark.createDataFrame([("d", "note", "T", None, "Kernel text", {}, 50)], "id string, doc_type string, title string, author string, body string, metadata map<string,string>, confidence int")
    nodes = spark.createDataFrame([], "id string, kind string, label string, confidence int, date string, provenance string")
    edges = spark.createDataFrame([], "src string, dst string, kind string")
    made = Workspace(spark, docs, nodes, edges, embed=R.embedder(lambda texts: [(3, 4) for _ in texts], 2)).index()
    assert [r["embedding"] for r in made.vectors.collect()] == [[0.6, 0.8]]
