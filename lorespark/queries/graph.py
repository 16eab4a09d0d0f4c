"""Queries over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import graph as G
from lorespark.plans.graph_query import GraphQuery
from lorespark.queries.base import query
from lorespark.session import table
from lorespark.sources import adapters as A

MATCH = "id, label, kind, confidence, date, provenance"


def _sql(primary: str, related: str | None = None, order: str = "DESC", limit: int | None = None, via: str | None = None) -> str:
    cut = f" LIMIT {limit}" if limit is not None else ""
    out = f"WITH {A.NODES_SQL}, {A.EDGES_SQL}, p AS (SELECT * FROM nodes WHERE {primary})\n"
    out += f"SELECT * FROM (SELECT 'primary' AS section, {MATCH} FROM p ORDER BY confidence {order}, label, id{cut})"
    if related is not None:
        edge = f" AND e.kind = '{via}'" if via else ""
        reached = f"SELECT e.dst FROM edges e JOIN p ON e.src = p.id WHERE e.src <> e.dst{edge}"
        out += f"\nUNION ALL SELECT * FROM (SELECT 'related' AS section, {MATCH} FROM nodes WHERE id IN ({reached}) AND {related} ORDER BY confidence {order}, label, id{cut})"
    return out


def _run(spark: SparkSession, sf_dir: str, q: GraphQuery) -> DataFrame:
    return q.run(A.nodes(spark, sf_dir), A.edges(spark, sf_dir) if q.related else None)


@query(_sql("kind = 'supplier'", limit=50))
def kql_find_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GraphQuery(kind="Supplier", limit=50))


@query(_sql("contains(lower(label), 'ia')"))
def kql_find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GraphQuery(text="IA"))


@query(_sql("true", limit=100))
def kql_find_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GraphQuery(kind="*", limit=100))


@query(_sql("kind = 'customer' AND NOT (confidence < 20) AND (confidence < 30 OR confidence > 90) AND confidence <> 95"))
def kql_filter_and_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GraphQuery(kind="customer", where=lambda c: ~(c < 20) & ((c < 30) | (c > 90)) & (c != 95)))


@query(_sql("kind = 'customer' AND date < '2023-01-01' AND date > '1992-02-01'"))
def kql_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GraphQuery(kind="customer", before="2023-01-01", after="1992-02-01"))


@query(_sql("kind = 'part'", order="ASC", limit=25))
def kql_order_asc_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GraphQuery(kind="part", ascending=True, limit=25))


@query(_sql("kind = 'supplier' AND confidence >= 80", "confidence >= 80", limit=200))
def kql_related_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GraphQuery(kind="supplier", related="*", where=lambda c: c >= 80, limit=200))


@query(_sql("kind = 'supplier' AND confidence >= 50", "kind = 'nation' AND confidence >= 50", limit=20, via="depends_on"))
def kql_related_via(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GraphQuery(kind="Supplier", related="Nation", via="DependsOn", where=lambda c: c >= 50, limit=20))


@query(f"WITH {A.NODES_SQL} SELECT label, kind, confidence, provenance AS src FROM nodes WHERE kind = 'nation' AND confidence > 40")
def kql_return_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, sf_dir, GraphQuery(kind="nation", where=lambda c: c > 40))
    return found.select("label", "kind", "confidence", F.col("provenance").alias("src"))


@query(
    f"WITH {A.NODES_SQL}, {A.EDGES_SQL}, p AS (SELECT id FROM nodes WHERE kind = 'supplier' AND confidence > 70), r AS (SELECT id FROM nodes WHERE kind = 'nation' AND confidence > 70 AND id IN (SELECT dst FROM edges JOIN p ON src = id)), "
    "a AS MATERIALIZED (SELECT id FROM p UNION SELECT id FROM r) SELECT src, dst, kind FROM edges SEMI JOIN (SELECT id AS src FROM a) USING (src) SEMI JOIN (SELECT id AS dst FROM a) USING (dst)"
)
def kql_return_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = GraphQuery(kind="supplier", related="nation", where=lambda c: c > 70)
    return q.edges_among(A.nodes(spark, sf_dir), A.edges(spark, sf_dir))


@query(f"WITH {A.NODES_SQL}, {A.EDGES_SQL} SELECT e.src, e.kind AS edge, n.id, n.label FROM edges e JOIN nodes n ON e.dst = n.id WHERE e.src IN (SELECT id FROM nodes WHERE kind = 'supplier' AND confidence >= 90)")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = A.nodes(spark, sf_dir)
    return G.neighbors(nodes, A.edges(spark, sf_dir), nodes.where("kind = 'supplier' and confidence >= 90")).select("src", "edge", "id", "label")


@query(
    f"WITH RECURSIVE {A.NODES_SQL}, {A.EDGES_SQL}, walk AS (SELECT 'supplier-1' AS id, 0 AS hops UNION SELECT e.dst, hops + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE hops < 6) "
    "SELECT id, min(hops)::INTEGER AS hops FROM walk WHERE hops > 0 AND id <> 'supplier-1' AND id IN (SELECT id FROM nodes) GROUP BY id"
)
def graph_bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("supplier-1",)], "id string")
    return G.bfs(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), start)


@query(f"WITH {A.NODES_SQL}, {A.EDGES_SQL} SELECT id, kind FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE kind = 'implements') AND id NOT IN (SELECT dst FROM edges WHERE kind = 'implements')")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.orphans(A.nodes(spark, sf_dir), A.edges(spark, sf_dir).where("kind = 'implements'")).select("id", "kind")


@query(f"WITH {A.NODES_SQL}, {A.EDGES_SQL}, gone AS (SELECT id FROM nodes WHERE kind = 'nation' AND confidence < 50) SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def graph_remove_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = A.nodes(spark, sf_dir)
    return G.remove_nodes(nodes, A.edges(spark, sf_dir), nodes.where("kind = 'nation' and confidence < 50"))[1]


@query(f"WITH {A.NODES_SQL}, {A.EDGES_SQL} SELECT n.id, count(m.id)::BIGINT AS out_degree FROM nodes n LEFT JOIN edges e ON e.src = n.id LEFT JOIN nodes m ON m.id = e.dst GROUP BY n.id")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(A.nodes(spark, sf_dir), A.edges(spark, sf_dir))


def rank_sql(teleport: str, iterations: int) -> str:
    """The power iteration, unrolled."""
    parts = [
        A.NODES_SQL, A.ORDER_EDGES_SQL,
        "live AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY ALL)",
        "outs AS MATERIALIZED (SELECT src AS id, sum(n) AS o FROM live GROUP BY src)",
        f"tp AS MATERIALIZED ({teleport})",
        "r0 AS MATERIALIZED (SELECT t.id, t.tp, o.o, t.tp AS rank FROM tp t LEFT JOIN outs o USING (id))",
    ]
    for k in range(1, iterations + 1):
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT r.id, r.tp, r.o, 0.15 * r.tp + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE o IS NULL) * r.tp) AS rank "
            f"FROM r{k - 1} r LEFT JOIN (SELECT l.dst AS id, sum(s.rank / s.o * l.n) AS got FROM live l JOIN r{k - 1} s ON l.src = s.id GROUP BY l.dst) g USING (id))"
        )
    return "WITH " + ",\n".join(parts)


_UNIFORM = "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS tp FROM nodes"


@query(rank_sql(_UNIFORM, 20) + " SELECT id, round(rank, 7) AS rank FROM r20")
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(A.nodes(spark, sf_dir), A.edges(spark, sf_dir, with_orders=True)).select("id", F.round("rank", 7).alias("rank"))


@query(rank_sql(_UNIFORM, 20) + ", c AS (SELECT id, label, round(rank, 9) AS rank FROM r20 JOIN nodes USING (id) ORDER BY rank DESC, label, id LIMIT 10) SELECT id, label, round(rank, 7) AS rank FROM c")
def graph_central_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.central_nodes(A.nodes(spark, sf_dir), A.edges(spark, sf_dir, with_orders=True), 10).select("id", "label", F.round("rank", 7).alias("rank"))


@query(rank_sql("SELECT id, CASE WHEN id IN ('customer-1', 'customer-2') THEN 0.5 ELSE 0.0 END::DOUBLE AS tp FROM nodes", 10) + " SELECT 'q' AS query_id, id, round(rank, 7) AS rank FROM r10 WHERE rank > 0")
def graph_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("q", "customer-1"), ("q", "customer-2"), ("q", "missing")], "query_id string, id string")
    ranks = G.personalized_pagerank(A.nodes(spark, sf_dir), A.edges(spark, sf_dir, with_orders=True), seeds, iterations=10)
    return ranks.where("rank > 0").select("query_id", "id", F.round("rank", 7).alias("rank"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions: keys up to a third of all are in one, the rest in the other, some in both with other values."""
    n = A.nodes(spark, sf_dir).where("kind = 'customer'").withColumn("key", F.regexp_extract("id", "[0-9]+", 0).cast("long"))
    ours = n.where("key % 3 <> 0").drop("key")
    theirs = n.where("key % 2 = 0").withColumn("confidence", ((F.col("key") * 53 + 7) % 101).cast("int")).drop("key")
    return ours, theirs


def _merge_sql(pick: str) -> str:
    return f"""WITH {A.NODES_SQL}, n AS (SELECT *, regexp_extract(id, '[0-9]+')::BIGINT AS k FROM nodes WHERE kind = 'customer'),
o AS (SELECT kind || ':' || lower(label) AS identity, * FROM n WHERE k % 3 <> 0),
t AS (SELECT kind || ':' || lower(label) AS identity, * REPLACE (((k * 53 + 7) % 101)::INTEGER AS confidence) FROM n WHERE k % 2 = 0)
SELECT coalesce(o.identity, t.identity) AS identity, coalesce(o.label, t.label) AS label,
 CASE WHEN o.identity IS NULL OR (t.identity IS NOT NULL AND {pick}) THEN t.confidence ELSE o.confidence END AS confidence,
 (o.identity IS NOT NULL AND t.identity IS NOT NULL AND (o.confidence <> t.confidence OR o.date IS DISTINCT FROM t.date)) AS conflict, o.identity IS NULL AS added
FROM o FULL OUTER JOIN t ON o.identity = t.identity"""


def _merge(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    return G.merge_nodes(*_sides(spark, sf_dir), strategy).select("identity", "label", "confidence", "conflict", "added")


@query(_merge_sql("false"))
def graph_merge_ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, "ours")


@query(_merge_sql("true"))
def graph_merge_theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, "theirs")


@query(_merge_sql("t.confidence > o.confidence"))
def graph_merge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, "higher_confidence")


@query(
    f"WITH {A.NODES_SQL}, {A.EDGES_SQL}, m AS (SELECT id, kind || ':' || lower(label) AS identity, coalesce(TRY_CAST(regexp_extract(id, '^customer-([0-9]+)$', 1) AS BIGINT), 1) AS k FROM nodes) "
    "SELECT DISTINCT a.identity AS src, b.identity AS dst, e.kind FROM edges e JOIN m a ON e.src = a.id JOIN m b ON e.dst = b.id WHERE a.k % 3 <> 0 OR (a.k % 2 = 0 AND e.kind = 'depends_on')"
)
def graph_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions: one without every third customer, the other with the even customers, and of its edges the dependencies alone."""
    nodes, edges = A.nodes(spark, sf_dir), A.edges(spark, sf_dir)
    key = F.coalesce(F.regexp_extract("id", "^customer-([0-9]+)$", 1).try_cast("long"), F.lit(1))
    theirs = nodes.where((key % 2 == 0) | (F.col("kind") == "nation"))
    return G.merge_edges([(nodes.where(key % 3 != 0), edges), (theirs, edges.where("kind = 'depends_on'"))])


@query("WITH RECURSIVE v AS (SELECT n_nationkey::BIGINT AS version_id, CASE WHEN n_nationkey >= 3 THEN n_nationkey - 3 END::BIGINT AS parent FROM nation), l AS (SELECT version_id, parent, 0 AS depth FROM v WHERE version_id = 24 UNION ALL SELECT v.version_id, v.parent, depth + 1 FROM l JOIN v ON v.version_id = l.parent) SELECT version_id, depth FROM l")
def graph_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    versions = nation.select(F.col("n_nationkey").cast("long").alias("version_id"), F.when(F.col("n_nationkey") >= 3, F.col("n_nationkey") - 3).cast("long").alias("parent"))
    return G.version_log(versions, 24)


@query(f"WITH {A.NODES_SQL}, {A.EDGES_SQL} SELECT (SELECT count(*) FROM nodes)::BIGINT AS n_nodes, (SELECT count(*) FROM edges)::BIGINT AS n_edges, (SELECT count(DISTINCT kind) FROM edges)::BIGINT AS n_edge_kinds")
def graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nodes(spark, sf_dir).agg(F.count("*").alias("n_nodes"))
    return n.crossJoin(A.edges(spark, sf_dir).agg(F.count("*").alias("n_edges"), F.countDistinct("kind").alias("n_edge_kinds")))


@query(f"WITH {A.NODES_SQL}, {A.EDGES_SQL} SELECT 'N' || chr(9) || id || chr(9) || kind || chr(9) || confidence || chr(9) || coalesce(date, '') || chr(9) || provenance || chr(9) || label AS value FROM nodes UNION ALL SELECT 'E' || chr(9) || src || chr(9) || dst || chr(9) || kind FROM edges")
def graph_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.sources.files import graph_lines

    return graph_lines(A.nodes(spark, sf_dir), A.edges(spark, sf_dir))


@query(f"WITH {A.NODES_SQL}, {A.EDGES_SQL} SELECT 'digraph knowledge {{' AS value UNION ALL SELECT '}}' UNION ALL SELECT '  \"' || id || '\" [label=\"' || label || '\"];' FROM nodes UNION ALL SELECT '  \"' || src || '\" -> \"' || dst || '\" [label=\"' || kind || '\"];' FROM edges")
def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.sources.files import dot_lines

    return dot_lines(A.nodes(spark, sf_dir), A.edges(spark, sf_dir))


_JSON = """replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"""
_JSON_TEXT = f"""coalesce('"' || {_JSON} || '"', 'null')"""


@query(f"""WITH {A.NODES_SQL} SELECT '{{{{"id":' || {_JSON_TEXT.format(c='id')} || ',"kind":' || {_JSON_TEXT.format(c='kind')} || ',"label":' || {_JSON_TEXT.format(c='label')} || ',"confidence":' || coalesce(confidence::VARCHAR, 'null') || ',"date":' || {_JSON_TEXT.format(c='date')} || '}}}}' AS value FROM nodes
UNION ALL SELECT '{{{{"event_id":' || coalesce(event_id::VARCHAR, 'null') || ',"of":{{{{"type":' || {_JSON_TEXT.format(c='event_type')} || ',"value":' || coalesce(CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END, 'null') || '}}}},"props":[' || {_JSON_TEXT.format(c='props')} || ']}}}}' FROM events""".replace("{{", "{").replace("}}", "}"))
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes and all events as JSON lines, the events with an object and a list inside."""
    from lorespark.sources.files import json_lines as lines

    events = table(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("type"), "value").alias("of"), F.array("props").alias("props"))
    return lines(A.nodes(spark, sf_dir).select("id", "kind", "label", "confidence", "date")).unionByName(lines(events))
