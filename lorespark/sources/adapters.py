"""The model's tables (documents, nodes, edges, ...) derived from the star-schema Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.session import table


def _nodes_of(df: DataFrame, kind: str, key: str, label: str) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{kind}-"), F.col(key).cast("string")).alias("id"),
        F.lit(kind).alias("kind"),
        F.col(label).alias("label"),
        ((F.col(key) * 37 + 11) % 101).cast("int").alias("confidence"),
        (F.col("date") if "date" in df.columns else F.lit(None).cast("string")).alias("date"),
        F.lit(kind).alias("provenance"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, label, confidence (0 to 100), date (text, customers only), provenance."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("date"))
    customer = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = _nodes_of(table(spark, sf_dir, "region"), "region", "r_regionkey", "r_name")
    out = out.unionByName(_nodes_of(table(spark, sf_dir, "nation"), "nation", "n_nationkey", "n_name"))
    out = out.unionByName(_nodes_of(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "s_name"))
    out = out.unionByName(_nodes_of(table(spark, sf_dir, "part"), "part", "p_partkey", "p_name"))
    return out.unionByName(_nodes_of(customer, "customer", "c_custkey", "c_name"))


def _edges_of(df: DataFrame, src: str, src_key: str, dst: str, dst_key: str, kind: str) -> DataFrame:
    return df.select(F.concat(F.lit(f"{src}-"), F.col(src_key).cast("string")).alias("src"), F.concat(F.lit(f"{dst}-"), F.col(dst_key).cast("string")).alias("dst"), F.lit(kind).alias("kind"))


def edges(spark: SparkSession, sf_dir: str, with_orders: bool = False) -> DataFrame:
    """src, dst, kind. With ``with_orders`` also customer-to-part edges, from all orders."""
    lines = table(spark, sf_dir, "lineitem")
    out = _edges_of(table(spark, sf_dir, "nation"), "nation", "n_nationkey", "region", "n_regionkey", "depends_on")
    out = out.unionByName(_edges_of(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "depends_on"))
    out = out.unionByName(_edges_of(table(spark, sf_dir, "customer"), "customer", "c_custkey", "nation", "c_nationkey", "depends_on"))
    out = out.unionByName(_edges_of(lines.select("l_suppkey", "l_partkey").distinct(), "supplier", "l_suppkey", "part", "l_partkey", "implements"))
    if with_orders:
        bought = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
        out = out.unionByName(_edges_of(bought, "customer", "o_custkey", "part", "l_partkey", "references"))
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc_id, doc_type, title, author, body, metadata, confidence."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        "doc_id",
        F.col("source").alias("doc_type"),
        F.substring(F.substring_index("text", "\n", 1), 1, 40).alias("title"),
        F.lit(None).cast("string").alias("author"),
        F.col("text").alias("body"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"),
        F.coalesce(F.col("quality") * 100, F.lit(50)).cast("int").alias("confidence"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, runtime, latency_ms, tokens, from the event table."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("runtime"),
        F.round(F.col("value") * 100).cast("long").alias("latency_ms"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("tokens"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, role, body: conversations as session records."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", F.col("text").alias("body"))


def _node_sql(kind: str, key: str, label: str, source: str, date: str = "NULL::VARCHAR") -> str:
    return f"SELECT '{kind}-' || {key} AS id, '{kind}' AS kind, {label} AS label, (({key} * 37 + 11) % 101)::INTEGER AS confidence, {date} AS date, '{kind}' AS provenance FROM {source}"


NODES_SQL = "nodes AS (" + " UNION ALL ".join([
    _node_sql("region", "r_regionkey", "r_name", "region"),
    _node_sql("nation", "n_nationkey", "n_name", "nation"),
    _node_sql("supplier", "s_suppkey", "s_name", "supplier"),
    _node_sql("part", "p_partkey", "p_name", "part"),
    _node_sql("customer", "c_custkey", "c_name", "customer LEFT JOIN (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders GROUP BY 1) ON c_custkey = o_custkey", "first"),
]) + ")"

EDGES_SQL = """edges AS (
SELECT 'nation-' || n_nationkey AS src, 'region-' || n_regionkey AS dst, 'depends_on' AS kind FROM nation
UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'depends_on' FROM supplier
UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, 'depends_on' FROM customer
UNION ALL SELECT 'supplier-' || a, 'part-' || b, 'implements' FROM (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem))"""

ORDER_EDGES_SQL = EDGES_SQL[:-1] + """
UNION ALL SELECT 'customer-' || a, 'part-' || b, 'references' FROM (SELECT DISTINCT o_custkey AS a, l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey))"""

DOCUMENTS_SQL = """docs AS (
SELECT 'doc-' || d.doc_id AS id, d.doc_id, source AS doc_type, lang, left(split_part(text, chr(10), 1), 40) AS title, text AS body, coalesce(quality * 100, 50)::INTEGER AS confidence
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""

TELEMETRY_SQL = """telemetry AS (
SELECT event_id AS seq, event_type AS runtime, round(value * 100)::BIGINT AS latency_ms, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS tokens FROM events)"""
