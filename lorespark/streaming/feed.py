"""The change feed of the graph: versioned changes in an append table, read as a stream, and documents that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.streaming import jobs as S

FEED = "what string, change string, node string, kind string, label string, confidence int, version long"
_STATE = ("kind", "label", "confidence")


def _change(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("updated").alias("change")


def node_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of the nodes (id, kind, label, confidence) between two versions; unchanged ones give no row."""
    state = lambda df, name: df.select("id", F.struct(*_STATE).alias(name))
    both = state(before, "old").join(state(after, "new"), "id", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    shown = [F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in _STATE]
    return both.select(F.lit("node").alias("what"), _change(F.col("old"), F.col("new")), F.col("id").alias("node"), *shown)


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) added or removed between two versions, one row for each end; a repeated edge is one.

    Both versions are grouped at once: a group keeps two marks, where a join would sort all edges of either version.
    """
    ends, keys = F.explode(F.array("src", "dst")).alias("node"), ["src", "dst", "kind"]
    marked = lambda df, old: df.select(*keys, F.lit(old).alias("old"))
    both = marked(before, True).unionByName(marked(after, False)).groupBy(*keys).agg(F.bool_or("old").alias("was"), F.bool_and("old").alias("gone")).where("was = gone")
    change = F.when(F.col("gone"), "removed").otherwise("added").alias("change")
    return both.select(F.lit("edge").alias("what"), change, ends, "kind", F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("confidence")).distinct()


def publish(changes: DataFrame, folder: str, version: int) -> None:
    """Appends a version of changes. Publishing a version again replaces it, so a repeated attempt counts once."""
    rows = changes.select("what", "change", "node", *_STATE).withColumn("version", F.lit(version).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(folder)


def follow(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """The feed as a stream."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", max_files).parquet(folder)


def touched(batch: DataFrame) -> DataFrame:
    """Of a batch of the feed one row a node: the latest version that named it or an edge of it, and the state that its own last change left.

    It has the same columns as what it is made of, so that batches can be taken together again.
    """
    own = F.when(F.col("what") == "node", F.col("version"))
    last = F.max_by(F.struct("change", *_STATE, "since"), "since").alias("s")
    held = batch.withColumn("since", F.col("since") if "since" in batch.columns else own)
    return held.groupBy("node").agg(last, F.max("version").alias("version")).select("node", "s.*", "version")


def reindexed(changes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id, node, title, confidence and version of the document of every node that is there, after all ``changes`` (as ``touched`` gives them).

    A node keeps the document that ``known`` (id, node) has of it; else its id is made of the node's, so
    that the same changes, in any number of batches and however often, give the same documents.
    """
    now = touched(changes.withColumn("what", F.lit("node"))).where("change <> 'removed'")
    made = F.concat(F.lit("node:"), "node")
    if known is None:
        named = now.withColumn("id", made)
    else:
        named = now.join(known.groupBy("node").agg(F.min("id").alias("id")), "node", "left").withColumn("id", F.coalesce("id", made))
    return named.select("id", "node", F.col("label").alias("title"), "confidence", "version")


def follow_to(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Drains the feed: each batch leaves one row for each node that it touches, under its own number, and a replayed batch leaves the same."""
    return reindexed(S.drain(stream, lambda df, n, out: S.append(touched(df), n, out)), known)
