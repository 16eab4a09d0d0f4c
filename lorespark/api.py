"""One method for each command: a workspace of documents, a graph and records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import corpus as C
from lorespark.operators import graph as G
from lorespark.operators import orchestrate as O
from lorespark.operators import retrieval as R
from lorespark.plans.graph_query import GraphQuery
from lorespark.session import cut
from lorespark.sources import adapters as A


@dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    documents: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    telemetry: DataFrame | None = None
    embed: Callable[[DataFrame], DataFrame] = R.embed  # of (id, text): id, embedding; R.embedder makes one of a function
    changes: DataFrame | None = None  # after ``index``: the nodes with what became of them

    @staticmethod
    def of_tables(spark: SparkSession, sf_dir: str) -> Workspace:
        return Workspace(spark, A.documents(spark, sf_dir), A.nodes(spark, sf_dir), A.edges(spark, sf_dir), None, A.telemetry(spark, sf_dir))

    def plan(self, intents: DataFrame) -> DataFrame:
        """Steps of each intent (intent_id, intent)."""
        return O.plan_steps(intents)

    def search(self, queries: DataFrame, limit: int = 10, query_vectors: DataFrame | None = None, synonyms: int = 0, feedback: int = 0, diversity: float | None = None) -> DataFrame:
        """Hybrid search; with synonyms (at most so many terms), feedback documents, or a trade-off for diversity."""
        if synonyms:
            queries = R.expand_queries(queries, R.synonym_terms(queries, R.synonym_table(self.spark), synonyms))
        if feedback:
            hits = R.feedback_by_text(self.documents, queries, feedback)
            queries = R.expand_queries(queries, R.expansion_terms(self.documents, hits, queries, 5))
        pool = limit if diversity is None else 4 * limit
        if self.vectors is not None and query_vectors is None:
            query_vectors = self.embed(queries.select(F.col("query_id").alias("id"), F.col("question").alias("text"))).withColumnRenamed("id", "query_id")
        found = R.search(self.documents, queries, pool, self.nodes, self.edges, self.vectors, query_vectors)
        return found if diversity is None else R.mmr(found, diversity, limit)

    def evaluate(self, queries: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
        """Metrics of the search's titles against relevant items (query_id, item)."""
        runs = self.search(queries, k).select("query_id", "rank", F.col("title").alias("item"))
        return R.ranking_metrics(runs, relevant, k)

    def find(self, query: GraphQuery) -> DataFrame:
        return query.run(self.nodes, self.edges)

    def index(self, size: int = 800, overlap: int = 80) -> Workspace:
        """Indexes the documents: their passages, with vectors, replace those that the store has of them, and what they name goes into the graph.

        Nodes are known by their labels: a known one is reinforced, never doubled; edges
        that the graph has between two names are not drawn again. ``changes`` and
        ``report`` tell what was added.
        """
        texts = self.documents.where("doc_type <> 'chunk'")
        chunks = cut(C.passages(texts, size, overlap))
        vectors = self.embed(chunks.select("id", F.col("body").alias("text")))
        if self.vectors is not None:
            stale = self.documents.where("doc_type = 'chunk'").join(chunks.select(F.col("metadata")["source"].alias("s")).distinct(), F.col("metadata")["source"] == F.col("s"), "left_semi").select("id")
            vectors = self.vectors.select("id", "embedding").join(stale, "id", "left_anti").join(chunks.select("id"), "id", "left_anti").unionByName(vectors)
        mentions = cut(C.entity_mentions(texts))
        changes = cut(G.reinforce(self.nodes, C.extracted_nodes(mentions)))
        names = changes.groupBy(F.lower("label").alias("name")).agg(F.min("id").alias("id"))
        at = lambda df, c: df.join(names.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(c)), c)
        label = changes.select("id", F.lower("label").alias("label"))
        known = self.edges.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        drawn = at(at(C.extracted_edges(mentions, known), "src"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind")
        return replace(self, documents=C.replace_passages(self.documents, chunks), nodes=changes.drop("change"), edges=self.edges.unionByName(drawn), vectors=vectors, changes=changes)

    def report(self, before: Workspace) -> DataFrame:
        """One row: how many nodes and edges indexing added, and how many nodes it reinforced."""
        counts = self.changes.agg(F.count_if(F.col("change") == "added").alias("nodes_added"), F.count_if(F.col("change") == "reinforced").alias("nodes_reinforced"))
        return counts.crossJoin(self.edges.agg(F.count("*").alias("now"))).crossJoin(before.edges.agg(F.count("*").alias("then"))).select("nodes_added", "nodes_reinforced", (F.col("now") - F.col("then")).alias("edges_added"))

    def central(self, n: int = 3) -> DataFrame:
        return G.central_nodes(self.nodes, self.edges, n)

    def collect_garbage(self, now: str | None = None, min_confidence: int = 0, size: int | None = None) -> Workspace:
        """Summaries first, then removals, then nodes that no edge names."""
        docs = self.documents if size is None else C.consolidate(self.documents, size).drop("due")
        docs = docs.join(C.garbage(docs, now, min_confidence), "id", "left_anti")
        return replace(self, documents=docs, nodes=self.nodes.join(G.orphans(self.nodes, self.edges).select("id"), "id", "left_anti"))

    def verify(self) -> DataFrame:
        return C.run_checks(self.documents)

    def status(self) -> DataFrame:
        return O.telemetry_by_runtime(self.telemetry)
