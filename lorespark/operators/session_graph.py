"""The graph of a session: what its runs, and then its documents, name, with where each name came from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import classify_label
from lorespark.operators.corpus import entity_mentions, extracted_edges
from lorespark.session import cut

BLOCK = 4096  # turns of a session that are numbered in one window


@dataclass(frozen=True)
class SessionGraph:
    """Graphs of any number of sessions.

    nodes: session, name, label, kind, confidence, provenance, n_calls.
    edges: session, src, dst (names), kind.
    sources: session, name, call, confidence: every extraction that named a node.
    """

    nodes: DataFrame
    edges: DataFrame
    sources: DataFrame

    def report(self) -> DataFrame:
        """session, call, added, reinforced: how many nodes each extraction added, and how many it found again."""
        first = F.min("call").over(Window.partitionBy("session", "name"))
        seen = self.sources.withColumn("added", F.col("call") == first)
        return seen.groupBy("session", "call").agg(F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("reinforced"))


def runs_of(turns: DataFrame) -> DataFrame:
    """Turns (session, seq, role, body) with ``call``, their run's number, and ``last``, the session's last one.

    A user's turn opens a run; turns before the first belong to run 0. ``seq`` is unique
    in its session. Numbers are counted by blocks of turns, so one task never orders the
    whole of a long session.
    """
    block = F.floor(F.col("seq") / BLOCK)
    opens = F.coalesce(F.col("role") == "user", F.lit(False)).cast("long")
    marked = turns.select("session", "seq", "role", F.coalesce("body", F.lit("")).alias("body"), block.alias("block"), opens.alias("opens"))
    counts = marked.groupBy("session", "block").agg(F.sum("opens").alias("n"))
    earlier = Window.partitionBy("session").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("session", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("session")).alias("last"))
    inside = Window.partitionBy("session", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("n", F.sum("opens").over(inside)).join(counts, ["session", "block"])
    return numbered.withColumn("call", F.col("before") + F.col("n")).drop("block", "n", "before")


def session_graph(turns: DataFrame) -> SessionGraph:
    """One extraction for each run of a session, in order, then one for all its documents.

    Mentions are counted over a whole extraction, however many turns it has: a node's
    confidence is the highest of its extractions. Its label and its provenance,
    "run:<intent>" or "session documents", come from the first; what later ones add is
    in ``sources``. Of an ordered pair the edge that is drawn first stays. The parts of
    an extraction are joined by line ends, which part sentences too, so turns are read
    one by one and never put together in one row. Null bodies are empty.
    """
    runs = runs_of(turns)
    document = F.concat(F.coalesce("role", F.lit("")), F.lit(". "), F.col("body"))
    call = lambda number, text: F.struct(number.alias("call"), text.alias("body"))
    parts = runs.select("session", "seq", F.explode(F.array(call(F.col("call"), F.col("body")), call(F.col("last") + 1, document))).alias("part"))
    mentions = cut(entity_mentions(parts.select(F.struct("session", "part.call", "seq").alias("id"), "part.body")))
    names = mentions.select("id.session", "id.call", "id.seq", "sentence", "at", "entity", F.lower("entity").alias("name"))
    per_call = names.groupBy("session", "call", "name").agg(F.count("*").alias("n"), F.min_by("entity", F.struct("seq", "sentence", "at")).alias("label"))
    sources = per_call.withColumn("confidence", F.least(45 + (F.col("n") - 1) * 15, F.lit(100)).cast("int"))
    nodes = sources.groupBy("session", "name").agg(F.min("call").alias("call"), F.min_by("label", "call").alias("label"), F.max("confidence").alias("confidence"), F.count("*").alias("n_calls"))
    intents = runs.where("opens = 1").select("session", "call", F.concat(F.lit("run:"), "body").alias("intent"))
    ends = runs.groupBy("session").agg(F.max("last").alias("last"))
    known = nodes.join(intents, ["session", "call"], "left").join(ends, "session")
    provenance = F.when(F.col("call") > F.col("last"), F.lit("session documents")).otherwise(F.coalesce("intent", F.lit("run:")))
    nodes = known.select("session", "name", "label", classify_label(F.col("label")).alias("kind"), "confidence", provenance.alias("provenance"), "n_calls")
    return SessionGraph(nodes, extracted_edges(mentions, within="session"), sources.select("session", "name", "call", "confidence"))
