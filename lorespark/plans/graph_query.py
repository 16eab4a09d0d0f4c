"""Declarative graph queries: a description that becomes one lazy DataFrame plan.

There is no query string and no parser: a query is a value, its filter a Column
function, and Catalyst does the analysis and optimisation.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNOWN_EDGES = ("depends_on", "implements", "references", "created_by", "related_to")
MATCH = ("label", "kind", "confidence", "date", "provenance")


def edge_kind(written: str) -> str:
    """The edge kind that a spelling such as DependsOn or depends-on means; else the lower-cased word."""
    squashed = re.sub(r"[^0-9a-z]", "", written.lower())
    return next((k for k in KNOWN_EDGES if k.replace("_", "") == squashed), written.lower())


@dataclass(frozen=True)
class GraphQuery:
    """Selects nodes by kind and text, and their outgoing neighbours by kind and edge.

    ``where`` gets the confidence column; ``before`` and ``after`` are strict text
    comparisons that leave undated nodes out. ``limit`` holds for each section.
    """

    kind: str | None = None
    text: str | None = None
    related: str | None = None  # kind of the neighbours, "*" for any; None: no neighbours
    via: str | None = None
    where: Callable[[Column], Column] | None = None
    before: str | None = None
    after: str | None = None
    ascending: bool = False
    limit: int | None = None

    def _bounds(self, df: DataFrame) -> DataFrame:
        if self.where is not None:
            df = df.where(self.where(F.col("confidence")))
        if self.before is not None:
            df = df.where(F.col("date") < self.before)
        if self.after is not None:
            df = df.where(F.col("date") > self.after)
        return df

    def primary(self, nodes: DataFrame) -> DataFrame:
        df = nodes
        if self.kind not in (None, "*"):
            df = df.where(F.lower("kind") == self.kind.lower())
        if self.text:
            df = df.where(F.contains(F.lower("label"), F.lit(self.text.lower())))
        return self._bounds(df)

    def neighbours(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Distinct targets of the primary nodes' edges; a self-loop leads nowhere."""
        if self.via is not None:
            edges = edges.where(F.col("kind") == edge_kind(self.via))
        reached = edges.where("src <> dst").join(self.primary(nodes).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        targets = nodes if self.related == "*" else nodes.where(F.lower("kind") == self.related.lower())
        return self._bounds(targets).join(reached, "id", "left_semi")

    def _first(self, df: DataFrame, sort: bool) -> DataFrame:
        """The first rows, where there is a limit; else all, in order only if that is asked for: a union of sections keeps none."""
        first = F.asc("confidence") if self.ascending else F.desc("confidence")
        if self.limit is not None:
            return df.orderBy(first, "label", "id").limit(self.limit)
        return df.orderBy(first, "label", "id") if sort else df

    def run(self, nodes: DataFrame, edges: DataFrame | None = None, sort: bool = True) -> DataFrame:
        """section ("primary" or "related"), id, label, kind, confidence, date, provenance; in order, if there is one section."""
        shape = lambda df, section: self._first(df, sort and self.related is None).select(F.lit(section).alias("section"), "id", *MATCH)
        out = shape(self.primary(nodes), "primary")
        if self.related is not None:
            out = out.union(shape(self.neighbours(nodes, edges), "related"))
        return out

    def edges_among(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """The edges between any two nodes of the result."""
        ids = self.run(nodes, edges, sort=False).select("id").distinct()
        return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")


def top(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, numbered."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
