"""Spark helpers of this subpackage, beside the shared ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.session import cut, small_batches, table

__all__ = ["cut", "held_out", "plain", "small_batches", "table", "texts", "unused"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many more marks as it takes to differ from all of the table's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def plain(df: DataFrame, *keep: str) -> DataFrame:
    """The table with plain names (c0_, c1_, ...) for all columns but ``keep``: Spark reads a dot or a backtick in a name as more than a name."""
    return df.toDF(*[c if c in keep else f"c{k}_" for k, c in enumerate(df.columns)])


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id (as long) and the text, under fixed names: other columns can't clash."""
    return small_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
