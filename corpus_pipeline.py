"""A training-corpus pipeline: each stage is one operator, over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import decontaminate, near, pack, substring, toxicity
from lorespark.llm.frames import cut, table
from lorespark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model finds toxic go.

    Null and empty texts stay, as do all rows where there are no labels of both kinds;
    very long texts are read whole; repeated rows go or stay together; a null id has no
    label but is judged. An empty table stays empty. Columns of any name are carried.
    """
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies stays, that of the least id.

    Null and empty texts are copies of each other; repeated rows leave one; of rows with
    a null id one of each text stays that no row with an id has. Very long texts are
    read whole. An empty table stays empty. Columns of any name are carried.
    """
    return near.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are taken out of the text.

    A text of which nothing is left goes; null and empty texts, and rows with a null id,
    stay as they are; repeated rows lose alike. Very long texts are read whole. An empty
    table stays empty. Columns of any name are carried.
    """
    return substring.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Each row is judged by its own text, with a null id too; null and empty texts stay;
    repeated rows go or stay together; very long texts are read whole. An empty table
    stays empty. Columns of any name are carried.
    """
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, packed into sequences.

    A null or empty text is one piece of the end id; very long texts are cut; repeated
    rows and null ids are packed as they come. An empty table gives no piece. No other
    column is read.
    """
    return pack.pack(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("decontaminate", drop_leaks),
    ("pack", pack_sequences),
]

#: SQL can express neither the fitted tags nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; between them, rows are cut off in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
