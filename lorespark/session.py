"""Spark helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; one of our own only where it is unset and all tasks run on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: later reads come from the checkpoint, which outlives executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame) -> DataFrame:
    """Writes a table that may be small, so that Spark knows its size and joins it as that asks for."""
    folder = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/sized-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """Lets Spark pass at most ``rows`` rows at a time to Python: its default of 10,000 long texts is much off-heap memory.

    A session's own setting is left alone if it is lower.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df
