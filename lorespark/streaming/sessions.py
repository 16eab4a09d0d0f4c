"""Session records as a stream: executions and reflections become documents that are numbered on over batches and restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.orchestrate import numbered
from lorespark.streaming.jobs import append

SNAPSHOT = 16  # every 16th batch writes every session's last number, the others those of their own sessions
DOCUMENT = "session string, at long, doc_type string, title string, body string, confidence int, metadata map<string,string>"
NUMBERS = "session string, seq long"


def _texts(**named: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named.items()]


def _metadata(*names: str) -> Column:
    """The named columns that are not null, as text."""
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for n in names])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def executions(runs: DataFrame) -> DataFrame:
    """Documents of runs (session, at, task, capability, runtime, output, verified, agent): confidence 100 if verified, else 0."""
    named = runs.select(*_texts(session="session", capability="capability", runtime="runtime", body="output"), F.col("at").cast("long").alias("at"), "task", F.coalesce("verified", F.lit(False)).alias("verified"), "agent")
    return named.select(
        "session", "at", F.lit("execution").alias("doc_type"), F.concat("capability", F.lit(" on "), "runtime").alias("title"), "body",
        F.when(F.col("verified"), 100).otherwise(0).alias("confidence"), _metadata("session", "task", "capability", "runtime", "verified", "agent").alias("metadata"),
    )


def reflections(notes: DataFrame) -> DataFrame:
    """Documents of reflections (session, at, task, hint, score): the score is the confidence."""
    named = notes.select(*_texts(session="session", body="hint"), F.col("at").cast("long").alias("at"), "task", F.coalesce("score", F.lit(0)).cast("int").alias("confidence"))
    title = F.concat(F.lit("reflection for "), F.coalesce(F.col("task").cast("string"), F.lit("")))
    return named.select("session", "at", F.lit("reflection").alias("doc_type"), title.alias("title"), "body", "confidence", _metadata("session", "task").alias("metadata"))


def _last_numbers(batch: DataFrame, n: int, numbers: str, known: DataFrame | None) -> DataFrame:
    """session, seq before batch ``n``: from the batches since the last that wrote all sessions, before the first from ``known``."""
    spark = batch.sparkSession
    if n == 0:
        held = spark.createDataFrame([], NUMBERS) if known is None else known.selectExpr("coalesce(cast(session as string), '') as session", "cast(seq as long) as seq")
    else:
        held = spark.read.schema(NUMBERS).parquet(*[f"{numbers}/{k}" for k in range((n - 1) // SNAPSHOT * SNAPSHOT, n)])
    return held.groupBy("session").agg(F.max("seq").alias("seq"))


def record_batch(batch: DataFrame, n: int, folder: str, known: DataFrame | None = None) -> None:
    """Writes batch ``n`` of documents behind what the log in ``folder`` has, with their numbers.

    A session's records of a batch are numbered in the order of (at, doc_type, title, body),
    by ranges, so that one session may have most of a batch. What is read is of the batches
    before ``n`` alone, so a batch that is written again gets the same numbers and takes
    its own place: no number is used twice and none is passed over.
    """
    log, numbers = f"{folder}/log", f"{folder}/numbers"
    last = _last_numbers(batch, n, numbers, known)
    order = F.struct(F.col("at"), F.col("doc_type"), F.col("title"), F.col("body"))
    placed = numbered(batch.withColumn("_order", order), "session", "_order").drop("_order")
    made = placed.join(last.withColumnRenamed("seq", "_last"), "session", "left").withColumn("seq", F.coalesce("_last", F.lit(0)) + F.col("n") + 1)
    made = made.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("seq"), F.col("seq").cast("string"))))
    append(made.select(F.concat_ws("-", "session", "seq").alias("id"), "session", "seq", "doc_type", "title", "body", "confidence", "metadata"), n, log)
    written = batch.sparkSession.read.schema(NUMBERS).parquet(f"{log}/batch={n}") if made.limit(1).count() else last.where("false")
    now = written.select("session", "seq")
    if n % SNAPSHOT == 0:
        now = now.unionByName(last)
    now.groupBy("session").agg(F.max("seq").alias("seq")).write.mode("overwrite").parquet(f"{numbers}/{n}")


def record(stream: DataFrame, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Takes what a stream of documents (see executions, reflections) has now into the log of ``folder``, and returns the log.

    Called again with the same folder it goes on where it ended, or was ended: the stream's
    progress, the log and the last numbers lie there together. ``known`` (session, seq)
    holds the numbers that a store has given before; it is read for the first batch.
    A null session is the session "". Records of one session in different batches are
    numbered in the order of the batches.
    """
    job = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    job.foreachBatch(lambda df, n: record_batch(df, n, folder, known)).start().awaitTermination()
    columns = DOCUMENT.replace("at long", "id string, seq long") + ", batch int"
    return stream.sparkSession.read.schema(columns).parquet(f"{folder}/log")


def history(log: DataFrame, session: str, doc_type: str = "execution") -> DataFrame:
    """A session's own records of one type, by number."""
    return log.where((F.col("session") == session) & (F.col("doc_type") == doc_type)).orderBy("seq")
