"""Event-time jobs: sessions of users, joins of two streams within an interval, and late rows that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.streaming.jobs import append


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, first, until, n, total of each user's sessions, once the watermark has passed their end.

    A session ends when no event has come for ``gap``. Its counts are merged within a
    partition before and after the shuffle, so an active user is a short state row for
    each open session. Rows without a time or user are in no session.
    """
    timed = events.where("ts is not null and user_id is not null").withWatermark("ts", late)
    made = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select("user_id", F.col("w.start").alias("first"), F.col("w.end").alias("until"), "n", "total")


def within(causes: DataFrame, effects: DataFrame, seconds: int, late: str = "1 hour", how: str = "inner") -> DataFrame:
    """Each effect (user_id, effect_id, effect_ts) with each cause (user_id, cause_id, cause_ts) of its user that came at most ``seconds`` before it.

    Both may be streams. The watermarks and the interval let Spark drop what no later row can
    meet. The key is the user and a bucket of time: a cause goes to its own bucket and the
    next, an effect to its own, so that one user's rows are parted by time, and a pair meets once.
    With ``how`` "leftOuter" an effect without a cause comes too, once none can come any more.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c) / seconds)
    left = effects.select("user_id", "effect_id", "effect_ts").withWatermark("effect_ts", late).withColumn("bucket", bucket(F.col("effect_ts")))
    right = causes.select(F.col("user_id").alias("c_user"), "cause_id", "cause_ts").withWatermark("cause_ts", late)
    right = right.withColumn("c_bucket", F.explode(F.array(bucket(F.col("cause_ts")), bucket(F.col("cause_ts")) + 1)))
    near = F.expr(f"cause_ts <= effect_ts and cause_ts >= effect_ts - interval {seconds} seconds")
    met = left.join(right, (F.col("user_id") == F.col("c_user")) & (F.col("bucket") == F.col("c_bucket")) & near, how)
    return met.select("user_id", "effect_id", "effect_ts", "cause_id", "cause_ts")


def judge_lateness(batch: DataFrame, n: int, folder: str, late_ms: int) -> None:
    """Appends batch ``n`` to the log of ``folder`` with ``late``: whether a row's ts is more than ``late_ms`` before the latest of earlier batches.

    No row is dropped. The mark is one number, kept by batch, and read of the batch before
    alone: a batch that is written again gets the same verdicts. Rows without a time are not late.
    """
    spark = batch.sparkSession
    schema = "mark long"
    mark = spark.read.schema(schema).parquet(f"{folder}/marks/{n - 1}").first()["mark"] if n else None
    at = F.unix_millis("ts")
    late = F.lit(False) if mark is None else F.coalesce(at < mark - late_ms, F.lit(False))
    append(batch.withColumn("late", late), n, f"{folder}/log")
    latest = batch.agg(F.greatest(F.max(at), F.lit(mark).cast("long")).alias("mark"))
    latest.write.mode("overwrite").parquet(f"{folder}/marks/{n}")


def with_lateness(events: DataFrame, folder: str, late_ms: int) -> DataFrame:
    """Every row that the stream has now, with ``late``; called again with the same folder it goes on (see judge_lateness)."""
    job = events.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    job.foreachBatch(lambda df, n: judge_lateness(df, n, folder, late_ms)).start().awaitTermination()
    return events.sparkSession.read.parquet(f"{folder}/log")
