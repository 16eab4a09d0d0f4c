"""Structured Streaming jobs: running telemetry, re-indexing on graph changes, and the replay guard."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespark.operators.orchestrate import TASK_MOVES, telemetry_by_runtime
from lorespark.session import checkpoint_folder

NONCE_GROUPS = 1024


def read_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A Parquet folder or file as a stream, with the schema that it has now.

    The path is given as a pattern (its last letter as a set): a plain path may only be a folder.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files).parquet(f"{path[:-1]}[{path[-1]}]")


def in_batches(df: DataFrame, by: str, n: int, ends: list | None = None) -> DataFrame:
    """A table as a stream of ``n`` batches, of ranges of the column ``by`` (up to the given ``ends``, else alike in size), in its order."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/batches-{uuid.uuid4().hex}"
    ends = ends or df.approxQuantile(by, [k / n for k in range(1, n)], 0.001)  # n - 1 numbers
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        part = df if low is None else df.where(F.col(by) > low)
        (part if high is None else part.where(F.col(by) <= high)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream: DataFrame, write: Callable[[DataFrame, int, str], None], mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what its batches wrote, in the shared checkpoint folder."""
    spark = stream.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    job.foreachBatch(lambda df, n: write(df, n, f"{folder}/out")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def overwrite(df: DataFrame, n: int, out: str) -> None:
    df.write.mode("overwrite").parquet(out)


def append(df: DataFrame, n: int, out: str) -> None:
    """A repeated batch replaces its own files, so each batch counts once."""
    df.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)


def running_telemetry(telemetry: DataFrame) -> DataFrame:
    """Means and sums of each runtime over all records so far (complete mode: one row for each runtime)."""
    return telemetry_by_runtime(telemetry)


def windowed_events(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts by event type and tumbling window; what comes to a stream later than ``late`` is passed over (streaming.events keeps it)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def reindex(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graph documents of the changed nodes (node_id): one for each node, missing nodes are passed over.

    Repeated changes of a batch make one row; the document's id comes from the node, so
    a later batch writes the same document again.
    """
    ids = changes.select(F.col("node_id").alias("id")).distinct()
    found = nodes.join(ids, "id", "left_semi")
    return found.select(
        F.concat(F.lit("node:"), "id").alias("id"), F.lit("graph_node").alias("doc_type"), F.col("label").alias("title"), F.col("label").alias("body"), "confidence",
        F.create_map(F.lit("node_id"), F.col("id")).alias("metadata"),
    )


def replay_verdicts(messages: DataFrame, window_ms: int, groups: int = NONCE_GROUPS) -> DataFrame:
    """id, nonce and verdict of each message (id, nonce, ts_ms, now_ms, signed), of a batch or a stream.

    Bad signature: ``signed`` (see functions.vectors.signature_ok) is not true. Expired: now
    and the message's time differ by more than the window. Replayed: the nonce was accepted
    with a time that is no older than the window now. Else accepted. Every message gets a
    verdict, however late it comes: no watermark takes rows away before they are judged.
    State is one number for each nonce, and is dropped two windows after the nonce was
    last seen, by the clock of the stream: a backlog runs faster than its messages' clock, so
    nothing is forgotten too early. A call of Python costs far more than a message, so nonces are
    dealt by a hash to ``groups`` of them that are judged and kept together. Messages of a
    batch are taken in the order of now_ms.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = {n: (t, seen) for n, t, seen in json.loads(state.get[0])} if state.exists else {}
        made = None
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["now_ms", "id"])  # one group's messages of one batch
            nonces = [None if n != n else int(n) for n in rows["nonce"].tolist()]  # nulls have a group of their own
            verdicts = []
            for nonce, now, at, signed, seen in zip(nonces, rows["now_ms"].tolist(), rows["ts_ms"].tolist(), rows["signed"].tolist(), rows["seen_ms"].tolist(), strict=True):
                accepted = held.get(nonce, (None,))[0]
                if not signed:
                    verdicts.append("bad_signature")
                elif abs(now - at) > window_ms:
                    verdicts.append("expired")
                elif accepted is not None and now - accepted <= window_ms:
                    verdicts.append("replayed")
                else:
                    verdicts.append("accepted")
                    accepted = int(at)
                if accepted is not None:
                    held[nonce] = (accepted, max(int(seen), mark))
            made = pd.DataFrame({"id": rows["id"], "nonce": rows["nonce"], "verdict": verdicts})
        held = {n: v for n, v in held.items() if v[1] >= mark}
        if held:
            state.update((json.dumps([[n, *v] for n, v in held.items()]),))
            state.setTimeoutTimestamp(max(min(seen for _, seen in held.values()), mark) + 1)
        elif state.exists:
            state.remove()
        if made is not None:
            yield made

    seen = messages.withColumn("seen", F.current_timestamp()).withWatermark("seen", f"{2 * window_ms} milliseconds")  # no row is late by this time
    group = F.when(F.col("nonce").isNull(), -1).otherwise(F.pmod(F.xxhash64("nonce"), F.lit(groups)))
    timed = seen.withColumn("seen_ms", F.unix_millis("seen")).withColumn("group", group)
    return timed.groupBy("group").applyInPandasWithState(judge, "id long, nonce long, verdict string", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def state_changes(events: DataFrame, moves: tuple = TASK_MOVES, start: str = "created") -> DataFrame:
    """task, seq, state, attempts, rejected after each batch's events (task, seq, wanted) of a task, in their order.

    State is one short row for each task, whatever the length of its log.
    """
    legal = frozenset(moves)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, attempts, rejected = held.get if held.exists else (start, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")  # one task's events of one batch
        for wanted in rows["wanted"]:
            if (state, wanted) in legal:
                state, attempts = wanted, attempts + (wanted == "retry")
            else:
                rejected += 1
        held.update((state, attempts, rejected))
        yield pd.DataFrame({"task": [key[0]], "seq": [rows["seq"].iloc[-1]], "state": [state], "attempts": [attempts], "rejected": [rejected]})

    kept = "state string, attempts int, rejected int"
    return events.groupBy("task").applyInPandasWithState(step, f"task long, seq long, {kept}", kept, "append", GroupStateTimeout.NoTimeout)
