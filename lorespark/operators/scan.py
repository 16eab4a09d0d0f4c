"""Exact vector search of many queries at once: blocks of vectors against blocks of queries, one matrix product for each pair of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.session import cut

BLOCK_BYTES = 1 << 20  # of a block's doubles
DIGITS = 9


def blocks(vectors: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """ids, width, matrix: the vectors (id, embedding) of each task as blocks of unit vectors of one width, in the order of their ids.

    Null vectors and vectors with a null or non-finite component are left out; an empty or
    zero vector stays as zeros. A block holds ``block_bytes`` at most, or one vector.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    sound = vectors.where("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    sound = sound.select("id", F.col("embedding").cast("array<double>").alias("embedding")).sortWithinPartitions("id")
    schema = f"ids array<{id_type}>, width int, matrix binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}

        def block(width: int) -> pa.RecordBatch:
            parts = held.pop(width)
            ids = pa.concat_arrays([p[0] for p in parts])
            of = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([of, pa.array([width], pa.int32()), pa.array([np.concatenate([p[1] for p in parts]).tobytes()], pa.binary())], ["ids", "width", "matrix"])

        for batch in batches:
            ids, lists = batch.column("id"), batch.column("embedding")
            widths = np.diff(lists.offsets.to_numpy())
            for width in np.unique(widths).tolist():
                of = np.flatnonzero(widths == width)
                values = lists.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), width)
                norms = np.sqrt((values * values).sum(axis=1, keepdims=True))
                values = np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)
                most = max(1, block_bytes // (8 * max(width, 1)))
                done = 0
                while done < len(of):
                    room = most - sum(len(p[0]) for p in held.get(width, ()))
                    part = slice(done, done + room)
                    held.setdefault(width, []).append((ids.take(pa.array(of[part])), values[part]))
                    done += room
                    if sum(len(p[0]) for p in held[width]) >= most:
                        yield block(width)
        for width in list(held):
            yield block(width)

    return sound.mapInArrow(pack, schema)


def compare(vectors: DataFrame, queries: DataFrame, k: int | None = None, threshold: float | None = None, apart: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, id, sim: cosines of queries (query_id, embedding) and vectors (id, embedding), where they reach ``threshold``.

    With ``k``, of each pair of blocks only a query's best k (equal cosines, to nine digits: the
    first ids), so that each query's best k of all are among the rows. ``apart`` leaves out
    what has the query's own id. Vectors of different width have the cosine 0.

    The blocks make a grid: each block of vectors lies in one cell, each block of queries goes
    to every cell. A task holds one pair of blocks at a time, whatever the number of either.
    """
    cells = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type, query_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    of_rows = cut(blocks(vectors, block_bytes)).withColumn("cell", F.pmod(F.xxhash64(F.element_at("ids", 1), "width"), F.lit(cells)).cast("int"))
    asked = cut(blocks(queries.select(F.col("query_id").alias("id"), "embedding"), block_bytes)).select(F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("matrix").alias("q_matrix"))
    pairs = of_rows.join(asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))), "cell").drop("cell")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {name: batch.column(name)[r] for name in batch.schema.names}
                ids, q_ids = one["ids"].values, one["q_ids"].values
                width, q_width = one["width"].as_py(), one["q_width"].as_py()
                if width == q_width and width > 0:
                    left = np.frombuffer(one["q_matrix"].as_buffer(), np.float64).reshape(len(q_ids), width)
                    sims = left @ np.frombuffer(one["matrix"].as_buffer(), np.float64).reshape(len(ids), width).T
                else:
                    sims = np.zeros((len(q_ids), len(ids)))
                yield from found(ids, q_ids, sims)

    def found(ids: pa.Array, q_ids: pa.Array, sims: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = np.ones(sims.shape, bool) if threshold is None else sims >= threshold
        if apart:
            keep &= q_ids.to_numpy(zero_copy_only=False)[:, None] != ids.to_numpy(zero_copy_only=False)[None, :]
        for q in range(len(q_ids)):
            at = np.flatnonzero(keep[q])
            if k is not None and len(at) > k:
                own = np.round(sims[q, at], DIGITS)
                least = np.partition(own, len(at) - k)[len(at) - k]
                best = np.flatnonzero(own >= least)
                at = at[best[np.argsort(-own[best], kind="stable")[:k]]]  # ids are in order within a block
            if len(at):
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(np.full(len(at), q))), ids.take(pa.array(at)), pa.array(sims[q, at])], ["query_id", "id", "sim"])

    return pairs.mapInArrow(multiply, f"query_id {query_type}, id {id_type}, sim double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, apart: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, id, sim (nine digits), rank: each query's ``k`` nearest of all vectors, exactly; of equal cosines the smaller id is first.

    Each task cuts a query's rows to k before they are shuffled by query.
    """
    rows = compare(vectors, queries, k=k, apart=apart, block_bytes=block_bytes).withColumn("sim", F.round("sim", DIGITS))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)
