"""1. Sharding by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lorespark.llm.frames import cut, plain, small_batches

_NUMPY_LIMIT = 10**9


def _log_binomial(k: int, n: int, p: float) -> float:
    """Log of the chance of k successes in n, by its saddle point: no large logarithms are subtracted, so nothing is lost at any n."""
    if k in (0, n):
        return n * (math.log1p(-p) if k == 0 else math.log(p)) if 0 < p < 1 else 0.0

    def rest(m: int) -> float:  # log m! less its leading terms
        return math.lgamma(m + 1) - (m + 0.5) * math.log(m) + m - 0.5 * math.log(2 * math.pi) if m < 16 else (1 / 12 - (1 / 360 - 1 / 1260 / m / m) / m / m) / m

    def apart(x: float, mean: float) -> float:  # x log(x / mean) + mean - x
        d = (x - mean) / mean
        if abs(d) > 0.1:
            return x * math.log(x / mean) + mean - x
        return mean * sum((-d) ** i / (i * (i - 1)) for i in range(2, 24))

    return rest(n) - rest(k) - rest(n - k) - apart(k, n * p) - apart(n - k, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """One deviate of any size: numpy's below its limit, else by walking out from the mode."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)
    p = drawn / (good + bad)
    peak = math.exp(_log_binomial(mode, good, p) + _log_binomial(drawn - mode, bad, p) - _log_binomial(drawn, good + bad, p))
    left = rng.random() - peak
    up, down, p_up, p_down = mode, mode, peak, peak
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) / (up + 1) * (drawn - up) / (bad - drawn + up + 1)
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down / (good - down + 1) * (bad - drawn + down) / (drawn - down + 1)
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def _split(rng: np.random.Generator, capacity: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` rows, taken without replacement, each column's capacity gives."""
    total = int(capacity.sum())
    if total < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(capacity, drawn, method="marginals")
    out = np.zeros_like(capacity)
    for i, c in enumerate(capacity.tolist()):
        if not drawn:
            break
        out[i] = _hypergeometric(rng, c, total - c, drawn)
        total, drawn = total - c, drawn - int(out[i])
    return out


def matrix_row(part: int, sizes: np.ndarray, capacity: np.ndarray, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: rows from this partition to each block.

    The partitions are halved again and again; each half's share of every block is
    one multivariate hypergeometric draw, seeded by the half, so that every task
    finds the same matrix and none has to hold it.
    """
    before = np.concatenate(([0], np.cumsum(sizes)))
    lo, hi, left = 0, len(sizes), capacity.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _split(np.random.default_rng([seed, lo, hi]), left, int(before[mid] - before[lo]))
        lo, hi, left = (lo, mid, first) if part < mid else (mid, hi, left - first)
    return left


def shard_rows(df: DataFrame, n_shards: int, seed: int = 17, rows_per_block: int = 1 << 14) -> DataFrame:
    """A uniform random permutation of all rows, dealt into shards of exact sizes.

    Adds ``shard`` (0..n-1; row counts at most one apart, the first shards have the
    extra rows) and ``slot`` (gapless from 0 in each shard). Columns of these names
    are replaced; all others, of any name, nulls, long texts and repeated rows are carried
    as they are. An empty table gives an empty table.

    Three steps: an exact count of rows from every partition to every block of a
    shard is drawn (hypergeometric), every partition permutes its own rows by
    dealing them a shuffled list of that many block labels, and after one exchange
    every block is permuted by random tickets. Blocks hold at most
    ``rows_per_block`` rows, so no task gets a whole shard. The input is fixed by a
    checkpoint first, as the draw and the deal must see the same partitions; the
    seeds then make a lost task's second run deal the same labels.
    """
    carried = small_batches(df).drop("shard", "slot")
    fixed = cut(plain(carried))
    block, ticket, place = "_block", "_ticket", "_place"
    parts = fixed.rdd.getNumPartitions()
    sizes = np.zeros(parts, np.int64)
    for p, n in fixed.groupBy(F.spark_partition_id().alias("p")).count().collect():  # one row for each partition
        sizes[p] = n
    total = int(sizes.sum())
    small, extra = divmod(total, n_shards)
    blocks = max(1, -(-(small + 1) // rows_per_block))
    upto = lambda rows, j: rows // blocks * j + rows % blocks * j // blocks  # the rows of a shard's first j blocks, in whole numbers
    steps = np.arange(blocks + 1, dtype=np.int64)
    capacity = np.concatenate([np.diff(upto(small + (s < extra), steps)) for s in range(n_shards)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        labels = np.repeat(np.arange(len(capacity), dtype=np.int32), matrix_row(part, sizes, capacity, seed))
        np.random.default_rng([seed, part, 1]).shuffle(labels)
        tickets, at = np.random.default_rng([seed, part, 2]), 0
        for batch in batches:
            mine = labels[at:at + batch.num_rows]
            if len(mine) < batch.num_rows:
                raise RuntimeError("a partition has more rows than were counted")
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(mine), pa.array(tickets.integers(0, 2**63 - 1, len(mine), dtype=np.int64))],
                names=[*batch.schema.names, block, ticket],
            )
        if at < len(labels):
            raise RuntimeError("a partition has fewer rows than were counted")

    fields = StructType([*fixed.schema.fields, StructField(block, IntegerType()), StructField(ticket, LongType())])
    dealt = fixed.mapInArrow(deal, fields)
    within = F.row_number().over(Window.partitionBy(block).orderBy(ticket))
    whole = lambda a, b: F.call_function("div", a, b)
    shard = whole(F.col(block).cast("long"), F.lit(blocks).cast("long")).cast("int")
    j = (F.col(block) % blocks).cast("long")
    first = lambda rows: F.lit(rows // blocks).cast("long") * j + whole(F.lit(rows % blocks).cast("long") * j, F.lit(blocks).cast("long"))
    base = F.when(shard < extra, first(small + 1)).otherwise(first(small))
    out = dealt.withColumn(place, within).select(*fixed.columns, shard.alias("shard"), (base + F.col(place) - 1).alias("slot"))
    return out.toDF(*carried.columns, "shard", "slot")


def sharded_documents(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of all documents, which are dealt with their texts.

    A null text has size 1 and checksum 0; equal texts have equal digests, but any shard.
    """
    dealt = shard_rows(docs, n_shards)
    return dealt.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
    )
