"""The bounded, documented sample of labelled rows that the two classifiers fit on."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lorespark.llm import kernels as K
from lorespark.llm.frames import cut, held_out

Model = TypeVar("Model")

FOLDS = 5
MAX_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, extra: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label and text (and ``extra``) of at most ``per_class`` documents and half of ``max_bytes`` of text of either label, whole texts; and how many documents have each label.

    Only rows outside the held-out fold count. Rows are chosen by a hash of their id,
    so the choice depends neither on the table's order nor its partitions. Repeated
    label rows count once (the largest label); null labels and null ids don't count. Of
    rows that share an id, the one with the least text is taken. A text of more than a
    sixteenth of ``max_bytes`` is not in the sample. The bytes are counted by sizes alone,
    so that no task gets more texts than the sample holds.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.xxhash64("doc_id", F.lit(7))

    def first(of: int) -> DataFrame:
        """The first ids by hash; a bound on the hash leaves somewhat more than enough to sort."""
        part = min(1.0, 1.3 * (per_class + 50) / max(1, share.get(of, 0)))
        low = min(-(1 << 63) + int(part * (1 << 64)), (1 << 63) - 1)
        return known.where((F.col("label") == of) & (place <= F.lit(low))).orderBy(place, "doc_id").limit(per_class)

    chosen = first(0).unionByName(first(1))
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes // 16)  # 2 * per_class ids at most
    rows = cut(rows.groupBy("doc_id", "label").agg(F.min(F.struct(text, *extra)).alias("x")).select("doc_id", "label", "x.*"))
    held = F.sum("size").over(Window.partitionBy("label").orderBy(place, "doc_id"))
    sizes = rows.select("doc_id", "label", F.octet_length("text").cast("long").alias("size")).withColumn("held", held)
    fits = sizes.where(F.col("held") <= max_bytes // 2).select("doc_id")
    return rows.join(F.broadcast(fits), "doc_id", "left_semi"), share


def weighted(rows: pa.Table, share: dict[int, int]) -> pd.DataFrame:
    """The sample by id, with each row's ``weight``: its label's share of all labels over that of the sample. Texts stay in Arrow's memory."""
    frame = rows.to_pandas(types_mapper=lambda t: pd.ArrowDtype(t) if pa.types.is_string(t) else None)
    frame = frame.sort_values("doc_id").reset_index(drop=True)
    have = frame["label"].value_counts()
    total = sum(share.values()) or 1
    frame["weight"] = [share[x] / total / have[x] * len(frame) for x in frame["label"]]
    return frame


def fit_in_task(rows: DataFrame, train: Callable[[pa.Table], Model]) -> Model:
    """What ``train`` makes of a bounded sample. It runs in one task, so the driver only gets the model."""
    kind = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        made = pickle.dumps(train(pa.Table.from_batches(held) if held else kind.empty_table()))
        del held
        K.release()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return train(kind.empty_table()) if made is None else pickle.loads(bytes(made["model"]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h + 1e-9 * np.eye(len(h)), x.T @ (weight * (y - p)) - penalty * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
