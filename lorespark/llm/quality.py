"""10. Quality by a factorisation machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import kernels as K
from lorespark.llm.frames import held_out, small_batches
from lorespark.llm.labelled import Adam, FOLDS, fit_in_task, labelled_sample, weighted

WORD_BITS = 14
STATS = 16
BINS = 12
RANK = 8
PER_CLASS = 3000
_SIZE = (1 << WORD_BITS) + STATS * BINS

_CLASS = np.zeros((6, 256), dtype=bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [ord(c) for c in ".,;:'\"-()"]] = True
_CLASS[3, [ord(c) for c in "!?#$%&*+/<=>@[\\]^_`{|}~"]] = True
_CLASS[4, 128:] = True
_CLASS[5, 10] = True


@dataclass
class Model:
    edges: np.ndarray  # STATS x (BINS-1) bin edges
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # features x RANK


def _repeats(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Share of distinct keys in each document (1 where it has none)."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return np.where(n > 0, np.bincount(d[first], minlength=len(n)) / np.maximum(n, 1), 1.0)


def features(data: np.ndarray, offsets: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of the hashed words, and the statistics of each document.

    A word's value is the root of its count, over the length of all of a document's
    values. ``metadata`` is one number of each document, such as its stated length.
    """
    starts, ends, bounds = K.word_bounds(data, offsets)
    words = K.word_hashes(data, starts, ends)
    n_docs = len(offsets) - 1
    n_words, n_bytes = np.diff(bounds), np.diff(offsets)
    stats = np.zeros((n_docs, STATS))
    for k in range(5):
        stats[:, k] = K.per_row_sums(_CLASS[k][data], offsets) / np.maximum(n_bytes, 1)
    lines = K.per_row_sums(_CLASS[5][data], offsets)
    size = ends - starts
    stats[:, 5] = n_words / (lines + 1)
    stats[:, 6] = np.log1p(n_words)
    stats[:, 7] = K.per_row_sums(size, bounds) / np.maximum(n_words, 1)
    stats[:, 8] = np.sqrt(np.maximum(K.per_row_sums(size.astype(float) ** 2, bounds) / np.maximum(n_words, 1) - stats[:, 7] ** 2, 0))
    stats[:, 9] = _repeats(words, bounds)
    pairs = K.run_hashes(words, 2)
    within = np.minimum(bounds, len(pairs))
    stats[:, 10] = _repeats(pairs, within) if len(pairs) else 1.0
    stats[:, 11] = np.log1p(np.maximum(metadata, 0))
    stats[:, 12] = metadata / np.maximum(n_bytes, 1)
    ends_marked = _CLASS[3][data[ends - 1]] if len(ends) else np.zeros(0, bool)
    stats[:, 13] = K.per_row_sums(ends_marked, bounds) / np.maximum(n_words, 1)
    capital = (_CLASS[0][data[starts]] & _CLASS[0][data[ends - 1]]) if len(ends) else np.zeros(0, bool)
    stats[:, 14] = K.per_row_sums(capital, bounds) / np.maximum(n_words, 1)
    alone = (_CLASS[3][data[starts]] & (size == 1)) if len(ends) else np.zeros(0, bool)
    stats[:, 15] = K.per_row_sums(alone, bounds) / np.maximum(n_words, 1)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), n_words)
    keys, n = K.counted(doc << WORD_BITS | (words >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    doc, bucket, value = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1), np.sqrt(n)
    norm = np.sqrt(np.bincount(doc, weights=value**2, minlength=n_docs))
    return doc, bucket, value / np.maximum(norm[doc], 1e-9), stats


def _rows(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: the words of each document, then its STATS one-hot bins; and the row bounds."""
    n_docs = len(stats)
    bins = np.stack([np.searchsorted(edges[k], stats[:, k], "right") for k in range(STATS)], axis=1)
    bins += (1 << WORD_BITS) + np.arange(STATS) * BINS
    order = np.argsort(np.concatenate([doc, np.repeat(np.arange(n_docs), STATS)]), kind="stable")
    index = np.concatenate([bucket, bins.ravel()])[order]
    values = np.concatenate([value, np.full(n_docs * STATS, 0.25)])[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs) + STATS)])
    return index, values, bounds


def machine(model: Model, index: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's output and its factor sums S: all pairs' interactions are (S^2 - sum of squares) / 2."""
    if len(bounds) < 2:
        return np.zeros(0), np.zeros((0, RANK))
    parts = model.factors[index] * values[:, None]
    sums = np.add.reduceat(parts, bounds[:-1])
    squares = np.add.reduceat(parts * parts, bounds[:-1])
    linear = np.add.reduceat(model.linear[index] * values, bounds[:-1])
    return model.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums


def _prepared(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("double")
    stated = F.coalesce(F.col("n_chars").cast("double"), size) if "n_chars" in docs.columns else size
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stated.alias("stated"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = 10, batch: int = 128, seed: int = 3) -> Model:
    """Fits on at most ``per_class`` labelled documents of either label, weighted to the labels' shares.

    With no labels of one kind, every document scores their share (a half with none).
    """
    rows, share = labelled_sample(_prepared(docs), labels, "quality", per_class, ("stated",))
    return fit_in_task(rows, lambda t: _trained(weighted(t, share), epochs, batch, seed))


def _trained(rows: pd.DataFrame, epochs: int, batch: int, seed: int) -> Model:
    y, weight = rows["label"].to_numpy().astype(float), rows["weight"].to_numpy()
    share = float(np.average(y, weights=weight)) if len(rows) else 0.5
    rng = np.random.default_rng(seed)
    model = Model(np.zeros((STATS, BINS - 1)), float(np.log((share + 0.02) / (1.02 - share))), np.zeros(_SIZE), np.zeros((_SIZE, RANK)))
    if len(rows) == 0 or y.min() == y.max():
        return model
    data, offsets = K.column_bytes(pa.array(rows["text"]))
    parts = [(lo, features(d, o, rows["stated"].to_numpy()[lo:hi])) for lo, hi, d, o in K.slices(data, offsets)]
    doc = np.concatenate([lo + f[0] for lo, f in parts])
    bucket, value = (np.concatenate([f[k] for _, f in parts]) for k in (1, 2))
    stats = np.concatenate([f[3] for _, f in parts])
    model.edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    model.factors = rng.normal(0, 0.05, (_SIZE, RANK))
    index, values, bounds = _rows(doc, bucket, value, stats, model.edges)
    bias = np.array([model.bias])
    adam = Adam([bias, model.linear, model.factors], 0.02)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            chosen = order[at:at + batch]
            n = np.diff(bounds)[chosen]
            own = np.concatenate([[0], np.cumsum(n)])
            flat = np.repeat(bounds[:-1][chosen] - own[:-1], n) + np.arange(own[-1])
            i, v = index[flat], values[flat]
            model.bias = float(bias[0])
            out, sums = machine(model, i, v, own)
            error = weight[chosen] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[chosen]) / len(chosen)
            e = np.repeat(error, n) * v
            g_linear = np.bincount(i, weights=e, minlength=_SIZE)
            parts_v = e[:, None] * (np.repeat(sums, n, axis=0) - model.factors[i] * v[:, None])
            g_factors = np.stack([np.bincount(i, weights=parts_v[:, f], minlength=_SIZE) for f in range(RANK)], axis=1)
            adam.step([np.array([error.sum()]), g_linear + 1e-5 * model.linear, g_factors + 1e-5 * model.factors])
    model.bias = float(bias[0])
    del index, values, stats, doc, bucket, value
    K.release()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row; a null text is empty, repeated rows score equal.

    An empty text has its statistics alone. Other columns aren't read, but for
    ``n_chars`` where the table has it (a null: the text's own length).
    """
    fields = (model.edges, model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(fields)  # 2 ** WORD_BITS rows, whatever the data

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            stated = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, d, o in K.slices(data, offsets):
                doc, bucket, value, stats = features(d, o, stated[lo:hi])
                index, values, bounds = _rows(doc, bucket, value.astype(np.float32), stats, own.edges)
                out, _ = machine(own, index, values.astype(np.float32), bounds)
                made = 1 / (1 + np.exp(-np.clip(out.astype(float), -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(made), pa.array((made >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    return _prepared(docs).mapInArrow(judge, "doc_id long, score double, predicted int")


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null id is not held out; a null text is empty and scores by its statistics alone;
    repeated rows score alike; without labels of both kinds every document scores their
    share (a half with none); an empty table gives no rows.
    """
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", "predicted")
