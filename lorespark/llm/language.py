"""12. Language identification by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm import kernels as K
from lorespark.llm.frames import small_batches
from lorespark.llm.labelled import Adam

FOLDS, HELD = 4, 2
WINDOW = 256
WIDTHS = (2, 3, 4)
STRIDE = WINDOW - max(WIDTHS) + 1  # windows overlap, so that every run of bytes that a filter sees is in one
FILTERS = 32
EMBEDDING = 12
PER_LANGUAGE = 600
PER_DOCUMENT = 4
LANGUAGES = 64
UNKNOWN = "und"
_AT_ONCE = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    """A number for each byte, the answer of each filter to each byte at each of its places, biases, and the last layer."""

    languages: list[str]
    symbol: np.ndarray
    answers: list[list[np.ndarray]]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def windows(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The text number and first byte of each window; a text of n bytes has 1 + (n - 4) / 253 of them, an empty one none."""
    size = np.diff(offsets)
    n = np.where(size > 0, 1 + np.maximum(size - max(WIDTHS), 0) // STRIDE, 0)
    text = np.repeat(np.arange(len(size)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE + offsets[:-1][text]


def window_bytes(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rows of WINDOW bytes from each ``first``, with zeros from ``stop`` on."""
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < stop[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def _pairs(answers: list[list[np.ndarray]], biases: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The filters' answers to two bytes at a time, as one table of all pairs; a last odd byte keeps its own."""
    out = []
    for width, bias in zip(answers, biases, strict=True):
        tables = []
        for j in range(0, len(width), 2):
            table = width[j] if j + 1 == len(width) else (width[j][:, None, :] + width[j + 1][None, :, :]).reshape(-1, width[j].shape[1])
            tables.append((table + bias if j == 0 else table).astype(np.float32))
        out.append(tables)
    return out


def convolved(x: np.ndarray, tables: list[list[np.ndarray]], size: int) -> Iterator[np.ndarray]:
    """For each width, places x windows x filters, of symbols (places x windows): a table's rows for all pairs of neighbours."""
    pair = x[:-1] * size + x[1:]
    for width, parts in zip(WIDTHS, tables, strict=True):
        places = len(x) - width + 1
        made = np.take(parts[0], pair[:places], axis=0)
        for j, table in enumerate(parts[1:], 1):
            made += np.take(table, (pair if 2 * j + 1 < width else x)[2 * j:2 * j + places], axis=0)
        yield made


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: Model, rows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Of each window (bytes) and language: filters of each width, greatest answers over the window, and softmax."""
    out = np.zeros((len(rows), len(model.languages)))
    for at in range(0, len(rows), _AT_ONCE):
        x = model.symbol[rows[at:at + _AT_ONCE].T]
        pooled = np.concatenate([y.max(axis=0) for y in convolved(x, tables, int(model.symbol.max()) + 1)], axis=1)
        out[at:at + _AT_ONCE] = _softmax(np.maximum(pooled, 0) @ model.dense + model.offset)
    return out


def train(rows: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 12) -> Model:
    """Fits the network to windows (bytes) and their languages' numbers, by Adam on mini-batches.

    Bytes that no window has share a number. A third of the windows of each batch is cut
    to a random length, as texts may be short.
    """
    rng = np.random.default_rng(seed)
    seen = np.unique(rows)
    symbol = np.zeros(256, np.intp)
    symbol[seen] = np.arange(1, len(seen) + 1)
    symbol[0] = 0
    size = int(symbol.max()) + 1
    bytes_ = rng.normal(0, 0.5, (size, EMBEDDING))
    kernels = [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
    biases = [np.zeros(FILTERS) for _ in WIDTHS]
    dense, offset = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages))
    adam = Adam([bytes_, *kernels, *biases, dense, offset], rate)
    x_all = symbol[rows]
    steps, step = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            adam.rate, step = rate * (1 - step / steps) + 1e-4, step + 1
            mine = order[at:at + batch]
            x = x_all[mine]
            short = np.where(rng.random(len(mine)) < 0.33, rng.integers(12, WINDOW, len(mine)), WINDOW)
            x = np.where(np.arange(WINDOW) < short[:, None], x, 0).T
            answers = [[bytes_ @ k[j] for j in range(len(k))] for k in kernels]
            tables = _pairs(answers, biases)
            best, pooled = [], []
            for made in convolved(x, tables, size):
                best.append(made.argmax(axis=0))
                pooled.append(np.take_along_axis(made, best[-1][None], axis=0)[0].astype(float))
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            error = _softmax(hidden @ dense + offset)
            error[np.arange(len(mine)), y[mine]] -= 1
            error /= len(mine)
            back = (error @ dense.T) * (raw > 0)
            g_bytes, g_kernels, g_biases = np.zeros_like(bytes_), [], []
            for w, kernel in enumerate(kernels):
                g = back[:, w * FILTERS:(w + 1) * FILTERS]
                g_biases.append(g.sum(axis=0))
                g_kernel = np.zeros_like(kernel)
                for j in range(len(kernel)):  # only the places of the greatest answers count
                    met = np.take_along_axis(x, (best[w] + j).T, axis=0).T
                    g_answer = np.bincount((met * FILTERS + np.arange(FILTERS)).ravel(), weights=g.ravel(), minlength=size * FILTERS).reshape(size, FILTERS)
                    g_kernel[j] = bytes_.T @ g_answer
                    g_bytes += g_answer @ kernel[j].T
                g_kernels.append(g_kernel + 1e-4 * kernel)
            adam.step([g_bytes, *g_kernels, *g_biases, hidden.T @ error + 1e-4 * dense, error.sum(axis=0)])
    return Model(languages, symbol, [[(bytes_ @ k[j]).astype(np.float32) for j in range(len(k))] for k in kernels], [b.astype(np.float32) for b in biases], dense, offset)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, per_document: int = PER_DOCUMENT, languages: int = LANGUAGES, seed: int = 5) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows (bytes), their languages' numbers and the languages: the bounded sample that a model is fitted on.

    Of each of the ``languages`` most frequent values of ``lang``, at most ``per_language``
    documents outside the held-out fold, chosen by a hash of their id, and of each at most
    ``per_document`` windows with letters, anywhere in the text. Null ids, languages and
    texts don't count; of rows that share an id and a language one counts.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counted = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counted:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    place = F.xxhash64("doc_id", F.lit(seed))
    # Somewhat more than enough: a bound on the hash for each language
    parts = {r["lang"]: min(1.0, 1.3 * (per_language + 50) / r["count"]) for r in counted}
    lows = F.create_map(*[x for k, part in parts.items() for x in (F.lit(k), F.lit(min(-(1 << 63) + int(part * (1 << 64)), (1 << 63) - 1)).cast("long"))])
    few = known.where(place <= lows[F.col("lang")]).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"), place.alias("place"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(2))
            ids = batch.column(0).to_pylist()
            made = []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                _, first = windows(data, np.array([lo, hi]))
                first = np.random.default_rng([seed, ids[i] & (2**63 - 1)]).permutation(first)[:per_document]
                rows = window_bytes(data, first, np.full(len(first), hi)) if len(first) else np.zeros((0, WINDOW), np.uint8)
                made.append(_LOWER[rows[_LETTER[rows].any(axis=1)]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(made, pa.binary())], names=["doc_id", "lang", "place", "windows"])

    cut = few.mapInArrow(cut_up, "doc_id long, lang string, place long, windows binary").where(F.octet_length("windows") > 0)
    once = cut.groupBy("lang", "doc_id", "place").agg(F.max("windows").alias("windows"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))  # about 1.3 * per_language rows of each
    rows = once.withColumn("turn", turn).where(F.col("turn") <= per_language).orderBy("lang", "place", "doc_id").select("lang", "windows").collect()
    names = sorted({r["lang"] for r in rows})
    made = [np.frombuffer(bytes(r["windows"]), np.uint8).reshape(-1, WINDOW) for r in rows]
    y = np.concatenate([np.full(len(m), names.index(r["lang"])) for r, m in zip(rows, made, strict=True)]) if rows else np.zeros(0, np.int64)
    return np.concatenate(made) if made else np.zeros((0, WINDOW), np.uint8), y, names


def fit(docs: DataFrame, **bounds: int) -> Model | None:
    """The network fitted on ``sample(docs, **bounds)``; None where that has no window."""
    rows, y, names = sample(docs, **bounds)
    return train(rows, y, names) if len(rows) else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row, from all windows of its whole text.

    A window's probabilities count by its letters; ``lang_pred`` has the greatest mean, the
    score. A text that is null or without letters, or any text without a model, is "und"
    with score 0; repeated rows are judged alike; an empty table gives no rows.
    """
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(model is not None)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.when(has_letter, F.col("text").cast("string")).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 bytes x filters, whatever the data

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = _pairs(own.answers, own.biases)
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            for lo, hi, d, o in K.slices(data, offsets):
                d = _LOWER[d]
                text, first = windows(d, o)
                sums = np.zeros((hi - lo, len(own.languages)))
                for at in range(0, len(text), 16 * _AT_ONCE):
                    t = text[at:at + 16 * _AT_ONCE]
                    x = window_bytes(d, first[at:at + 16 * _AT_ONCE], o[1:][t])
                    np.add.at(sums, t, probabilities(own, x, tables) * _LETTER[x].sum(axis=1)[:, None])
                total = sums.sum(axis=1)
                known = total > 0
                share = sums / np.where(known, total, 1)[:, None]
                names = [own.languages[k] if ok else UNKNOWN for k, ok in zip(share.argmax(axis=1).tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(np.minimum(share.max(axis=1), 1.0))], names=["doc_id", "lang_pred", "score"])
        K.release()

    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double")


def predicted_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of the rows outside the held-out fold.

    A null id is not held out, and not learned from. Of a text only letters' windows count;
    null, empty and letterless texts are "und" with score 0, as are all without a
    language to learn. Very long texts are read whole; other columns aren't read.
    """
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
