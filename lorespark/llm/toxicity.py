"""3. Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from lorespark.llm import kernels as K
from lorespark.llm.frames import held_out, plain, small_batches, texts
from lorespark.llm.labelled import FOLDS, Adam, fit_in_task, labelled_sample, logistic, weighted

BITS = 18
PER_CLASS = 2500
PREFIXES = (4, 5, 6)
SEGMENT = 64
CHAIN = 2048
CHUNK = 4096
CHAIN_BYTES = 6 << 20
SUSPECT = 0.25

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True


@dataclass
class Model:
    weights: np.ndarray  # one for each hashed feature
    trans: np.ndarray  # log-potentials, from row to column
    beta: np.ndarray  # document score from the marginals
    fitted: bool = True  # labels of both kinds were there


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (tokens x 4), byte starts and ends of the trimmed words, word bounds.

    A token's features are its letters and digits in lower case, without marks at
    either end, and the first 4, 5 and 6 bytes of them.
    """
    starts, ends, bounds = K.word_bounds(data, offsets)
    solid = _ALNUM[data]
    places = np.append(np.flatnonzero(solid), len(data))
    rank = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=rank[1:])
    s, e = places[rank[starts]], places[np.maximum(rank[ends] - 1, 0)] + 1
    empty = rank[starts] == rank[ends]
    s, e = np.where(empty, starts, s), np.where(empty, ends, e)
    shift = np.uint64(64 - BITS)
    made = [K.word_hashes(data, s, e, lower=True) >> shift]
    for i, n in enumerate(PREFIXES):
        h = K.word_hashes(data, s, np.minimum(s + n, e), lower=True)
        made.append((h * np.uint64(2 * i + 3) + np.uint64(i + 1)) >> shift)
    return np.stack(made, axis=1).astype(np.int32), s, e, bounds


def filtered(odds: np.ndarray, bounds: np.ndarray, a: np.ndarray, segment: int = CHAIN) -> np.ndarray:
    """Forward odds of each token: p = o for a text's first, then o * (a01 + a11 p) / (a00 + a10 p), all texts in step.

    A chain of more than ``segment`` tokens is cut: each of its segments is a product of 2 x 2
    matrices, found for all segments in step; these carry the odds from segment to segment,
    and then all tokens are gone through again, again in step. So a text of n tokens takes
    about 2 * segment + n / segment steps.
    """
    size = np.diff(bounds)
    n = -(-size // segment)
    text = np.repeat(np.arange(len(size)), n)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = bounds[:-1][text] + turn * segment
    length = np.minimum(bounds[1:][text] - first, segment)
    entry = np.ones(len(text))
    longest = np.flatnonzero(turn > 0)
    if len(longest):
        whole = np.flatnonzero(length == segment)  # all but the last of a text are whole
        o, fresh = odds[first[whole]], turn[whole] == 0
        m = np.array([[o * a[1, 1], o * a[0, 1]], [np.full(len(o), a[1, 0]), np.full(len(o), a[0, 0])]])
        m[0, 0, fresh], m[0, 1, fresh], m[1, 0, fresh], m[1, 1, fresh] = 0, o[fresh], 0, 1
        for t in range(1, segment):
            o = odds[first[whole] + t]
            top, low = o * (a[1, 1] * m[0] + a[0, 1] * m[1]), a[1, 0] * m[0] + a[0, 0] * m[1]
            m = np.array([top, low])
            m /= m.max(axis=(0, 1))
        place = np.full(len(text), -1)
        place[whole] = np.arange(len(whole))
        by_turn = np.argsort(turn, kind="stable")
        cuts = np.searchsorted(turn[by_turn], np.arange(int(turn.max()) + 2))
        for k in range(1, int(turn.max()) + 1):
            at = by_turn[cuts[k]:cuts[k + 1]]
            before = place[at - 1]
            p = entry[at - 1]
            entry[at] = (m[0, 0, before] * p + m[0, 1, before]) / (m[1, 0, before] * p + m[1, 1, before])
    order = np.argsort(-length, kind="stable")
    first, length, entry, fresh = first[order], length[order], entry[order], turn[order] == 0
    out = np.empty_like(odds)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # segments with more than t tokens
    step = lambda p: (a[0, 1] + a[1, 1] * p) / (a[0, 0] + a[1, 0] * p)
    p = entry
    for t in range(steps):
        p = p[:active[t]]
        at = first[:active[t]] + t
        p = odds[at] * (step(p) if t else np.where(fresh, 1.0, step(p)))
        out[at] = p
    return out


def marginals(emission: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each token, from forward odds and, over the texts reversed, backward odds."""
    odds = np.exp(np.clip(emission, -30, 30)).astype(np.float64)
    a = np.exp(trans)
    back = filtered(odds[::-1], len(odds) - np.asarray(bounds)[::-1], a.T)[::-1]
    both = filtered(odds, np.asarray(bounds), a) * back / odds  # the token's own odds are in both
    return both / (1 + both)


def _gradient(emission: np.ndarray, gold: np.ndarray, mask: np.ndarray, trans: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood, for padded segments (time x segments): by emission and by transition."""
    steps, n = emission.shape
    a = np.exp(trans)
    e1 = np.exp(np.clip(emission, -30, 30))
    alpha, beta = np.zeros((steps, n)), np.zeros((steps, n))  # P(1) forwards; odds backwards
    p = e1[0]
    alpha[0] = p
    for t in range(1, steps):
        p = e1[t] * (a[0, 1] + a[1, 1] * p) / (a[0, 0] + a[1, 0] * p)
        alpha[t] = p
    q = np.ones(n)
    beta[-1] = q
    for t in range(steps - 2, -1, -1):
        r = q * e1[t + 1]
        q = np.where(mask[t + 1], (a[1, 0] + a[1, 1] * r) / (a[0, 0] + a[0, 1] * r), 1.0)
        beta[t] = q
    both = alpha * beta
    gamma = both / (1 + both)
    d_emission = np.where(mask, (gold - gamma) * weight, 0)
    right = e1[1:] * beta[1:]
    pair = np.stack([np.ones_like(right) * a[0, 0], a[0, 1] * right, a[1, 0] * alpha[:-1], a[1, 1] * alpha[:-1] * right])
    pair /= pair.sum(axis=0)
    seen = gold[:-1] * 2 + gold[1:]
    ok = mask[1:] * weight
    d_trans = np.array([((seen == k) * ok).sum() - (pair[k] * ok).sum() for k in range(4)]).reshape(2, 2)
    return d_emission, d_trans


def _features_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all tokens of these texts, and each text's bounds among them."""
    data, offsets = K.column_bytes(column)
    parts, words = [np.zeros((0, 1 + len(PREFIXES)), np.int32)], [np.zeros(1, np.int64)]
    for _, _, d, o in K.slices(data, offsets):
        own, _, _, bounds = token_features(d, o)
        parts.append(own)
        words.append(np.diff(bounds))
    return np.concatenate(parts), np.cumsum(np.concatenate(words))


def _weak_tokens(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Token labels from document labels: in a toxic document, the tokens with a feature that toxic documents have far more often."""
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    hot = np.zeros(1 << BITS, bool)
    for k in range(features.shape[1]):
        pairs = np.unique(doc.astype(np.int64) << BITS | features[:, k])
        bucket, owner = pairs & ((1 << BITS) - 1), pairs >> BITS
        t = np.bincount(bucket[toxic[owner]], minlength=1 << BITS)
        c = np.bincount(bucket[~toxic[owner]], minlength=1 << BITS)
        hot |= (t >= 4) & (t / n_toxic > 8 * (c + 1) / n_clean)
    return hot[features].any(axis=1) & toxic[doc]


def _document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document: largest marginal, log of the expected toxic tokens among those suspected, their share, length.

    Tokens below SUSPECT count nothing, so that a long text of unknown words, each a little
    likely, does not add up to a toxic one.
    """
    n = np.diff(bounds)
    top = np.zeros(len(n))
    some = n > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, bounds[:-1][some])
    total = K.per_row_sums(np.where(p >= SUSPECT, p, 0.0), bounds)
    return np.column_stack([top, np.log1p(total), total / np.maximum(n, 1), np.log1p(n) / 10])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = 40) -> Model:
    """Fits tags and transitions on two thirds of the sample, the document score on the rest.

    The sample is bounded by ``per_class`` documents of either label. With no labels of
    one kind every document scores the share of label 1 (a half where there are none).
    """
    rows, share = labelled_sample(texts(docs), labels, "toxic", per_class)
    return fit_in_task(rows, lambda t: _trained(weighted(t, share), rounds))


def _trained(rows: pd.DataFrame, rounds: int) -> Model:
    toxic = rows["label"].to_numpy() == 1
    model = Model(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), np.zeros(5))
    if toxic.all() or not toxic.any():
        share = toxic.mean() if len(toxic) else 0.5
        model.beta[-1] = np.log((share + 0.02) / (1.02 - share))
        model.weights -= 10
        model.fitted = False
        return model
    held = pa.array(rows.pop("text"))
    for_tags = np.arange(len(rows)) % 3 != 2
    rest = ~for_tags
    x, bounds = _features_of(held.filter(pa.array(for_tags)))
    held = held.filter(pa.array(rest))
    K.release()
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    gold = _weak_tokens(x, owner, toxic[for_tags])
    within = (np.arange(len(owner)) - np.searchsorted(owner, owner)) % SEGMENT
    starts = np.append(np.flatnonzero(within == 0), len(owner))
    total = max(1, len(owner))
    rare = total / max(1.0, float(gold.sum()))
    low = np.float32(-np.log(rare) / 4)  # a token's features start at the share of toxic tokens together
    model.weights += low
    adam = Adam([model.weights, model.trans], 0.15)
    for _ in range(rounds):
        grad, d_trans = np.zeros(1 << BITS), np.zeros((2, 2))
        for at in range(0, len(starts) - 1, CHUNK):  # segments by chunks, so that only small arrays are made
            first, last = starts[at], starts[min(at + CHUNK, len(starts) - 1)]
            row, n = within[first:last], min(CHUNK, len(starts) - 1 - at)
            col = np.cumsum(row == 0) - 1
            own = x[first:last]
            emission, tags, mask = np.zeros((SEGMENT, n)), np.zeros((SEGMENT, n)), np.zeros((SEGMENT, n), bool)
            emission[row, col], tags[row, col], mask[row, col] = model.weights[own].sum(axis=1), gold[first:last], True
            d_emission, d = _gradient(emission, tags, mask, model.trans, 1.0)
            d_trans += d
            d_emission = d_emission[row, col]
            for k in range(own.shape[1]):
                grad += np.bincount(own[:, k], weights=d_emission, minlength=1 << BITS)
        adam.step([(-grad + 0.02 * (model.weights - low)).astype(np.float32), -d_trans / total * rare + 0.01 * model.trans])
    del x, owner, within, gold
    K.release()
    x, bounds = _features_of(held)
    emission = np.concatenate([model.weights[x[a:a + 100_000]].sum(axis=1) for a in range(0, len(x), 100_000)] or [np.zeros(0, np.float32)])
    made = _document_features(marginals(emission, bounds, model.trans), bounds)
    model.beta = logistic(made, toxic[rest].astype(float), rows["weight"].to_numpy()[rest], ridge=0.1)
    del x, held, emission, made
    K.release()
    return model


def _judged(docs: DataFrame, model: Model, text_column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """A task's function: parts of its batches with each row's score, number of spans and spans."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.trans, model.beta))  # 2 ** BITS weights
    text_at = docs.columns.index(text_column)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[str]]]:
        weights, trans, beta = shared.value
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(text_at))
            for lo, hi, d, o in K.slices(data, offsets, CHAIN_BYTES):
                emission, starts, ends, n_words = [], [], [], []
                for a, _, dd, oo in K.slices(d, o):
                    own, s, e, bounds = token_features(dd, oo)
                    emission.append(weights[own].sum(axis=1))
                    starts.append(o[a] + s)
                    ends.append(o[a] + e)
                    n_words.append(np.diff(bounds))
                emission, starts, ends = (np.concatenate(x) for x in (emission, starts, ends))
                bounds = np.concatenate([[0], np.cumsum(np.concatenate(n_words))])
                p = marginals(emission, bounds, trans)
                x = np.column_stack([_document_features(p, bounds), np.ones(hi - lo)]) @ beta
                yield batch.slice(lo, hi - lo), 1 / (1 + np.exp(-np.clip(x, -30, 30))), *_spans(d, o, p, starts, ends, bounds)
        K.release()

    return judge


def score(docs: DataFrame, model: Model, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted``, ``n_spans`` and ``spans`` to every row.

    ``spans`` lists, as "start-end" in characters of the text, the runs of words whose
    marginal is a half or more. A null or empty text has no token and scores what a
    text without toxic words and of no length scores. Columns of these names are
    replaced; repeated rows get equal values; an empty table stays empty.
    """
    carried = small_batches(docs).drop("score", "predicted", "n_spans", "spans")
    judge = _judged(carried, model, text_column)
    docs = plain(carried)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, made, n_spans, spans in judge(batches):
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(made), pa.array((made >= threshold).astype(np.int32)), pa.array(n_spans), pa.array(spans)],
                names=[*part.schema.names, "score", "predicted", "n_spans", "spans"],
            )

    more = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("n_spans", IntegerType()), StructField("spans", StringType())]
    return docs.mapInArrow(add, StructType([*docs.schema.fields, *more])).toDF(*carried.columns, *[f.name for f in more])


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows that score below ``threshold``, as they are, whatever their columns are called.

    Where the model could not be fitted, for want of labels of both kinds, nothing is
    known to be toxic and every row stays. Null and empty texts have no toxic token and
    stay; repeated rows go or stay together; an empty table stays empty.
    """
    if not model.fitted:
        return docs
    judge = _judged(small_batches(docs), model, "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, made, _, _ in judge(batches):
            yield part.filter(pa.array(made < threshold))

    rows = plain(docs)
    return rows.mapInArrow(keep, rows.schema).toDF(*docs.columns)


def _spans(data: np.ndarray, offsets: np.ndarray, p: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[str]]:
    hot = np.flatnonzero(p >= 0.5)
    n = len(offsets) - 1
    if not len(hot):
        return np.zeros(n, np.int32), [""] * n
    doc = np.searchsorted(bounds, hot, "right") - 1
    new = np.concatenate(([True], (np.diff(hot) > 1) | (np.diff(doc) > 0)))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(hot)) - 1
    chars = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, dtype=np.int32, out=chars[1:])
    owner = doc[heads]
    begin = chars[starts[hot[heads]]] - chars[offsets[owner]]
    end = chars[ends[hot[tails]]] - chars[offsets[owner]]
    listed = [f"{b}-{e}" for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
    n_spans = np.bincount(owner, minlength=n).astype(np.int32)
    at = np.concatenate([[0], np.cumsum(n_spans)]).tolist()
    return n_spans, [",".join(listed[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the spans of every document.

    A null id is not held out; a null or empty text scores what a text of no words does;
    repeated rows score alike; without labels of both kinds every document scores their
    share (a half with none); an empty table gives no rows. No other column is read.
    """
    model = fit(docs, labels)
    return score(texts(docs), model).select(
        "doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", "predicted", "n_spans", "spans"
    )
