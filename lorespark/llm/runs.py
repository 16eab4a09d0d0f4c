"""13. Periodic run detection by the runs theorem."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import kernels as K
from lorespark.llm.frames import texts

LEAST = 6
EXPONENT = 4
_UNKNOWN = np.iinfo(np.int32).max
_PIECE = 1 << 16


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo..hi]) of each query, by a sparse table of which one level is held at a time.

    Level k has the minima of 2 ** k consecutive values; a query is the smaller of the two
    entries that cover it, at the level of its length.
    """
    out = np.zeros(len(lo), values.dtype)
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    order = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[order], np.arange(level.max() + 2 if len(level) else 1))
    table = values
    for k in range(len(ends) - 1):
        if k:
            table = np.minimum(table[: len(table) - (1 << (k - 1))], table[1 << (k - 1):])
        mine = order[ends[k]:ends[k + 1]]
        out[mine] = np.minimum(table[lo[mine]], table[hi[mine] - (1 << k) + 1])
    return out


@dataclass
class Suffixes:
    """Inverse suffix array and LCP array (lcp[r]: of the suffixes of ranks r-1 and r)."""

    rank: np.ndarray
    lcp: np.ndarray

    @staticmethod
    def of(symbols: np.ndarray) -> Suffixes:
        """By prefix doubling; only suffixes that are not alone with their prefix are sorted on.

        Every text must end in a symbol of its own that is smaller than all words. Where two
        neighbours part at depth h, their LCP is h and that of what follows: a range minimum over the
        LCPs already found.
        """
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        first = np.concatenate(([True], symbols[order][1:] != symbols[order][:-1]))
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = start
        lcp = np.where(first, 0, _UNKNOWN).astype(np.int32)
        single = first & np.append(first[1:], True)
        left = order[~single]
        h = 1
        while len(left):
            after = rank[left + h]
            now = np.argsort(rank[left] * n + after, kind="stable")
            left, after = left[now], after[now]
            group = rank[left]
            new_group = np.concatenate(([True], group[1:] != group[:-1]))
            parts = new_group | np.concatenate(([True], after[1:] != after[:-1]))
            at = group + np.arange(len(left)) - np.maximum.accumulate(np.where(new_group, np.arange(len(left)), 0))  # places in the suffix array
            fresh = np.flatnonzero(parts & ~new_group)
            found = range_minima(lcp, after[fresh - 1] + 1, after[fresh]) + h
            rank[left] = at[np.maximum.accumulate(np.where(parts, np.arange(len(left)), 0))]
            lcp[at[fresh]] = found
            left = left[~(parts & np.append(parts[1:], True))]
            h *= 2
        return Suffixes(rank, lcp)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b (a != b) have in common."""
        x, y = self.rank[a], self.rank[b]
        return range_minima(self.lcp, np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)


def next_smaller(values: np.ndarray) -> np.ndarray:
    """Of each place the next one with a smaller value, or the array's length: one pass from the right, over what each place has already passed."""
    n = len(values)
    held, following = array("q", values.astype(np.int64).tobytes()), array("q", bytes(8 * n))
    held.append(int(values.min()) - 1 if n else 0)
    for i in range(n - 1, -1, -1):
        own, j = held[i], i + 1
        while held[j] > own:
            j = following[j]
        following[i] = j
    return np.frombuffer(following, np.int64)


def runs(words: np.ndarray, bounds: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and smallest period of all runs with length >= max(least, exponent * period), by start, then period.

    ``words`` are the word numbers of several texts, one after the other; ``bounds`` has the
    first word of each text and the end. ``exponent`` is 2 or more.

    Each text gets an end mark, smaller than all words. A run's Lyndon roots, under the
    order of words or the reversed one, are longest Lyndon words: those from a place to
    the next suffix that is smaller under that order, which is the next smaller value of the
    inverse suffix array or of its negative. A root [i, i+p) is extended to the right by
    the LCP of suffixes i and i+p. A run of the given exponent has a root in its
    first p places, so that a right extension of at least (exponent - 2) * p + 1 follows; the leftmost root
    of each (end, period) is extended to the left, by fewer than p words, halving on LCPs.
    """
    sizes = np.diff(bounds)
    n_texts = len(sizes)
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none, none
    ends = bounds[1:] + np.arange(n_texts)  # where the end marks stand
    symbols = np.empty(len(words) + n_texts, np.int64)
    symbols[ends] = np.arange(n_texts)
    place = np.arange(len(words)) + np.repeat(np.arange(n_texts), sizes)
    symbols[place] = words + n_texts
    stop = np.repeat(ends, sizes + 1)
    begin = np.repeat(bounds[:-1] + np.arange(n_texts), sizes + 1)
    suffixes = Suffixes.of(symbols)
    reversed_order = -suffixes.rank
    reversed_order[ends] = -len(symbols)  # under the reversed order a text's end mark is passed by none
    roots = []
    for following in (next_smaller(suffixes.rank), next_smaller(reversed_order)):
        i = place
        j = np.minimum(following[i], stop[i])
        p = j - i
        fits = (exponent * p <= stop[i] - begin[i]) & ((symbols[i] == symbols[j]) | (i == begin[i]) | (symbols[i - 1] == symbols[j - 1]))
        if roots:
            fits &= j < stop[i]
        roots.append((i[fits], p[fits]))
    i, p = (np.concatenate(x) for x in zip(*roots, strict=True))
    same = symbols[i] == symbols[i + p]
    i, p = i[same], p[same]
    right = suffixes.common(i, i + p)
    good = right >= (exponent - 2) * p + 1
    i, p, right = i[good], p[good], right[good]
    end = i + p + right
    order = np.lexsort((i, p, end))
    i, p, end = i[order], p[order], end[order]
    first = np.concatenate(([True], (end[1:] != end[:-1]) | (p[1:] != p[:-1]))) if len(i) else np.zeros(0, bool)
    i, p, end = i[first], p[first], end[first]
    low, high = np.zeros(len(i), np.int64), np.minimum(p - 1, i - begin[i])  # the left extension lies between
    while (low < high).any():
        middle = (low + high + 1) // 2
        holds = low < high
        back = middle[holds]
        fits = suffixes.common(i[holds] - back, i[holds] + p[holds] - back) >= back
        low[holds] = np.where(fits, back, low[holds])
        high[holds] = np.where(fits, high[holds], back - 1)
    start = i - low
    length = end - start
    good = (length >= np.maximum(least, exponent * p))
    start, length, p = start[good], length[good], p[good]
    order = np.lexsort((p, start))
    start, length, p = start[order], length[order], p[order]
    text = np.searchsorted(ends, start)
    return text, start - begin[start], length, p


def sources(n: int, check: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a text whose id has this checksum; None if all are their own."""
    if check is None or check % 10 or n == 0:
        return None
    g = check // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def _digest(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> str:
    """sha256 of the chosen words, joined by one space, some thousand words at a time."""
    made = hashlib.sha256()
    for at in range(0, len(chosen), _PIECE):
        mine = chosen[at:at + _PIECE]
        words = [raw[a:b].tobytes() for a, b in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)] if len(mine) < 8 else _cut(raw, starts[mine], ends[mine])
        made.update((b" " if at else b"") + b" ".join(words))
    return made.hexdigest()


def _cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    lo, hi = int(starts.min()), int(ends.max())
    if hi - lo > 64 * _PIECE:
        return [raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    held = raw[lo:hi].tobytes()
    return [held[a:b] for a, b in zip((starts - lo).tolist(), (ends - lo).tolist(), strict=True)]


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words."""
    solid = data[~K.SPACE[data]]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _judged(data: np.ndarray, offsets: np.ndarray, checks: list[int | None]) -> list[tuple]:
    """n_runs, the greatest run's start, length, period and exponent, and both digests, of each text of a slice."""
    starts, ends, bounds = K.word_bounds(data, offsets)
    numbers = _numbers(data, starts, ends)
    raw = data.tobytes()
    seen: dict[object, int] = {}
    own, parts, placed = [], [], []
    for d, check in enumerate(checks):
        lo, hi = int(bounds[d]), int(bounds[d + 1])
        source = sources(hi - lo, check)
        key: object = d if source is not None else raw[offsets[d]:offsets[d + 1]]
        if key not in seen:  # equal texts are searched once
            seen[key] = len(parts)
            parts.append(numbers[lo:hi] if source is None else numbers[lo:hi][source])
            placed.append(np.arange(lo, hi) if source is None else source + lo)
        own.append(seen[key])
    limits = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    text, start, length, period = runs(np.concatenate(parts) if parts else np.zeros(0, np.int64), limits)
    cuts = np.searchsorted(text, np.arange(len(parts) + 1))
    rows = []
    for k, place in enumerate(placed):
        s, m, q = (x[cuts[k]:cuts[k + 1]] for x in (start, length, period))
        if len(s):
            gone = np.zeros(len(place) + 1, np.int64)
            np.add.at(gone, s + q, 1)
            np.add.at(gone, s + m, -1)
            place = place[np.cumsum(gone[:-1]) == 0]
            best = np.lexsort((q, s, -m))[0]
            top = (int(s[best]), int(m[best]), int(q[best]), int(1000 * m[best] // q[best]))
        else:
            top = (None,) * 4
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), m.tolist(), q.tolist(), strict=True))
        rows.append((len(s), *top, hashlib.sha256(listed.encode()).hexdigest(), _digest(data, starts, ends, place)))
    return [rows[k] for k in own]


FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = (*[pa.int64()] * 5, pa.string(), pa.string())


def periodic_runs(docs: DataFrame, planted: bool = True) -> DataFrame:
    """The runs of each text, of four periods and six words or more, and the text without their repeats.

    Returns doc_id, n_runs, the greatest run's start, length, period and exponent_milli
    (null without a run), the digest of all runs and that of the words that stay. With
    ``planted``, a tenth of the texts (by checksum of the id) is made periodic first.

    A null text has no words, as an empty one; a null id is carried and plants nothing;
    repeated rows give equal rows. Whole texts are searched, with memory in proportion to
    the longest text. Other columns aren't read. An empty table gives no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            checks = batch.column(2).to_pylist()
            for lo, hi, d, o in K.slices(data, offsets):
                rows = _judged(d, o, checks[lo:hi])
                made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *made], names=[f.split()[0] for f in FIELDS.split(", ")])
        K.release()

    check = F.crc32(F.col("doc_id").cast("string").cast("binary")) if planted else F.lit(None).cast("long")
    return texts(docs).select("doc_id", "text", check.alias("check")).mapInArrow(find, FIELDS)
