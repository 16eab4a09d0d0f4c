"""9. Benchmark decontamination by q-gram lemma filtering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import kernels as K
from lorespark.llm.frames import plain, small_batches, texts

Q = 12
WINDOW = 64
STRIDE = 8
EDITS = 0.05
BLOCK_CHARS = 2 << 20
FILTER_BITS = 22
BLANK = 32


@cache
def _fold_table() -> np.ndarray:
    """Lower case of each character that has one of a single character; white space is a blank."""
    made = np.arange(1 << 17, dtype=np.uint32)
    for c in range(1 << 17):
        low = chr(c).lower()
        if chr(c).isspace():
            made[c] = BLANK
        elif len(low) == 1:
            made[c] = ord(low)
    return made


def code_points(texts_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, their offsets, and where each stands among all characters.

    Case is folded by Unicode, white space becomes blanks, and of a run of blanks one is left.
    """
    joined = np.frombuffer("".join(texts_).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts_])]).astype(np.int64)
    table = _fold_table()
    folded = np.where(joined < len(table), table[np.minimum(joined, len(table) - 1)], joined)
    again = np.zeros(len(folded), bool)
    again[1:] = (folded[1:] == BLANK) & (folded[:-1] == BLANK)
    inner = offsets[:-1][offsets[:-1] < len(folded)]
    again[inner] = False
    where = np.flatnonzero(~again)
    return folded[where], np.searchsorted(where, offsets), where


def qgram_hashes(chars: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 12 characters from each place on, from runs of 4 and 8."""
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    c = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (c[1:] ^ (c[1:] >> np.uint64(31)))
    four = two[:-2] * np.uint64(0x165667B19E3779F9) + (two[2:] ^ (two[2:] >> np.uint64(29)))
    eight = four[:-4] * np.uint64(0x27D4EB2F165667C5) + (four[4:] ^ (four[4:] >> np.uint64(32)))
    n = len(chars) - Q + 1
    h = eight[:n] * np.uint64(0x85EBCA77C2B2AE63) + (four[8:8 + n] ^ (four[8:8 + n] >> np.uint64(30)))
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    """Of one block of the benchmark: windows of its items, and where each q-gram stands in the items."""

    ids: list[int | None]  # distinct item ids
    chars: np.ndarray  # of all items
    item: np.ndarray  # of each window: place of its item's id
    start: np.ndarray  # of each window in the characters
    size: np.ndarray
    edits: np.ndarray  # budget
    least: np.ndarray  # q-grams that a region within budget shares at least
    grams: np.ndarray  # distinct hashes
    bounds: np.ndarray  # of each hash's places
    place: np.ndarray
    first: np.ndarray  # of each place: the first window that holds its q-gram whole,
    windows: np.ndarray  # and how many do
    short: dict[str, list[int]]  # items of less than one q-gram: their folded text


def index(items: list[tuple[int | None, str]], window: int = WINDOW, stride: int = STRIDE, edits: float = EDITS) -> Index:
    ids = sorted({i for i, _ in items}, key=lambda i: (i is None, i or 0))
    at_id = {i: k for k, i in enumerate(ids)}
    parts, item, start, size, short, total = [], [], [], [], {}, 0
    for item_id, text in items:
        chars, _, _ = code_points([text.strip()])
        if len(chars) < Q:
            if len(chars):
                short.setdefault("".join(map(chr, chars.tolist())), []).append(at_id[item_id])
            continue
        starts = list(range(0, max(1, len(chars) - window + 1), stride))
        if len(chars) > window and starts[-1] + window < len(chars):
            starts.append(len(chars) - window)
        item += [at_id[item_id]] * len(starts)
        start += [total + at for at in starts]
        size += [min(window, len(chars))] * len(starts)
        parts.append(chars)
        total += len(chars)
    start, size = np.array(start, np.int64), np.array(size, np.int64)
    chars = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    budget = np.minimum((size * edits).astype(np.int64), np.maximum((size + 1) // Q - 2, 0))
    stops = np.cumsum([len(p) for p in parts]).astype(np.int64)
    place = np.concatenate([np.arange(b - len(p), b - Q + 1) for p, b in zip(parts, stops.tolist(), strict=True)]) if parts else np.zeros(0, np.int64)
    owner = np.searchsorted(stops, place, "right")
    low, high = np.searchsorted(start, stops - [len(p) for p in parts]), np.searchsorted(start, stops)
    width = size[low[owner]] if parts else place
    first = np.maximum(np.searchsorted(start, place + Q - width), low[owner]) if parts else place
    last = np.minimum(np.searchsorted(start, place, "right"), high[owner]) if parts else place
    hashes = qgram_hashes(chars)[place]
    order = np.argsort(hashes, kind="stable")
    grams, n = K.counted(hashes)
    return Index(
        ids, chars, np.array(item, np.int64), start, size, budget, size + 1 - Q * (budget + 1), grams, np.concatenate([[0], np.cumsum(n)]).astype(np.int64),
        place[order].astype(np.int32), first[order].astype(np.int32), (last - first)[order].astype(np.int32), short,
    )


class Finder:
    def __init__(self, index: Index):
        self.i = index
        self.table = K.KeyTable(index.grams)
        self.weight = np.diff(np.concatenate([[0], np.cumsum(index.windows, dtype=np.int64)])[index.bounds])
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(index.grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, texts_: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, place of the item id): least distance, and the start and end of the best region in characters."""
        chars, offsets, where = code_points(texts_)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d in np.flatnonzero(np.diff(offsets) < Q + 2).tolist() if self.i.short else ():
            whole = "".join(map(chr, chars[offsets[d]:offsets[d + 1]].tolist())).strip()
            for t in self.i.short.get(whole, ()):
                found[d, t] = (0, 0, int(offsets[d + 1] - offsets[d]))
        self._search(chars, offsets, found)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts_])])
        out = {}
        for (d, t), (distance, start, stop) in found.items():
            a, b = offsets[d] + start, offsets[d] + stop
            out[d, t] = distance, int(where[a] - begin[d]), int(where[b - 1] + 1 - begin[d])
        return out

    def _search(self, chars: np.ndarray, offsets: np.ndarray, found: dict) -> None:
        i = self.i
        hashes = qgram_hashes(chars)
        if not len(hashes) or not len(i.grams):
            return
        pos = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = self.table.find(hashes[pos])
        pos, at = pos[at >= 0], at[at >= 0]
        doc = np.searchsorted(offsets, pos, "right") - 1
        inside = pos + Q <= offsets[doc + 1]
        pos, at, doc = pos[inside], at[inside], doc[inside]
        # a text of mostly common q-grams could meet many places at once: by blocks of hits
        ends = np.cumsum(self.weight[at])
        lo = 0
        while lo < len(pos):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_000_000, "right")))
            if hi < len(pos):  # whole documents, so that no band is parted
                first = int(np.searchsorted(doc, doc[hi]))
                hi = first if first > lo else int(np.searchsorted(doc, doc[hi], "right"))
            self._bands(chars, offsets, pos[lo:hi], at[lo:hi], found)
            lo = hi

    def _bands(self, chars: np.ndarray, offsets: np.ndarray, pos: np.ndarray, at: np.ndarray, found: dict) -> None:
        i = self.i
        n = i.bounds[at + 1] - i.bounds[at]
        entry = np.repeat(i.bounds[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        diagonal = np.repeat(pos, n) - i.place[entry]  # where the items' characters would begin in the text
        n = i.windows[entry].astype(np.int64)
        window = np.repeat(i.first[entry] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        diagonal = np.repeat(diagonal, n) + i.start[window] + WINDOW  # where the window would; not below 0
        step = i.edits[window] + 1
        band = diagonal // step
        # two neighbouring steps make one band, so bands overlap by a step and any e + 1 diagonals lie within one
        keys = np.concatenate([window << 40 | band + 1, window << 40 | band])
        # a q-gram that stands at several places of one diagonal counts for each; the lemma's count is of places
        key, count = K.counted(keys)
        window = key >> 40
        good = count >= i.least[window]
        window, band = window[good], (key[good] & ((1 << 40) - 1)) - 1
        size, edits = i.size[window], i.edits[window]
        low = band * (edits + 1) - WINDOW  # the lower of the band's diagonals
        middle = np.clip(low + size // 2, 0, len(chars) - 1)
        doc = np.searchsorted(offsets, middle, "right") - 1
        for s, e in {*zip(size.tolist(), edits.tolist(), strict=True)}:
            mine = np.flatnonzero((size == s) & (edits == e))
            for part in np.array_split(mine, -(-len(mine) // 2000)):
                distance, end = self._align(chars, offsets, window[part], doc[part], low[part], s, e)
                for k in np.flatnonzero(distance <= e):
                    d = int(doc[part[k]])
                    stop = int(min(end[k], offsets[d + 1]) - offsets[d])
                    made = (int(distance[k]), max(0, stop - s), stop)
                    where = (d, int(i.item[window[part[k]]]))
                    found[where] = min(found.get(where, made), made)

    def _align(self, chars: np.ndarray, offsets: np.ndarray, window: np.ndarray, doc: np.ndarray, low: np.ndarray, size: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Edit distance of each window to the best region that begins near the band's diagonals."""
        width = 2 * (e + 1) + 2 * e
        first = low - e
        columns = first[:, None] + np.arange(size + width)
        ok = (columns >= offsets[doc][:, None]) & (columns < offsets[doc + 1][:, None])
        text = np.where(ok, chars[np.clip(columns, 0, len(chars) - 1)], 0)
        want = self.i.chars[self.i.start[window][:, None] + np.arange(size)]
        slope = np.arange(width)
        d = np.zeros((len(window), width), np.int32)
        for r in range(size):
            best = d + (text[:, r:r + width] != want[:, r:r + 1])
            best[:, :-1] = np.minimum(best[:, :-1], d[:, 1:] + 1)
            d = np.minimum.accumulate(best - slope, axis=1) + slope
        c = d.argmin(axis=1)
        return d[np.arange(len(d)), c], first + size + c


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[Broadcast]:
    """Indexes of the benchmark's distinct items, sent to the tasks in blocks of about ``block_chars`` characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.char_length("text") > 0).distinct()
    total = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) * 5 // (4 * block_chars))) if total > block_chars else 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about block_chars characters
        ordered = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(index(ordered))


def _slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The column's texts (nulls: empty) in order, some ``limit`` characters at a time, each part with its first row."""
    held, size, first = [], 0, 0
    for k, text in enumerate(column):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= limit:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every (row, item) whose text holds a window of the item within its edit budget.

    Texts and items are compared by folded characters: Unicode case, and each run of
    white space as one blank. An item has a window of 64 characters at every eighth
    place and at its end (a shorter item is one window), so any quote of 71 characters
    or more holds a whole window; a window's budget is 5 % of its length, less where the
    lemma's count would not be positive. An item of fewer than 12 characters has no
    q-gram; it matches the texts that are equal to it. Null and empty items match nothing,
    and neither do null texts; a repeated item is searched once. Returns doc_id and
    item_id (nulls are carried), distance, start and end (characters), one row for each
    row of docs and item id; an empty table on either side gives no row.

    The benchmark goes to the tasks in blocks of ``block_chars`` characters, each
    searched by a pass over the documents, so what is sent has a bound at any size.
    """
    source = texts(docs).where("text is not null")
    found = []
    for shared in _blocks(benchmark, block_chars):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = None
            for batch in batches:
                finder = finder or Finder(shared.value)
                for first, held in _slices(batch.column(1)):
                    own = batch.column(0).slice(first, len(held)).to_pylist()
                    rows = [(own[d], finder.i.ids[t], *best) for (d, t), best in sorted(finder.find(held).items())]
                    columns = zip(*rows, strict=True) if rows else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "start", "end"])
            K.release()

        found.append(source.mapInArrow(search, "doc_id long, item_id long, distance long, start long, end long"))
    return reduce(DataFrame.unionAll, found)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows that hold no passage of the benchmark, as find_leaks finds them; each row is judged by its own text.

    So a row with a null id goes if it holds a passage, and one with a null text stays.
    Repeated rows go or stay together; other columns, of any name, are carried as they are;
    without documents or without a benchmark the table stays as it is.
    """
    text_at, named, docs = docs.columns.index("text"), docs.columns, plain(docs)
    for shared in _blocks(benchmark, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = None
            for batch in batches:
                finder = finder or Finder(shared.value)
                clean = np.ones(batch.num_rows, bool)
                for first, held in _slices(batch.column(text_at)):
                    clean[[first + d for d, _ in finder.find(held)]] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))
            K.release()

        docs = small_batches(docs).mapInArrow(keep, docs.schema)
    return docs.toDF(*named)
