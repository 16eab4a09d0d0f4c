"""8. Packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lorespark.llm import kernels as K
from lorespark.llm.frames import cut, texts

WINDOW = 2048
PIECE = 512
GROUP_ROWS = 1024
END_ID = 1
_KEPT = 300_000

# What a byte can be in a word: a letter, a digit, a mark, or something that only the tokenizer itself can judge.
_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0x80:0xC0] = _CLASS[0xC3] = _LETTER  # with the lead byte C3, a Latin letter, but for two signs
_CLASS[[ord("'"), ord("<")]] = _ODD  # endings after an apostrophe; special tokens
_CLASS[K.SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_loaded: dict[int, "Pieces"] = {}

# A text by which a vocabulary shows whether its tokenizer parts words as ``parted`` does.
_PROBE = "Hello, WORLD 12345 don't it's (a_b-c) x9y É ñandú Öl ß × ÷ … 日本語 😀 <|startoftext|> mixed\u00a0space end.!? ##a  b\tc\nd"


def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends and oddness of the pieces of all texts; and each text's first piece.

    The tokenizer parts text into runs of letters, single digits and runs of marks,
    after lower-casing. A blank-separated word with any other byte is one odd piece.
    """
    starts, ends, bounds = K.word_bounds(data, offsets)
    kind = _CLASS[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    kind[after & ((data == 0x97) | (data == 0xB7))] = _ODD
    odd_sum = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind == _ODD, out=odd_sum[1:])
    odd = odd_sum[ends] > odd_sum[starts]
    low = _LOWER[data]
    low[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    begins = np.zeros(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begins[kind == 0] = False
    in_odd = np.zeros(len(data) + 1, np.int8)
    np.add.at(in_odd, starts[odd], 1)
    np.add.at(in_odd, ends[odd], -1)
    inside = np.cumsum(in_odd[:-1], dtype=np.int8).view(bool)
    begins[inside] = False
    begins[starts] = True
    low = np.where(inside, data, low)
    at = np.flatnonzero(begins)
    word = np.searchsorted(starts, at, "right") - 1
    last = np.append(word[1:] != word[:-1], True)[:len(at)]
    stop = np.where(last, ends[word], np.append(at[1:], 0)[:len(at)]) if len(at) else at
    return low, at, stop, odd[word], np.searchsorted(at, np.append(starts, len(data))[np.minimum(bounds, len(starts))])


class Pieces:
    """Ids of pieces, by hash, remembered up to a bound; new ones go to the tokenizer in one call.

    A tokenizer that does not part words as ``parted`` does (shown by a probe when it is
    loaded, or by ids that don't part) gets whole texts instead.
    """

    def __init__(self, tokenizer: object):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        self.bare = Tokenizer(tokenizer.model)  # the same model; pieces are lower-cased and parted already
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = np.uint16 if len(self.last) <= 1 << 16 else np.uint32
        self.whole = False
        self.clear()
        words = _PROBE.split()
        probe = [_PROBE, *words, *[w.upper() for w in words], ""]
        data, offsets = K.column_bytes(pa.array(probe))
        flat, bounds = self.token_ids(data, offsets)
        self.whole = self.whole or any(flat[bounds[k]:bounds[k + 1]].tolist() != tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(probe))
        self.clear()

    def clear(self) -> None:
        self.hashes, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        self.old, self.new, self.n_old = K.KeyTable(self.hashes), K.KeyTable(self.hashes), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = self.old.find(hashes).astype(np.int64)
        miss = np.flatnonzero(at < 0)
        young = self.new.find(hashes[miss])
        at[miss] = np.where(young >= 0, young + self.n_old, -1)
        return at

    def learn(self, hashes: np.ndarray, texts_: list[str], odd: np.ndarray) -> None:
        """Adds pieces; the last id of a plain piece has the word's end, so ids part by themselves."""
        plain = np.flatnonzero(~odd)
        ids = np.array(self.bare.encode_batch_fast([" ".join([texts_[i] for i in plain.tolist()])], add_special_tokens=False)[0].ids, dtype=np.int64)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(plain):
            self.whole = True
            return
        flat, sizes = [ids.astype(self.kind)], [np.diff(np.concatenate([[0], stops]))]
        for i in np.flatnonzero(odd).tolist():
            own = self.tokenizer.encode(texts_[i], add_special_tokens=False).ids
            flat.append(np.array(own, self.kind))
            sizes.append(np.array([len(own)]))
        self.hashes = np.concatenate([self.hashes, hashes[plain], hashes[odd]])
        self.sizes, self.flat = np.concatenate([self.sizes, *sizes]), np.concatenate([self.flat, *flat])
        if len(self.hashes) > 1.3 * self.n_old + 1000:
            self.old, self.n_old = K.KeyTable(self.hashes), len(self.hashes)
        self.new = K.KeyTable(self.hashes[self.n_old:])
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def token_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's bounds; without end ids."""
        if self.whole:
            return self._encoded(data, offsets)
        low, start, stop, odd, bounds = parted(data, offsets)
        if not len(start):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        hashes = K.word_hashes(low, start, stop) ^ odd.astype(np.uint64)
        at = self.find(hashes)
        if (at < 0).any():
            if len(self.hashes) > _KEPT:
                self.clear()
                at[:] = -1
            miss = np.flatnonzero(at < 0)
            fresh, first = np.unique(hashes[miss], return_index=True)
            first = miss[first]
            raw = low.tobytes()
            self.learn(fresh, [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)], odd[first])
            if self.whole:
                return self._encoded(data, offsets)
            at[miss] = self.find(hashes[miss])
        size = self.sizes[at]
        run = np.cumsum(size)
        ids = self.flat[np.repeat(self.offsets[at] - run + size, size) + np.arange(int(run[-1]))]
        return ids, np.concatenate([[0], run])[bounds]


    def _encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts_ = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        made = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]
        return np.concatenate([*made, np.zeros(0, self.kind)]), np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int64)


def cuts(n: int, window: int = WINDOW, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length): whole windows, then pieces of the rest."""
    full = n - n % window
    out = [(at, window) for at in range(0, full, window)]
    return out + [(at, min(piece, n - at)) for at in range(full, n, piece)]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, piece: int = PIECE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and the ids where asked for.

    A null or empty text has the end id alone. Repeated rows give repeated pieces. Ids have
    two bytes each where the vocabulary has no more than 65,536, else four.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary file, whatever the data

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known = zlib.crc32(shared.value.encode())
        if known not in _loaded:
            _loaded.clear()
            _loaded[known] = Pieces(Tokenizer.from_str(shared.value))
        pieces = _loaded[known]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        types = [pa.int64()] * 5 + [pa.binary()]
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            for lo, hi, d, o in K.slices(data, offsets):
                rows: list[tuple] = []
                flat, bounds = pieces.token_ids(d, o)
                for k, doc_id in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    ids = np.append(flat[bounds[k]:bounds[k + 1]], pieces.kind(END_ID))
                    raw_ids = ids.astype("<u4")
                    for start, length in cuts(len(ids), window, piece):
                        own = ids[start:start + length].tobytes() if with_ids else None
                        rows.append((doc_id, start, length, zlib.crc32(raw_ids[start:start + length].tobytes()), len(ids), own))
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays(made[:5 + with_ids], names=names[:5 + with_ids])
        K.release()

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return texts(docs).mapInArrow(cut_up, fields)


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """Multiway differencing: the window of each length, with sums kept near equal.

    Every partial partition is a list of sums, largest first (zeros left out), with the
    items behind each. The two partitions with the largest spread are merged, the
    largest sums of one with the smallest of the other, until one is left.
    """
    import heapq

    n = len(lengths)
    heap = [(-int(x), i, [(int(x), [i])]) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = len(a) + len(b) - windows
        if both <= 0:
            merged = a + b
        else:
            keep = len(a) - both
            merged = a[:keep] + b[:len(b) - both]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[keep:], reversed(b[len(b) - both:]), strict=True)]
        merged.sort(key=lambda s: -s[0])
        low = merged[-1][0] if len(merged) == windows else 0
        if low:
            # a common part of all sums does not change the spread
            heapq.heappush(heap, (-(merged[0][0] - low), tick, merged))
        else:
            heapq.heappush(heap, (-merged[0][0], tick, merged))
        tick += 1
    out = np.zeros(n, dtype=np.int64)
    for w, (_, items) in enumerate(heap[0][2] if heap else []):
        out[items] = w
    return out


def fill(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Windows for these lengths; their number rises until none is over capacity."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    count = max(1, -(-int(lengths.sum()) // window))
    while True:
        at = difference(lengths, count)
        most = int(np.bincount(at, weights=lengths).max())
        if most <= window:
            return at
        count += max(1, (most - window) * count // (4 * window))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, piece: int = PIECE, group_rows: int = GROUP_ROWS, with_ids: bool = False) -> DataFrame:
    """Packs documents into sequences of at most ``window`` tokens.

    A document gives whole windows, which are sequences of their own, and pieces of
    at most ``piece`` tokens. All pieces are dealt evenly into groups of about
    ``group_rows`` by their place in the checkpointed table, so copies or one long
    document can't fill a group; each group is partitioned by differencing.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).
    A null id is carried; a null or empty text is a piece of the end id alone; repeated rows
    are packed each; no other column is read. An empty table gives no sequence. ``ids``
    are little-endian unsigned 32-bit numbers.
    """
    pieces = cut(tokenized_pieces(docs, tokenizer_path, window, piece, with_ids))
    total = pieces.count()
    groups = max(1, -(-total // group_rows))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")

    def one(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = t["length"].to_numpy()
        whole = int((length >= window).sum())
        at = np.concatenate([np.arange(whole), whole + fill(length[whole:], window)])
        order = np.argsort(at, kind="stable")
        run = np.cumsum(length[order]) - length[order]
        first = np.concatenate(([True], np.diff(at[order]) != 0))
        offset = np.empty(len(at), np.int64)
        offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
        t = t.drop_columns(["_group"])
        if with_ids:
            held, size = t["ids"].combine_chunks(), int(length.sum())
            raw = b"".join(held.to_pylist())
            flat = np.frombuffer(raw, "<u2" if len(raw) == 2 * size else "<u4").astype("<u4")
            bounds = pa.py_buffer(np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32).tobytes())
            t = t.set_column(t.schema.get_field_index("ids"), "ids", pa.Array.from_buffers(pa.binary(), len(t), [None, bounds, pa.py_buffer(flat.tobytes())]))
        return t.append_column("sequence_id", pa.array(key[0].as_py() * (1 << 20) + at, pa.int64())).append_column("offset", pa.array(offset))

    fields = [*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]
    return pieces.withColumn("_group", dealt).groupBy("_group").applyInArrow(one, StructType(fields))
