"""5. Substring dedup by suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import kernels as K
from lorespark.llm.frames import cut, plain, texts, unused

WORDS = 50
GRAM = 10
HOT_ROWS = 1024
WIDTHS = (16, 4, 1)


class Automaton:
    """A suffix automaton of several word sequences, each with the id of its document.

    Every state knows the least id of a document in which its words stand.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [2**63 - 1]

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.least.append(2**63 - 1)
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.least[clone] = self.least[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], doc_id: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word, -1)
            if q >= 0:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
            else:
                new = self._state(self.size[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
                last = new
            self.least[last] = min(self.least[last], doc_id)

    def finish(self) -> None:
        """The least ids go down the suffix links: a suffix stands wherever the longer words stand."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[s]
            if up > 0 and self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def first_documents(self, words: list[int], length: int) -> list[int]:
        """By matching statistics: for each window of ``length`` words, the least id of a document with it."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if i + 1 >= length:
                s = state
                while s > 0 and self.size[self.link[s]] >= length:
                    s = self.link[s]
                out.append(self.least[s] if matched >= length else 2**63 - 1)
        return out


def _minimizer_runs(words: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one minimizer: document, minimizer, hash of all its words, first window (from the document's start), windows.

    A window's minimizer is the least hash of its runs of ``gram`` words, so equal
    windows have equal minimizers wherever they stand.
    """
    reach = length - gram + 1
    least = K.run_hashes(words, gram)
    n = len(words) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    span = 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[reach - span:reach - span + n])
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    ok = np.arange(n) + length <= bounds[doc + 1]
    at = np.flatnonzero(ok)
    doc, least = doc[at], least[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    first, n = at[heads], np.diff(np.append(heads, len(at)))
    return doc[heads], least[heads], K.span_hashes(words, first, first + n + length - 1), first - bounds[doc[heads]], n


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = K.column_bytes(column)
    for lo, hi, d, o in K.slices(data, offsets):
        starts, ends, bounds = K.word_bounds(d, o)
        yield lo, hi, d, starts, ends, bounds, K.word_hashes(d, starts, ends)


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts with a second key, so that rows which share an id but not a text stay apart."""
    return texts(docs).withColumn("text_key", F.coalesce(F.xxhash64("text"), F.lit(0)))


def _runs(keyed: DataFrame, length: int, gram: int, keys: np.ndarray | None = None) -> DataFrame:
    """One row for each different run of a document, with all places (``firsts``) where it begins.

    With ``keys``, only the runs of these shards, each with its words (as hashes).
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _, _, bounds, words in _words(batch.column(1)):
                doc, least, content, first, n = _minimizer_runs(words, bounds, length, gram)
                if keys is not None:
                    doc, least, content, first, n = (x[np.isin(K.signed(least), keys)] for x in (doc, least, content, first, n))
                order = np.lexsort((first, content, least, doc))
                doc, least, content, first, n = (x[order] for x in (doc, least, content, first, n))
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (content[1:] != content[:-1]) | (least[1:] != least[:-1])
                heads = np.flatnonzero(new)
                firsts = pa.ListArray.from_arrays(pa.array(np.append(heads, len(doc)).astype(np.int32)), pa.array(first.astype(np.int32)))
                part, at = batch.slice(lo, hi - lo), pa.array(doc[heads])
                columns = [pa.array(K.signed(least[heads])), pa.array(K.signed(content[heads])), part.column(0).take(at), part.column(2).take(at), firsts, pa.array(n[heads].astype(np.int32))]
                names = ["key", "content_key", "doc_id", "text_key", "firsts", "n"]
                if keys is not None:
                    begin = bounds[doc[heads]] + first[heads]
                    held = [words[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + n[heads] + length - 1).tolist(), strict=True)]
                    columns, names = [*columns, pa.array(held, pa.binary())], [*names, "content"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        K.release()

    return keyed.mapInArrow(emit, _RUN if keys is None else f"{_RUN}, content binary")


def _dealt(runs: DataFrame, hot_rows: int) -> DataFrame:
    """The runs that another document may have words of: whether a smaller document has their very words (whole), and whether more than ``hot_rows`` different ones have their key (hot)."""
    contents = runs.groupBy("key", "content_key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shards = contents.groupBy("key").agg(F.count("*").alias("kinds"), F.min("low").alias("first_low"), F.max("high").alias("last_high"))
    shards = shards.where("first_low < last_high").select("key", "kinds")
    followed = runs.join(contents.join(shards, "key").select("key", "content_key", "low", "kinds"), ["key", "content_key"]).where("low < doc_id or kinds > 1")
    return followed.withColumns({"whole": F.col("low") < F.col("doc_id"), "hot": F.col("kinds") > hot_rows}).drop("content_key", "low", "kinds")


_RUN = "key long, content_key long, doc_id long, text_key long, firsts array<int>, n int"
_CONTENT = "key long, doc_id long, text_key long, firsts array<int>, content binary"
_REMOVED = "doc_id long, text_key long, first int, stop int"


def _whole_spans(followed: DataFrame, length: int) -> DataFrame:
    copies = followed.where("whole").select("doc_id", "text_key", "n", F.explode("firsts").alias("first"))
    return copies.select("doc_id", "text_key", "first", (F.col("first") + F.col("n") + (length - 1)).cast("int").alias("stop"))


def _contents(wanted: DataFrame, length: int) -> DataFrame:
    """The words (as hashes) of every wanted run."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for lo, hi, _, _, _, bounds, words in _words(batch.column(names.index("text"))):
                part = batch.slice(lo, hi - lo)
                ids, keys = (part.column(names.index(c)).to_pylist() for c in ("doc_id", "text_key"))
                runs = part.column(names.index("runs")).to_pylist()
                rows: list[tuple] = []
                for i in range(hi - lo):
                    own = words[bounds[i]:bounds[i + 1]]
                    for run in runs[i]:
                        firsts, n = run["firsts"], run["n"]
                        rows.append((run["key"], ids[i], keys[i], firsts, own[firsts[0]:firsts[0] + n + length - 1].tobytes()))
                    if len(rows) > 20_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)
        K.release()

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "doc_id", "text_key", "firsts", "content"])

    return wanted.mapInArrow(emit, _CONTENT)


def _parts(words: np.ndarray, length: int, gram: int, width: int) -> tuple[np.ndarray, ...]:
    """A run of one minimizer in parts: key, hash of all its words, first window, windows.

    The minimizer's first place in a window is one of length - gram + 1. Windows of a part
    have it in one place of the run, and in places of the window that lie in one range of
    ``width``; the key is the hash of the words that every window of that range has around it.
    So equal windows have equal keys, and a part of one window has all its words as its key.
    """
    reach, n = length - gram + 1, len(words) - length + 1
    hashes = K.run_hashes(words, gram)
    at, window = np.flatnonzero(hashes == hashes[:reach].min()), np.arange(n)
    place = at[np.searchsorted(at, window)]
    low = (place - window) // width * width
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (low[1:] != low[:-1])
    heads = np.flatnonzero(new)
    place, low, n = place[heads], low[heads], np.diff(np.append(heads, n))
    shared = K.span_hashes(words, place - low, place + gram + reach - np.minimum(low + width, reach))
    key = K.mix(shared + K.mix((low * (length + 1) + width).astype(np.uint64)))
    return key, K.span_hashes(words, heads, heads + n + length - 1), heads, n


def _narrowed(hot: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """Every different part of a run, with its places and its words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text_key, firsts, content in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "firsts", "content")), strict=True):
                key, own, heads, n = _parts(np.frombuffer(content, np.uint64), length, gram, width)
                places: dict[int, list[int]] = {}
                for i, k in enumerate(own.tolist()):
                    places.setdefault(k, []).append(i)
                key, own, heads, n = K.signed(key).tolist(), K.signed(own).tolist(), heads.tolist(), n.tolist()
                for same in places.values():
                    i = same[0]
                    rows.append((key[i], own[i], doc_id, text_key, [f + heads[k] for f in firsts for k in same], n[i], content[8 * heads[i]:8 * (heads[i] + n[i] + length - 1)]))
                if len(rows) > 5_000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)
        K.release()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "content_key", "doc_id", "text_key", "firsts", "n", "content"])

    return hot.select("doc_id", "text_key", "firsts", "content").mapInArrow(emit, f"{_RUN}, content binary")


def _removed_in_group(rows: list[tuple[int, int, list[int], bytes]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, text_key, first word, stop) of what one shard's automaton removes from the runs that were sent to it."""
    least: dict[bytes, int] = {}
    for doc_id, _, _, content in rows:
        least[content] = min(doc_id, least.get(content, doc_id))
    if len(least) == 1:
        where = {next(iter(least)): None}  # one passage: its automaton would match it whole
    else:
        shard = Automaton()
        lists = {c: np.frombuffer(c, np.uint64).tolist() for c in least}
        for content, doc_id in sorted(least.items(), key=lambda x: (x[1], x[0])):
            shard.add(lists[content], doc_id)
        shard.finish()
        where = {c: np.array(shard.first_documents(w, length)) for c, w in lists.items()}
    for doc_id, text_key, firsts, content in rows:
        n = len(content) // 8 - length + 1
        found = where[content]
        if found is None:
            if least[content] < doc_id:
                for first in firsts:
                    yield doc_id, text_key, first, first + n + length - 1
            continue
        hit = np.flatnonzero(found < doc_id)
        if len(hit):
            breaks = np.flatnonzero(np.diff(hit) > 1)
            for a, b in zip(np.append(hit[0], hit[breaks + 1]).tolist(), np.append(hit[breaks], hit[-1]).tolist(), strict=True):
                for first in firsts:
                    yield doc_id, text_key, first + a, first + b + length


def _match_shards(contents: DataFrame, length: int) -> DataFrame:
    """Streams the runs, sorted by shard key, through the automaton of each shard."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, out = None, []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    out += _removed_in_group(held, length) if len(held) > 1 else []
                    held, key = [], k
                held.append(tuple(row))
            if len(out) > 5_000:
                yield made(out)
                out = []
        out += _removed_in_group(held, length) if len(held) > 1 else []
        if out:
            yield made(out)
        del held, out
        K.release()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "text_key", "first", "stop"])

    return contents.repartition("key").sortWithinPartitions("key").mapInArrow(emit, _REMOVED)


def _judged(docs: DataFrame) -> DataFrame:
    return _keyed(docs).where("doc_id is not null and text is not null")


def repeated_spans(docs: DataFrame, length: int = WORDS, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, text_key and word ranges that a window of a document with a smaller id covers.

    Windows are dealt into reference shards by their minimizer: consecutive windows
    with one minimizer travel as one run, and two equal windows always meet. A run
    whose very words stand in a document with a smaller id goes whole, by a
    pre-aggregated minimum; so of any number of copies one run is left to compare.
    Where a shard is left with several different runs, their words make a suffix
    automaton whose states know the least document; streaming the runs through it
    gives the matching statistics, and windows matched in full by a smaller document
    are removed. However often a document repeats a run, the run travels once, with its
    places, so a shard has one row for each of its different runs. A shard of more than
    ``hot_rows`` of them (the edges of a passage of very many documents) is not gathered
    in one task: its runs are dealt anew in parts, by more of the words around the minimizer.
    Parts whose words stand in a smaller document go whole again, those that no other document
    shares are left alone, and only the parts that are still hot are cut up further, at last to
    single windows with all their words as key. The driver reads the keys of the hot shards, of
    which there are at most one for ``hot_rows`` runs.
    """
    keyed = _judged(docs)
    followed = cut(_dealt(_runs(keyed, length, gram), hot_rows).select("key", "doc_id", "text_key", "firsts", "n", "whole", "hot"))
    spans = _whole_spans(followed, length)
    own = followed.where("not whole and not hot").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("key", "firsts", "n")).alias("runs"))
    contents = _contents(keyed.join(own, ["doc_id", "text_key"]), length)
    hot = followed.where("not whole and hot").select("key", "doc_id", "text_key", F.col("firsts")[0].alias("at")).distinct()
    keys = np.array([r["key"] for r in hot.select("key").distinct().collect()], np.int64)
    if len(keys):
        named = _runs(keyed, length, gram, keys).withColumn("at", F.col("firsts")[0])
        hot = cut(named.join(hot, ["key", "doc_id", "text_key", "at"], "left_semi").select("doc_id", "text_key", "firsts", "content"))
        for width in WIDTHS:
            parts = cut(_dealt(_narrowed(hot, length, gram, width), hot_rows))
            spans = spans.union(_whole_spans(parts, length))
            contents = contents.union(parts.where("not whole and not hot").select("key", "doc_id", "text_key", "firsts", "content"))
            hot = parts.where("not whole and hot")
            if hot.limit(1).count() == 0:
                break
    return spans.union(_match_shards(contents, length))


def remove_repeats(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words, joined by blanks; null for a null text) of every row.

    Windows are judged on the input. A text of fewer than 50 words, a null or an empty
    one loses nothing; a row with a null id loses nothing and is no reference. Rows
    that share an id never remove each other's words; repeated rows give equal rows.
    """
    spans = repeated_spans(docs, length).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    joined = _judged(docs).join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    others = _keyed(docs).where("doc_id is null or text is null").select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans"))
    joined = joined.union(others)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, d, starts, ends, bounds, _ in _words(batch.column(1)):
                raw = d.tobytes()
                spans_ = batch.column(2).slice(lo, hi - lo).to_pylist()
                null = batch.column(1).slice(lo, hi - lo).is_null().to_pylist()
                n_removed, digest, kept = [], [], []
                for i, own in enumerate(spans_):
                    s, e = starts[bounds[i]:bounds[i + 1]].tolist(), ends[bounds[i]:bounds[i + 1]].tolist()
                    gone = np.zeros(len(s) + 1, np.int32)
                    for span in own or []:
                        gone[span["first"]] += 1
                        gone[span["stop"]] -= 1
                    if own:
                        left = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
                        s, e = [s[k] for k in left], [e[k] for k in left]
                    text = b" ".join([raw[a:b] for a, b in zip(s, e, strict=True)])
                    n_removed.append(int(bounds[i + 1] - bounds[i]) - len(s))
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(None if null[i] else text.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds).astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )
        K.release()

    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def without_repeats(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """The documents with their repeated spans taken out of ``text``; one of which nothing is left goes.

    A text that loses nothing stays as it is, to the byte; n_chars, where there is such a
    column, follows a changed text. Nulls, empty and short texts and rows with a null id
    stay; repeated rows lose alike; other columns, of any name, are carried; an empty
    table stays empty.
    """
    named, docs = docs.columns, plain(docs, "doc_id", "text", "n_chars")
    own_id, own_key, own_spans = unused(docs, "_id", "_key", "_spans")
    spans = repeated_spans(docs, length).groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).agg(F.collect_set(F.struct("first", "stop")).alias(own_spans))
    key = F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))
    joined = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_key: key}).join(spans, [own_id, own_key], "left")
    text, same = _kept_text()(F.col("text"), F.col(own_spans)), F.col(own_spans).isNull()
    out = joined.withColumn("text", F.when(same, F.col("text")).otherwise(text)).where(same | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(size))
    return out.select(*docs.columns).toDF(*named)


def _kept_text() -> object:
    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            if own is None or t is None:
                out.append(t)
                continue
            raw = t.encode()
            d, o = np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64)
            starts, ends, _ = K.word_bounds(d, o)
            gone = np.zeros(len(starts) + 1, np.int32)
            for span in own:
                gone[span["first"]] += 1
                gone[span["stop"]] -= 1
            out.append(b" ".join([raw[starts[k]:ends[k]] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]).decode())
        return pd.Series(out, dtype=object)

    return kept
