"""6. MinHash near-dedup by DartMinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lorespark.llm import kernels as K
from lorespark.llm.frames import cut, plain, texts, unused

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 3
ROUNDS = 4
BLOCK_BYTES = 4 << 20


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (48 bits), how often each stands in its text, and each text's bounds among them.

    A shingle is five consecutive words; a text of one to four words is one shingle.
    At most 65,535 texts a call.
    """
    starts, ends, bounds = K.word_bounds(data, offsets)
    words = K.word_hashes(data, starts, ends)
    n = np.diff(bounds)
    kinds = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), kinds)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(kinds) - kinds, kinds) + bounds[:-1][doc]
    made = K.span_hashes(words, first, np.minimum(first + WORDS, bounds[1:][doc]))
    keys, times = K.counted(doc.astype(np.uint64) << np.uint64(48) | made >> np.uint64(16))
    own = (keys >> np.uint64(48)).astype(np.int64)
    return keys & np.uint64((1 << 48) - 1), times, np.searchsorted(own, np.arange(len(n) + 1))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Weighted signatures (sets x size), by throwing darts into the regions of the elements.

    An element of weight w owns w unit cells. Darts fall into a cell as a Poisson
    process in their rank, drawn from the cell's hash alone, and each belongs to one of
    ``size`` coordinates. Of a set, only darts up to a rank limit are thrown (about
    size * (ln(size) + 3) of them, whatever the number of elements); where a coordinate
    stays empty the limit is doubled. The earliest dart of a coordinate is its value,
    so two sets agree in one with the probability of their weighted Jaccard similarity.
    """
    n_sets = len(bounds) - 1
    out = np.zeros((n_sets, size), np.uint64)
    cell_of = np.repeat(np.arange(len(elements)), weights)
    turn = np.arange(len(cell_of)) - np.repeat(np.cumsum(weights) - weights, weights)
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))[cell_of]
    seeds = K.mix(elements[cell_of] * np.uint64(0x9E3779B97F4A7C15) + turn.astype(np.uint64))
    total = np.bincount(owner, minlength=n_sets)
    limit = size * (np.log(size) + 3) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        chosen = np.flatnonzero(todo[owner])
        own, seed = owner[chosen], seeds[chosen]
        rank, most = np.zeros(len(own)), limit[own]
        best = np.full(n_sets * size, np.inf)
        thrown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(own):
            step += 1
            draw = K.mix(seed + np.uint64(step * 0xA0761D6478BD642F % 2**64))
            rank = rank - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = rank <= most
            own, seed, rank, most, draw = own[live], seed[live], rank[live], most[live], draw[live]
            cell = own * size + (K.mix(draw) % np.uint64(size)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            thrown.append((cell, rank, draw))
        for cell, rank, draw in thrown:
            first = rank == best[cell]
            out.reshape(-1)[cell[first]] = draw[first]
        full = np.isfinite(best.reshape(n_sets, size)).all(axis=1)
        todo &= ~full
        limit = limit * 2
    return out


def _signed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, and the band keys of its signatures (none for a text without words).

    A text in which shingles repeat has a weighted and a plain signature; elsewhere they
    are the same. Equal values make equal keys, whichever signature they are of.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = K.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            for lo, hi, d, o in K.slices(data, offsets):
                elements, times, bounds = shingles(d, o)
                own = np.arange(len(bounds) - 1)
                twice = own[np.maximum.reduceat(np.append(times, 0), bounds[:-1]) * (np.diff(bounds) > 0) > 1]
                chosen = np.repeat(np.isin(own, twice), np.diff(bounds))
                plain = np.concatenate([[0], np.cumsum(np.diff(bounds)[twice])])
                bands = np.concatenate([dart_signatures(elements, times, bounds), dart_signatures(elements[chosen], np.ones(int(chosen.sum()), np.int64), plain)]).reshape(-1, BANDS, ROWS)
                order = np.argsort(np.concatenate([own, twice]), kind="stable")
                keys = salt[None, :].repeat(len(bands), axis=0)
                for r in range(ROWS):
                    keys = K.mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + bands[:, :, r])
                some = np.diff(bounds) > 0
                held = np.bincount(twice, minlength=len(own)) + some
                at = np.concatenate([[0], np.cumsum(held * BANDS)]).astype(np.int32)
                keys = keys[order][np.repeat(some, np.bincount(np.concatenate([own, twice]), minlength=len(own)))]
                raw = d.tobytes()
                digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(K.signed(keys.reshape(-1))))],
                    names=["doc_id", "digest", "bands"],
                )
        K.release()

    return texts(docs).mapInArrow(sign, "doc_id long, digest binary, bands array<long>")


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """node and its distinct shingles with their counts, as bytes."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            for lo, hi, d, o in K.slices(data, offsets):
                elements, times, bounds = shingles(d, o)
                sets = [elements[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                counts = [times[a:b].astype("<u4").tobytes() if (times[a:b] > 1).any() else b"" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], names=["node", "elements", "times"])

    return rows.mapInArrow(cut_up, "node long, elements binary, times binary")


def similarity(elements_a: bytes, times_a: bytes, elements_b: bytes, times_b: bytes) -> float:
    """The larger of two texts' weighted and plain Jaccard similarity, from their sorted shingles."""
    a, b = np.frombuffer(elements_a, np.uint64), np.frombuffer(elements_b, np.uint64)
    both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    plain = len(both) / max(1, len(a) + len(b) - len(both))
    if not times_a and not times_b:
        return plain
    ta = np.frombuffer(times_a, "<u4").astype(np.int64) if times_a else np.ones(len(a), np.int64)
    tb = np.frombuffer(times_b, "<u4").astype(np.int64) if times_b else np.ones(len(b), np.int64)
    least = int(np.minimum(ta[at_a], tb[at_b]).sum())
    return max(plain, least / max(1, int(ta.sum() + tb.sum()) - least))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.

    The sets are as large as the texts: by their compressed size Spark would take some
    of them for small, and send them through the driver; so both joins are sorted ones.
    """
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"), F.col("times").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("times").alias("tb"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k) for k in ("ea", "ta", "eb", "tb")}
            good = [similarity(*(c[k][i].as_py() for k in ("ea", "ta", "eb", "tb"))) >= threshold for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ea", "ta", "eb", "tb").mapInArrow(judge, "a long, b long")


def _compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Cut off, and in partitions of about ``rows`` rows: narrow tables of few rows otherwise cost a file for every pair of tasks."""
    return _compact_seen(df, rows)[0]


def _compact_seen(df: DataFrame, rows: int = 100_000, most: int | None = None, **more: Column) -> tuple[DataFrame, dict[str, int]]:
    """The same, with its number of rows (``n``) and these aggregates: they are counted as the rows are written, by no jobs of their own.

    Where there can't be more than ``most`` rows, no more files are written than these need:
    each file costs a process of the file system's.
    """
    seen = Observation()
    if most is not None:
        df = df.coalesce(most // 100_000 + 1)
    made = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in more.items())))
    return made.coalesce(seen.get["n"] // rows + 1), seen.get


def components(links: DataFrame) -> DataFrame:
    """node and the least node that its links lead to; only nodes with links.

    Labels move along links, and every second round jump to their label's label, until
    none changes; every round is cut off by a checkpoint.
    """
    edges, all_edges = _compact_seen(links.union(links.select("b", "a")).toDF("node", "other").distinct())
    labels = edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
    turn = 0
    while True:
        turn += 1
        heard = edges.join(labels.withColumnsRenamed({"node": "other"}), "other").select("node", "label", F.lit(None).cast("long").alias("own"))
        new = heard.union(labels.select("node", "label", F.col("label").alias("own"))).groupBy("node").agg(F.min("label").alias("next"), F.max("own").alias("label"))
        if turn % 2 == 0:
            jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
            new = new.join(jump, "next", "left").select("node", F.least("next", "far").alias("next"), "label")
        new, seen = _compact_seen(new, most=all_edges["n"], changed=F.count_if(F.col("label") != F.col("next")))
        labels = new.select("node", F.col("next").alias("label"))
        if not seen["changed"]:
            return labels


def parity_map(cells: np.ndarray) -> bytes:
    """Of each hash slot, whether an odd number of the set's cells fall into it; at least four slots a cell up to 65,536.

    The slots in which two sets' maps differ are never more than the cells that only one
    of them has. A map folds to half its width by xor of its halves.
    """
    bits = min(1 << 16, 1 << max(9, int(4 * len(cells) - 1).bit_length()))
    return np.packbits(np.bincount((K.mix(cells) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _marks(sets: DataFrame) -> DataFrame:
    """node, and the size and parity map of its plain and of its weighted set; the weighted map is empty where nothing repeats."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for elements, times in zip(batch.column(1), batch.column(2), strict=True):
                cells = np.frombuffer(elements.as_py(), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                n = np.frombuffer(times.as_py(), "<u4").astype(np.int64)
                turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                more = np.repeat(cells, n) + turn.astype(np.uint64) if len(n) else cells
                rows.append((len(cells), parity_map(cells), len(more), parity_map(more) if len(n) else b""))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            made = [pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["node", "n", "map", "total", "more"])

    return sets.select("node", "elements", "times").mapInArrow(mark, "node long, n long, map binary, total long, more binary")


def within_reach(n: np.ndarray, maps: list[bytes], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets (places a, b) may have a Jaccard similarity of ``threshold``: none that has it is left out."""
    most = (1 - threshold) / (1 + threshold) * (n[a] + n[b]) + 1e-6
    good = np.abs(n[a] - n[b]) <= most
    width = np.array([len(m) for m in maps])
    low = np.minimum(width[a], width[b])
    for size in np.unique(low[good]).tolist():
        mine = np.flatnonzero(good & (low == size))
        used, at = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
        table = np.stack([np.bitwise_xor.reduce(np.frombuffer(maps[u], np.uint64).reshape(-1, size // 8), axis=0) for u in used.tolist()])
        for part in np.array_split(np.arange(len(mine)), -(-len(mine) * size // (1 << 24))):
            apart = np.bitwise_count(table[at[part]] ^ table[at[len(mine) + part]]).sum(axis=1, dtype=np.int64)
            good[mine[part]] = apart <= most[mine[part]]
    return good


def _open_pairs(cells: DataFrame, labels: DataFrame | None, sets: DataFrame, threshold: float, block_bytes: int) -> DataFrame:
    """All pairs (a, b) of different classes in a bucket, but those whose sizes or parity maps rule a link out.

    A bucket's largest class and the rest are dealt into blocks whose maps take about
    ``block_bytes``; blocks of the largest class meet blocks of the rest, and those meet
    each other. Pairs are made and ruled out inside a task, so only the few that are left
    are rows. A node travels once for each block that it meets: of usual texts a block holds
    thousands, so a bucket of some ten thousand nodes makes a few copies of each.
    """
    here = cells.withColumn("class", F.col("node")) if labels is None else cells.join(labels, "node", "left").select("cell", "node", F.coalesce("label", "node").alias("class"))
    size = F.octet_length("elements") / 8
    widths = sets.select("node", (2 * F.least(F.lit(8192), F.greatest(F.lit(64), size)) + 64).cast("long").alias("bytes"))
    here = _compact(here.join(widths, "node"), 1_000_000)
    by_class = here.groupBy("cell", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = by_class.groupBy("cell").agg(F.count("*").alias("classes"), F.sum("bytes").alias("all"), F.max(F.struct("n", "class", "bytes")).alias("m")).where("classes > 1")
    parts = lambda n: F.greatest(F.ceil(n / block_bytes), F.lit(1)).cast("int")
    main = main.select("cell", "classes", F.col("m.class").alias("main"), parts(F.col("m.bytes")).alias("mains"), parts(F.col("all") - F.col("m.bytes")).alias("rests"))
    left = _compact(here.join(main, "cell"), 1_000_000)
    marks = _marks(sets.join(left.select("node").distinct(), "node", "left_semi"))
    is_main = F.col("class") == F.col("main")
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    met = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    own = F.col("own")
    of_main = F.transform(upto("rests"), lambda o: met(0, own, o, F.lit(0)))
    of_rest = F.transform(upto("mains"), lambda o: met(0, o, own, F.lit(1)))
    each_other = F.transform(upto("rests"), lambda o: met(1, F.least(own, o), F.greatest(own, o), F.when(o == own, -1).otherwise((own > o).cast("int"))))
    dealt = F.when(is_main, of_main).when(F.col("classes") > 2, F.concat(of_rest, each_other)).otherwise(of_rest)
    rows = left.select("cell", "node", "class", F.explode(dealt).alias("to")).select("cell", "node", "class", "to.*")
    rows = rows.join(marks.hint("merge"), "node").repartition("cell", "kind", "i", "j").sortWithinPartitions("cell", "kind", "i", "j", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            node, kind, side = (t[c].to_numpy() for c in ("node", "class", "side"))
            runs = np.flatnonzero(np.concatenate(([True], np.isin(np.arange(1, t.num_rows), starts) | (side[1:] != side[:-1]), [True])))
            group = np.searchsorted(starts, np.arange(t.num_rows), "right") - 1
            stop = np.append(starts[1:], t.num_rows)[group]
            begin = np.where(side < 0, np.arange(t.num_rows) + 1, runs[np.searchsorted(runs, np.arange(t.num_rows), "right")])
            n_pairs = np.maximum(stop - begin, 0)
            ends = np.cumsum(n_pairs)
            n, total, plain = t["n"].to_numpy(), t["total"].to_numpy(), t["map"].to_pylist()
            more = [m or p for m, p in zip(t["more"].to_pylist(), plain, strict=True)]
            lo = 0
            while lo < t.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 500_000, "right")))
                a = np.repeat(np.arange(lo, hi), n_pairs[lo:hi])
                b = np.arange(len(a)) - np.repeat(ends[lo:hi] - n_pairs[lo:hi] - (ends[lo - 1] if lo else 0), n_pairs[lo:hi]) + begin[a]
                differ = kind[a] != kind[b]
                a, b = a[differ], b[differ]
                good = within_reach(n, plain, a, b, threshold)
                rest = np.flatnonzero(~good & ((n != total)[a] | (n != total)[b]))
                good[rest] = within_reach(total, more, a[rest], b[rest], threshold)
                x, y = node[a[good]], node[b[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                lo = hi

        def groups(t: pa.Table) -> np.ndarray:
            keys = np.stack([t[c].to_numpy().astype(np.int64) for c in ("cell", "kind", "i", "j")])
            return np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))) if t.num_rows else np.zeros(0, int)

        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            starts = groups(t)
            if len(starts) > 1:  # the last group may go on
                yield from made(t.slice(0, starts[-1]), starts[:-1])
                held = t.slice(starts[-1]).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            if t.num_rows:
                yield from made(t, groups(t))
        K.release()

    return rows.mapInArrow(meet, "a long, b long").distinct()


def near_classes(docs: DataFrame, threshold: float = SIMILARITY, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and class_id of every row: the least doc_id of its class.

    Texts are in one class if equal, or if links of similarity >= 0.8 over shingles of
    five words lead from one to the other (similarity: the larger of the weighted and
    the plain Jaccard). Equal texts are one node, the least of their ids, whatever their
    number. Candidates share a band of their weighted or their plain dart signatures (20
    bands of 3: a pair at 0.8 in either is missed once in 1.7 million). In a bucket every node is compared with one
    centre; then, in up to ``rounds`` rounds, nodes whose bucket still holds another
    class are compared with two other members of the bucket's largest class. These rounds
    only join the large families cheaply: at last all pairs of different classes that
    still share a bucket are compared, but those whose sizes or parity maps show that
    they can't be similar enough. So no pair of a bucket is left untested.

    Texts without words are linked by equality alone. A row with a null id takes the
    class of the equal texts that have ids, else null. Rows that share an id are one
    document. An empty table gives no rows.
    """
    signed = cut(_signed_texts(docs))
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = cut(nodes)
    cells = nodes.where("node is not null").select("node", F.explode("bands").alias("cell")).distinct()
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    cells, all_cells = _compact_seen(cells.join(shared, "cell").select("cell", "node"), 1_000_000)
    wanted = cells.select("node").distinct()
    sets = cut(_shingle_sets(texts(docs).where("doc_id is not null").join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")).dropDuplicates(["node"]))
    links = tested = labels = None
    for turn in range(rounds):
        if labels is None:
            here = cells.withColumn("class", F.col("node"))
        else:
            here, _ = _compact_seen(cells.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")), 1_000_000, all_cells["n"])
        by_class = here.groupBy("cell", "class").agg(
            F.count("*").alias("n"),
            F.min_by("node", F.xxhash64("node", F.lit(2 * turn))).alias("one"),
            F.min_by("node", F.xxhash64("node", F.lit(2 * turn + 1))).alias("two"),
        )
        main = by_class.groupBy("cell").agg(F.count("*").alias("classes"), F.max(F.struct("n", -F.col("class"), "class", "one", "two")).alias("m"))
        main = main.where("classes > 1").select("cell", F.col("m.class").alias("main"), F.col("m.one").alias("one"), F.col("m.two").alias("two"))
        pairs = here.join(main, "cell").where(F.col("class") != F.col("main"))
        pairs = pairs.select("node", F.explode(F.array("one", "two") if turn else F.array("one")).alias("centre"))
        pairs = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, seen = _compact_seen(pairs, most=2 * all_cells["n"])
        if not seen["n"]:
            break
        found = _verified(pairs, sets, threshold)
        links = _compact(found if links is None else links.union(found))
        tested = pairs if tested is None else tested.union(pairs)
        labels = components(links)
    pairs = _open_pairs(cells, labels, sets, threshold, block_bytes)
    pairs, seen = _compact_seen(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
    if seen["n"]:
        found, seen = _compact_seen(_verified(pairs, sets, threshold))
        if seen["n"]:
            labels = components(found if links is None else links.union(found))
    ids = signed.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest")
    if labels is None:
        return ids.select("doc_id", F.col("node").alias("class_id"))
    return ids.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the least id.

    Rows with a null id stay, one of each text, where no text with an id is equal to theirs;
    of rows that share an id one with the least text stays. A null text is an empty one.
    Other columns, of any name, are carried; an empty table stays empty.
    """
    named, docs = docs.columns, plain(docs, "doc_id", "text")
    classes = near_classes(docs, threshold)
    kept = cut(classes.where("class_id is null or doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    out = docs.join(kept.where("doc_id is not null").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if kept.where("doc_id is not null and n > 1").limit(1).count():
        (least,) = unused(docs, "_least")
        twice = kept.where("n > 1").select("doc_id")
        lows = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias(least))
        out = out.join(lows, "doc_id", "left").where(F.col(least).isNull() | (F.coalesce("text", F.lit("")) == F.col(least)))
        out = out.select(*docs.columns).dropDuplicates(["doc_id"])
    if kept.where("doc_id is null").limit(1).count():
        (same,) = unused(docs, "_same")
        known = docs.where("doc_id is not null").select(F.coalesce("text", F.lit("")).alias(same))
        alone = docs.where("doc_id is null").withColumn(same, F.coalesce("text", F.lit("")))
        out = out.unionByName(alone.join(known, same, "left_anti").dropDuplicates([same]).select(*docs.columns))
    return out.toDF(*named)
