"""7. Language-model scoring by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm import kernels as K
from lorespark.llm.frames import cut, held_out, texts

FOLDS = 10
ORDER = 5
TOP_GRAMS = 1 << 20
TOP_WORDS = 1 << 17
END = 0xFF  # a byte that no UTF-8 text has
_END_WORD = np.uint64(0x0123456789ABCDEF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def framed(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with ``order`` end marks before each and one after; and where each's own symbols begin and end."""
    n = np.diff(offsets)
    starts = offsets[:-1] + np.arange(len(n)) * (order + 1) + order
    out = np.full(int(offsets[-1]) + len(n) * (order + 1), END, np.uint8)
    out[np.arange(len(data)) + np.repeat(starts - offsets[:-1], n)] = _LOWER[data]
    return out, starts


def keys_at(framed_bytes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each place from ``order`` on, the bytes of the context and the symbol as one number, symbol last."""
    n = len(framed_bytes) - order
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(order + 1):
        key = key << np.uint64(8) | framed_bytes[k:k + n].astype(np.uint64)
    return key


def _own(starts: np.ndarray, sizes: np.ndarray, order: int, total: int) -> np.ndarray:
    """Which of the keys end at a symbol of a text (or its end mark), not at a mark in front."""
    own = np.zeros(total + 1, np.int32)
    np.add.at(own, starts - order, 1)
    np.add.at(own, starts - order + sizes + 1, -1)
    return np.cumsum(own[:-1]) > 0


def corpus_counts(docs: DataFrame, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """(kind, key, n): how often each word ("w") and each run of order+1 bytes ("g") stands in the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = K.Tally(), K.Tally()

        def out(kind: str, made: Iterator) -> Iterator[pa.RecordBatch]:
            for keys, n in made:
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys)), pa.array(K.signed(keys)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            data, offsets = K.column_bytes(batch.column(0))
            for _, _, d, o in K.slices(data, offsets):
                starts, ends, _ = K.word_bounds(d, o)
                found = K.word_hashes(d, starts, ends, lower=True)
                yield from out("w", words.add(np.concatenate([found, np.full(len(o) - 1, _END_WORD)])))
                framed_bytes, first = framed(d, o, order)
                keys = keys_at(framed_bytes, order)
                yield from out("g", grams.add(keys[_own(first, np.diff(o), order, len(keys))]))
        yield from out("w", words.flush())
        yield from out("g", grams.flush())
        K.release()

    training = texts(docs).where(~held_out(F.col("doc_id"), folds)).select("text")
    return training.mapInArrow(count, "kind string, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> Column:
    """Which rows of (key, n) are frequent: about ``most`` at the most.

    The least count is found from a histogram of counts by eighths of a power of two. Of
    the first bin that does not fit whole, a share by hash is taken, so many rows of one
    count can't leave the frequent ones empty.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect()  # 8 * 63 rows at most
    least, room, edge, share = 1 << 30, most, -1, 0.0
    for b in bins:
        if b["rows"] > room:
            edge, share = b["step"], room / b["rows"]
            break
        least, room = b["step"], room - b["rows"]
    return (step >= least) | ((step == edge) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20))))


def log10_probabilities(wanted: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """key and log10 of the probability of its last byte after its other bytes, for every key of ``wanted``.

    ``grams`` (key, n) are the training counts of all runs of order + 1 bytes; those of
    the shorter runs are their sums. From the longest context down, the keys meet their
    context's symbols in one join a level: a context with sum T and D symbols gives its
    symbols c / (T + D) and escapes with D / (T + D) (escape method C); shorter contexts
    leave out the symbols already refused, and the last resort is uniform over the
    symbols never seen. A context has 256 symbols at most. Nothing is left out, and no
    table of contexts has to fit anywhere: joins of the low orders are small by nature
    (256 ** k contexts), the others are shuffled.
    """
    todo = cut(wanted.select("key", F.lit(0.0).alias("logp"), F.array().cast("array<int>").alias("refused")))
    done: list[DataFrame] = []
    for k in range(order, -1, -1):
        shorter = (F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))) if k < order else F.col("key")
        counts = grams if k == order else grams.groupBy(shorter.alias("key")).agg(F.sum("n").alias("n"))
        context, symbol = F.shiftright(shorter, 8), shorter.bitwiseAND(F.lit(255)).cast("int")
        here = todo.withColumn("context", context).withColumn("symbol", symbol)
        counts = counts.select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("s"), "n")
        counts = counts.join(here.select("context").distinct(), "context", "left_semi")
        nodes = counts.groupBy("context").agg(F.collect_list(F.struct("s", "n")).alias("seen"))  # 256 symbols at most
        here = here.join(F.broadcast(nodes) if k < 2 else nodes, "context", "left")  # 256 rows at most
        left = F.filter(F.coalesce("seen", F.array().cast("array<struct<s:int,n:bigint>>")), lambda x: ~F.array_contains("refused", x["s"]))
        here = here.withColumn("left", left)
        total = F.aggregate("left", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]) + F.size("left")
        own = F.filter("left", lambda x: x["s"] == F.col("symbol"))
        here = here.withColumn("total", total).withColumn("own", F.when(F.size(own) > 0, own[0]["n"]))
        made = F.when(F.col("own").isNotNull(), F.log10(F.col("own") / F.col("total"))).when(F.size("left") > 0, F.log10(F.size("left") / F.col("total"))).otherwise(0.0)
        here = cut(
            here.select(
                "key", (F.col("logp") + made).alias("logp"), F.col("own").isNotNull().alias("hit"),
                F.when(F.col("own").isNull(), F.concat("refused", F.transform("left", lambda x: x["s"]))).otherwise(F.array().cast("array<int>")).alias("refused"),
            )
        )
        done.append(here.where("hit").select("key", "logp"))
        todo = here.where("not hit").select("key", "logp", "refused")
    done.append(todo.select("key", (F.col("logp") - F.log10(256 - F.size("refused"))).alias("logp")))
    return reduce(DataFrame.unionAll, done)


def score(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, top_grams: int = TOP_GRAMS, top_words: int = TOP_WORDS) -> DataFrame:
    """Scores every row by a byte trie and by a unigram base, both learnt from the rows not held out.

    Counts cover all training texts, and every count takes part. The most frequent
    words (about ``top_words``) and longest contexts with their symbols (about
    ``top_grams``) are sent to the tasks with their finished logarithms, which bounds a
    task's memory; what a text has beside them is joined with the whole tables, to the
    same values. A null text is empty: it has the end alone. Repeated rows are scored and
    learnt from once each; a null id is a training row. With no training row, the model
    is uniform over 256 symbols.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    counts = cut(corpus_counts(docs, order, folds))
    words = counts.where("kind = 'w'").select("key", "n")
    grams = counts.where("kind = 'g'").select("key", "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = int(totals["n"]), int(totals["v"])
    frequent = _frequent(words, top_words)
    top = words.where(frequent).toArrow()  # about top_words rows at most
    of_context = Window.partitionBy(F.shiftright("key", 8))
    total = F.sum("n").over(of_context) + F.count("*").over(of_context)
    values = grams.withColumn("logp", F.log10(F.col("n") / total)).where(_frequent(grams, top_grams)).select("key", "logp").toArrow()  # about top_grams rows at most
    column = lambda t, c: t[c].to_numpy()
    shared = spark.sparkContext.broadcast((column(top, "key").view(np.uint64), column(top, "n"), column(values, "key").view(np.uint64), column(values, "logp")))
    del top, values

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            if made is None:
                word_keys, word_n, gram_keys, gram_logs = shared.value
                made = K.KeyTable(word_keys), np.append(np.log10(word_n + 0.1), 0.0), K.KeyTable(gram_keys), np.append(gram_logs, 0.0)
            word_table, word_logs, gram_table, gram_logs = made
            data, offsets = K.column_bytes(batch.column(1))
            for lo, hi, d, o in K.slices(data, offsets, 1 << 20):
                starts, ends, bounds = K.word_bounds(d, o)
                found = K.word_hashes(d, starts, ends, lower=True)
                at = word_table.find(found)
                n_words, words_left = _left(found, at < 0, bounds)
                framed_bytes, first = framed(d, o, order)
                keys = keys_at(framed_bytes, order)
                keys = keys[_own(first, np.diff(o), order, len(keys))]
                key_bounds = o + np.arange(len(o))
                where = gram_table.find(keys)
                n_grams, grams_left = _left(keys, where < 0, key_bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(bounds).astype(np.int64) + 1),
                        pa.array(K.per_row_sums(at >= 0, bounds).astype(np.int64)),
                        pa.array(K.per_row_sums(word_logs[at], bounds)),
                        pa.array(K.per_row_sums(gram_logs[where], key_bounds)),
                        words_left, n_words, grams_left, n_grams,
                    ],
                    names=["doc_id", "n_tokens", "n_top", "top_sum", "score", "words", "n_words", "grams", "n_grams"],
                )
        K.release()

    lists = "words array<long>, n_words array<int>, grams array<long>, n_grams array<int>"
    judged = texts(docs).mapInArrow(judge, f"doc_id long, n_tokens long, n_top long, top_sum double, score double, {lists}")
    judged = cut(judged.withColumn("_row", F.monotonically_increasing_id()))
    left = lambda c: judged.where(F.size(c) > 0).select("_row", F.explode(F.arrays_zip(F.col(c).alias("key"), F.col(f"n_{c}").alias("times"))).alias("x")).select("_row", "x.*")
    rest = left("words").join(words.where(~frequent), "key", "left")
    rest = rest.groupBy("_row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("n_rare"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_sum"))
    unknown = left("grams")
    logs = log10_probabilities(unknown.select("key").distinct(), grams, order) if unknown.limit(1).count() else grams.select("key", F.lit(0.0).alias("logp")).limit(0)
    more = unknown.join(logs, "key").groupBy("_row").agg(F.sum(F.col("times") * F.col("logp")).alias("gram_sum"))
    ends = int(words.where(F.col("key") == int(_END_WORD)).select("n").first()[0]) if train_tokens else 0
    whole = float(np.log10(train_tokens + 0.1 * (distinct + 1)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return judged.join(rest, "_row", "left").join(more, "_row", "left").select(
        "doc_id",
        held_out(F.col("doc_id"), folds).alias("held_out"),
        "n_tokens",
        (F.col("n_top") + zero("n_rare") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("top_sum") + zero("rare_sum") + F.lit(float(np.log10(ends + 0.1))) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("score") + zero("gram_sum")).alias("score"),
    )


def _left(keys: np.ndarray, chosen: np.ndarray, bounds: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Of each row, how often each chosen key stands in it, and the distinct chosen keys."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[chosen]
    own = keys[chosen]
    order = np.lexsort((own, row))
    row, own = row[order], own[order]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])))) if len(own) else np.zeros(0, int)
    at = pa.array(np.searchsorted(row[first], np.arange(len(bounds))).astype(np.int32))
    times = np.diff(np.append(first, len(own))).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(times)), pa.ListArray.from_arrays(at, pa.array(K.signed(own[first])))
