"""Chunking, extraction, upkeep and checks of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lorespark.functions.text import FORBIDDEN, KEYWORD_STOP_WORDS, NOT_ALNUM, classify_label, entity_runs, relation_for, summarize, trim
from lorespark.functions.text import sentences as split_sentences
from lorespark.functions.vectors import embedding_broken
from lorespark.session import sized, small_batches

# Words at the head of a capitalised run that name nothing.
LEADING_STOP_WORDS = frozenset((
    "The", "This", "That", "These", "Those", "A", "An", "It", "We", "You", "They", "He", "She",
    "I", "If", "When", "While", "And", "But", "Or", "So", "Then", "There", "Here", "Each", "Every",
    "Some", "Any", "All", "No", "Not", "For", "As", "At", "By", "In", "On", "To", "Of", "Its",
))

CHUNK_ROWS, CHUNK_BYTES = 500, 4 << 20  # texts that a chunking task gets at a time; characters of chunks that it holds
PAIR_BLOCK = 256  # entities of a sentence that are paired in one list


# -- chunking -----------------------------------------------------------------


def _paragraphs(text: str) -> list[str]:
    return [p.strip() for p in text.split("\n\n") if p.strip()]


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in re.findall(r"[^.!?。]*[.!?。]|[^.!?。]+$", text) if s.strip()]


def _packed(units: list[str], size: int, joint: str, counted: int) -> list[str]:
    """Joins units, in order, while a chunk and the next unit (with ``counted`` for the joint) fit the size."""
    out: list[str] = []
    for unit in units:
        if out and len(out[-1]) + counted + len(unit) <= size:
            out[-1] += joint + unit
        else:
            out.append(unit)
    return out


def adaptive_chunks(text: str, size: int) -> list[str]:
    """Paragraphs joined up to the size; a longer one is cut into sentences. Joints don't count."""
    out: list[str] = []
    small: list[str] = []
    for p in _paragraphs(text):
        if len(p) > size:
            out += _packed(small, size, "\n\n", 0) + _packed(_sentences(p), size, " ", 0)
            small = []
        else:
            small.append(p)
    return out + _packed(small, size, "\n\n", 0)


def recursive_chunks(text: str, size: int) -> list[str]:
    """Paragraphs, else sentences, else words, else pieces of words, joined by blanks; no chunk is longer than the size."""
    units: list[str] = []
    for p in _paragraphs(text):
        for s in [p] if len(p) <= size else _sentences(p):
            if len(s) <= size:
                units.append(s)
                continue
            run: list[str] = []
            for w in s.split():
                if len(w) > size:
                    units += _packed(run, size, " ", 1) + [w[i:i + size] for i in range(0, len(w), size)]
                    run = []
                else:
                    run.append(w)
            units += _packed(run, size, " ", 1)
    return [c.strip() for c in _packed(units, size, " ", 1) if c.strip()]


def paragraph_chunks(text: str, size: int) -> list[str]:
    """Paragraphs, of whatever size."""
    return _paragraphs(text)


CHUNKINGS = {"adaptive": adaptive_chunks, "recursive": recursive_chunks, "paragraph": paragraph_chunks}


def chunked(text: str | None, how: str, size: int, overlap: int = 0) -> list[str]:
    """A text's chunks, with the end of the chunk before in front; a null text has none."""
    chunks = CHUNKINGS[how](text or "", size)
    return [f"{chunks[i - 1][-overlap:]} {c}" if overlap and i else c for i, c in enumerate(chunks)]


def chunk_rows(docs: DataFrame, how: str, size: int, overlap: int = 0) -> DataFrame:
    """id, at, chunk, by one of ``CHUNKINGS``, with the end of the chunk before in front.

    Texts are taken one at a time from small batches, and what is made of them leaves
    whenever it comes to ``CHUNK_BYTES``, so a task holds no more of the chunks than that and one text's.
    """
    id_type = docs.schema["id"].dataType

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, chunks, held = [], [], [], 0
            for i, text in enumerate(batch.column("body")):
                for k, chunk in enumerate(chunked(text.as_py(), how, size, overlap)):
                    of.append(i)
                    at.append(k)
                    chunks.append(chunk)
                    held += len(chunk)
                if held >= CHUNK_BYTES:
                    yield rows(batch, of, at, chunks)
                    of, at, chunks, held = [], [], [], 0
            if of:
                yield rows(batch, of, at, chunks)

    def rows(batch: pa.RecordBatch, of: list[int], at: list[int], chunks: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), pa.array(at, pa.int32()), pa.array(chunks, pa.string())], ["id", "at", "chunk"])

    return small_batches(docs, CHUNK_ROWS).select("id", "body").mapInArrow(emit, f"id {id_type.simpleString()}, at int, chunk string")


def passages(docs: DataFrame, size: int = 800, overlap: int = 80) -> DataFrame:
    """Documents of type "chunk", titled <source>#<n>, of the texts of ``docs``: what an index holds of them."""
    name = F.concat("id", F.lit("#"), F.col("at").cast("string"))
    return chunk_rows(docs, "recursive", size, overlap).select(
        name.alias("id"), F.lit("chunk").alias("doc_type"), name.alias("title"), F.lit(None).cast("string").alias("author"), F.col("chunk").alias("body"),
        F.create_map(F.lit("source"), F.col("id")).alias("metadata"), F.lit(100).alias("confidence"),
    )


def replace_passages(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with these passages in place of all that it had of their sources.

    Only passages that name a source are joined: other rows have no key, so a join
    would send all of them, with their texts, to the task of the null key.
    """
    sources = new.select(F.col("metadata")["source"].alias("_source")).distinct()
    passage = F.coalesce((F.col("doc_type") == "chunk") & F.col("metadata")["source"].isNotNull(), F.lit(False))
    held = store.where(passage).withColumn("_source", F.col("metadata")["source"]).join(sources, "_source", "left_anti").select(*store.columns)
    return store.where(~passage).unionByName(held).unionByName(new, allowMissingColumns=True)


# -- extraction ---------------------------------------------------------------


def entity_mentions(docs: DataFrame) -> DataFrame:
    """id, sentence, at, entity, gap: runs of capitalised words, and the lower-cased words since the one before.

    A null body has none; sentences and places count from 0.
    """
    sentences = docs.select("id", F.posexplode(split_sentences(F.coalesce("body", F.lit("")))).alias("sentence", "words"))
    found = sentences.select("id", "sentence", F.posexplode(entity_runs(F.col("words"), LEADING_STOP_WORDS)).alias("at", "found"))
    return found.select("id", "sentence", "at", "found.entity", "found.gap")


def extracted_nodes(mentions: DataFrame) -> DataFrame:
    """name (lower case), label, kind, confidence: each document is one extraction; the highest confidence counts.

    A document gives 45 for a first mention and 15 for each further one, 100 at most.
    The label is as first written, by document and place.
    """
    per_doc = mentions.groupBy("id", F.lower("entity").alias("name")).agg(F.count("*").alias("n"), F.min_by("entity", F.struct("sentence", "at")).alias("label"))
    confidence = F.least(45 + (F.col("n") - 1) * 15, F.lit(100)).cast("int")
    out = per_doc.groupBy("name").agg(F.max(confidence).alias("confidence"), F.min_by("label", "id").alias("label"))
    return out.select("name", "label", classify_label(F.col("label")).alias("kind"), "confidence")


def extracted_edges(mentions: DataFrame, known: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """src, dst (names) and kind, one edge for each ordered pair.

    Within a sentence, neighbours get the relation that the words between them tell;
    other pairs, the earlier entity first, are related_to. Of several, the first by
    document, sentence and place counts; pairs of ``known`` (src, dst) get none. A
    sentence of many entities is paired by blocks, so no row or task holds all of it.
    ``within`` names a field of the ids: each of its values has edges of its own.
    """
    m = mentions.withColumn("name", F.lower("entity"))
    ahead = Window.partitionBy("id", "sentence").orderBy("at")
    typed = m.withColumn("dst", F.lead("name").over(ahead)).withColumn("between", F.lead("gap").over(ahead)).where("dst is not null and name <> dst")
    typed = typed.select("id", "sentence", F.lit(0).alias("phase"), F.col("at").alias("i"), F.col("name").alias("src"), "dst", relation_for(F.col("between")).alias("kind"))
    first = m.groupBy("id", "sentence", "name").agg(F.min("at").alias("at")).withColumn("block", F.floor(F.col("at") / PAIR_BLOCK).cast("int"))
    # within a block of a sentence: the list of its entities, each at its first place
    lists = first.groupBy("id", "sentence", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
    heads = lists.select("id", "sentence", "names", F.posexplode("names").alias("i", "src"))
    pairs = heads.select("id", "sentence", "src", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("dst"))
    # across the blocks of a long sentence: a join for each pair of blocks
    long_ = first.where("block > 0").groupBy("id", "sentence").agg(F.max("block").alias("last"))
    spread = first.join(long_, ["id", "sentence"])
    ahead_of = spread.where("block < last").select("id", "sentence", F.col("name").alias("src"), F.col("block").alias("a"), F.explode(F.sequence(F.col("block") + 1, F.col("last"))).alias("b"))
    behind = spread.where("block > 0").select("id", "sentence", F.col("name").alias("dst"), F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("a"), F.col("block").alias("b"))
    pairs = pairs.unionByName(ahead_of.join(behind, ["id", "sentence", "a", "b"]).select("id", "sentence", "src", "dst"))
    pairs = pairs.select("id", "sentence", F.lit(1).alias("phase"), F.lit(0).alias("i"), "src", "dst")
    all_ = typed.unionByName(pairs.withColumn("kind", F.lit("related_to")))
    keys = ["src", "dst"]
    if within is not None:
        keys, all_ = [within, *keys], all_.withColumn(within, F.col("id")[within])
    out = all_.groupBy(*keys).agg(F.min_by("kind", F.struct("id", "sentence", "phase", "i")).alias("kind"))
    return out if known is None else out.join(known.select(*keys), keys, "left_anti")


# -- upkeep -------------------------------------------------------------------


def garbage(docs: DataFrame, now: str | None = None, min_confidence: int = 0, dim: int | None = None) -> DataFrame:
    """id and reason of the documents to remove.

    In this order: expired (metadata "expires" up to now), low confidence, broken
    embedding, and duplicate of (doc_type, title, body): of those not removed before,
    the one of highest confidence, then least id, stays.
    """
    reason = F.lit(None).cast("string")
    if dim is not None:
        reason = F.when(embedding_broken(F.col("embedding"), dim), F.lit("broken_embedding")).otherwise(reason)
    if min_confidence > 0:
        reason = F.when(F.col("confidence") < min_confidence, F.lit("low_confidence")).otherwise(reason)
    if now is not None:
        reason = F.when(F.col("metadata")["expires"] <= now, F.lit("expired")).otherwise(reason)
    judged = docs.withColumn("reason", reason)
    # texts are compared by digest, so the window's shuffle carries none
    key = F.sha2(F.concat_ws("\u0000", "doc_type", "title", "body"), 256)
    left = judged.where("reason is null").select("id", "confidence", key.alias("key"))
    copies = left.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("confidence"), "id"))).where("n > 1")
    return judged.where("reason is not null").select("id", "reason").unionByName(copies.select("id", F.lit("duplicate").alias("reason")))


def keywords(docs: DataFrame, top: int) -> DataFrame:
    """id, place, word, n: the most frequent words (see ``keyword_words``) of each document, ties by the alphabet.

    A text's words are counted where it is read, and only its ``top`` leave the task; of rows
    that share an id all words do, as their counts are added first.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column("text"), "\n")
            each = words.flatten().dictionary_encode()
            known = each.dictionary.cast(pa.binary())
            by_bytes = pc.array_sort_indices(known)
            rank = np.empty(len(known), np.int64)
            rank[by_bytes.to_numpy()] = np.arange(len(known))
            counts = pc.and_(pc.greater_equal(pc.binary_length(known), 4), pc.invert(pc.is_in(each.dictionary, pa.array(KEYWORD_STOP_WORDS))))
            at = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
            codes = each.indices.to_numpy()
            held = counts.to_numpy(zero_copy_only=False)[codes]
            key, n = np.unique(at[held] * max(len(known), 1) + rank[codes[held]], return_counts=True)
            row, word = np.divmod(key, max(len(known), 1))
            order = np.lexsort((word, -n, row))
            row, word, n = row[order], word[order], n[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < top
            kept = first | batch.column("again").to_numpy(zero_copy_only=False)[row]
            names = each.dictionary.take(by_bytes.take(pa.array(word[kept])))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[kept])), names, pa.array(n[kept].astype(np.int64))], ["id", "word", "n"])

    again = sized(docs.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id", F.lit(True).alias("again")))
    shared = (F.coalesce("again", F.lit(False)) | F.col("id").isNull()).alias("again")
    rows = small_batches(docs).join(again, "id", "left").select("id", shared, F.lower(F.regexp_replace("body", NOT_ALNUM, "\n")).alias("text"))
    schema = StructType([docs.schema["id"], StructField("word", StringType()), StructField("n", LongType())])
    counts = rows.mapInArrow(counted, schema).groupBy("id", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "word"))
    return counts.withColumn("place", place).where(F.col("place") <= top)


def consolidate(docs: DataFrame, size: int) -> DataFrame:
    """Bodies above the size become summaries, marked with what they were; marked ones stay as they are.

    Summaries are made where texts are read, so that no long text is joined with its words.
    """
    due = ~F.map_contains_key("metadata", F.lit("compressed")) & (F.char_length("body") > size)
    words = keywords(docs.where(due), 5).groupBy("id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])).alias("concepts"))
    short = docs.withColumns({"due": due, "_length": F.char_length("body").cast("string"), "body": F.when(due, summarize(F.col("body"), size)).otherwise(F.col("body"))})
    marks = F.create_map(F.lit("compressed"), F.lit("true"), F.lit("original_len"), F.col("_length"), F.lit("concepts"), F.coalesce("concepts", F.lit("")))
    marked = F.map_concat(F.map_filter("metadata", lambda k, _: ~k.isin("original_len", "concepts")), marks)
    return short.join(words, "id", "left").withColumn("metadata", F.when(F.col("due"), marked).otherwise(F.col("metadata"))).select(*docs.columns, "due")


# -- checks -------------------------------------------------------------------


def _verdict(status: Column, reason: Column) -> Column:
    return F.struct(status.alias("status"), F.when(status == "fail", reason).alias("reason"))


def check_non_empty(text: Column) -> Column:
    return _verdict(F.when(trim(text) == "", F.lit("fail")).otherwise(F.lit("pass")), F.lit("output is empty"))


def repetition_words(text: Column) -> Column:
    words = F.transform(F.split(trim(text), r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")))
    return F.filter(words, lambda w: w != "")


def longest_run(words: Column) -> Column:
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(s["last"] == w, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(words, start, step, lambda s: s["most"])


def repetition_verdict(words: Column, run: Column, max_run: int = 6, min_tokens: int = 12, min_diversity: float = 0.25) -> Column:
    """From a text's words and their longest run, which a plan may compute once and name."""
    diversity = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    status = F.when(F.size(words) == 0, F.lit("skip")).when(run > max_run, F.lit("fail")).when((F.size(words) >= min_tokens) & (diversity < min_diversity), F.lit("fail")).otherwise(F.lit("pass"))
    return _verdict(status, F.when(run > max_run, F.lit("repeated token")).otherwise(F.lit("low lexical diversity")))


def check_repetition(text: Column) -> Column:
    """In one expression: a list of one holds the words, so that they are made once."""
    made = F.transform(F.array(repetition_words(text)), lambda w: F.struct(w.alias("words"), longest_run(w).alias("run")))
    return F.transform(made, lambda m: repetition_verdict(m["words"], m["run"]))[0]


def check_citations(text: Column) -> Column:
    number = lambda x: x.try_cast("long")
    known = lambda n: n.isNotNull() & (n < 2**32)
    refs = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)), number), known)
    defs = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*\[([0-9]+)\]"), F.lit(1)), number), known)
    missing = F.array_sort(F.array_except(refs, defs))
    status = F.when(F.size(refs) == 0, F.lit("skip")).when(F.size(missing) > 0, F.lit("fail")).otherwise(F.lit("pass"))
    return _verdict(status, F.concat(F.lit("undefined citation(s): "), F.concat_ws(", ", F.transform(missing, lambda n: n.cast("string")))))


def check_forbidden(text: Column, patterns: tuple[str, ...] = FORBIDDEN) -> Column:
    low, found = F.lower(text), F.lit(None).cast("string")
    for p in reversed(patterns):
        found = F.when(F.contains(low, F.lit(p.lower())), F.lit(p.lower())).otherwise(found)
    return _verdict(F.when(found.isNull(), F.lit("pass")).otherwise(F.lit("fail")), F.concat(F.lit("forbidden content: "), found))


STACK_PART = 1024  # brackets in one string of a stack


def check_json(text: Column) -> Column:
    """Whether brackets close in order, outside of strings; text that starts with none is passed over.

    The brackets that wait for their ends are a string of at most ``STACK_PART`` and a
    list of full ones, so deep nesting costs no copy of the whole stack at each step.
    A string without an end reaches to the end of the text.
    """
    whole = trim(text)
    bare = F.regexp_replace(whole, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)', "")
    brackets = F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]++", ""), ""), lambda c: c != "")
    none = F.lit(None).cast("string")
    state = lambda full, top, bad: F.struct(full.alias("full"), top.alias("top"), bad.alias("bad"))

    def step(s: Column, c: Column) -> Column:
        full, top = s["full"], s["top"]
        end = F.when(c == "[", F.lit("]")).otherwise(F.lit("}"))
        pushed = F.when(F.octet_length(top) == STACK_PART, state(F.array_append(full, top), end, none)).otherwise(state(full, F.concat(top, end), none))
        left = F.left(top, F.octet_length(top) - 1)
        emptied = (F.octet_length(top) == 1) & (F.size(full) > 0)
        popped = F.when(emptied, state(F.slice(full, F.lit(1), F.size(full) - 1), F.element_at(full, -1), none)).otherwise(state(full, left, none))
        return (
            F.when(s["bad"].isNotNull(), s)
            .when(c.isin("[", "{"), pushed)
            .when(top == "", state(full, top, F.lit("unbalanced closing delimiter")))
            .when(F.right(top, F.lit(1)) != c, state(full, top, F.lit("mismatched closing delimiter")))
            .otherwise(popped)
        )

    reason = F.aggregate(brackets, state(F.array().cast("array<string>"), F.lit(""), none), step, lambda s: F.coalesce(s["bad"], F.when(s["top"] != "", F.lit("unbalanced delimiters"))))
    judged = F.transform(F.array(reason), lambda r: _verdict(F.when(r.isNull(), F.lit("pass")).otherwise(F.lit("fail")), r))[0]
    return F.when(F.left(whole, F.lit(1)).isin("[", "{"), judged).otherwise(_verdict(F.lit("skip"), none))


_EQUATION = re.compile(
    r"(?<![A-Za-z0-9,.])(?<![+\-*/])(?<![+\-*/][ \t])([0-9]+)(?![0-9])(?![,.][0-9])[ \t]*([+\-*/])[ \t]*([0-9]+)(?![0-9])(?![,.][0-9])[ \t]*=[ \t]*(-?)([0-9]+)(?![0-9])(?![,.][0-9])(?![ \t]*[+\-*/][ \t]*[0-9])",
    re.ASCII,
)


def equations(text: str) -> Iterator[tuple[str, bool]]:
    """Every "A op B = C" of whole numbers, and whether it holds; parts of longer terms, grouped or decimal numbers don't count."""
    for m in _EQUATION.finditer(text):
        at = m.start()
        while at and text[at - 1] in " \t":
            at -= 1
        if at and text[at - 1] in "+-*/":
            continue
        a, op, b, c = int(m[1]), m[2], int(m[3]), int(m[4] + m[5])
        if op == "/" and (b == 0 or a % b):
            continue
        want = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a // b
        if max(a, b, abs(c), abs(want)) < 2**127:
            yield f"{a} {op} {b} = {c}", want == c


def arithmetic(text: str) -> tuple[str, str | None]:
    """The first equation that doesn't hold."""
    found = False
    for equation, holds in equations(text):
        found = True
        if not holds:
            return "fail", f"incorrect arithmetic: {equation}"
    return ("pass" if found else "skip"), None


def check_arithmetic(text: Column) -> Column:
    """In Python, as the numbers go up to 127 bits."""

    @F.pandas_udf("status string, reason string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([arithmetic(t or "") for t in texts], columns=["status", "reason"])

    return run(text)


SUITE = (
    ("non_empty", check_non_empty),
    ("repetition", check_repetition),
    ("arithmetic", check_arithmetic),
    ("json_balance", check_json),
    ("citations", check_citations),
    ("security_policy", check_forbidden),
)


def run_checks(docs: DataFrame, suite: tuple = SUITE) -> DataFrame:
    """id, place, check, status, reason of every check on every body; a null body is empty."""
    body = docs.select("id", F.coalesce("body", F.lit("")).alias("body"))
    wide = body.select("id", *[check(F.col("body")).alias(name) for name, check in suite])
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("check"), F.col(f"{name}.status").alias("status"), F.col(f"{name}.reason").alias("reason")) for i, (name, _) in enumerate(suite)])
    return wide.select("id", F.explode(rows).alias("r")).select("id", "r.*")
