import random
import string

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions import vectors as V
from lorespark.operators import corpus as C


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "stem"), [("queries", "query"), ("caches", "cache"), ("runs", "run"), ("schedulers", "scheduler"), ("class", "class"), ("status", "status"), ("does", "does"), ("sees", "sees"), ("kernel", "kernel")])
def test_stem(spark, word, stem):
    assert value(spark, T.s_stem(F.lit(word))) == stem


def test_tokens_and_hashes(spark):
    assert value(spark, T.tokens(F.lit("The Queries, of É x 日本語"))) == ["the", "query", "of", "日本語"]
    for text, digest in (("", 0x811C9DC5), ("a", 0xE40C292C), ("b", 0xE70C2DE5), ("foobar", 0xBF9CF968)):
        assert value(spark, V.fnv1a_32(F.lit(text))) == digest
    for text, digest in (("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")):
        assert value(spark, V.fnv1a_64(F.lit(text))) == digest


def test_cosine_edges(spark):
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, V.cosine(vec(1, 0), vec(1, 0))) == 1
    assert value(spark, V.cosine(vec(1, 0), vec(1))) == 0
    assert value(spark, V.cosine(vec(0, 0), vec(1, 1))) == 0
    assert value(spark, V.embedding_broken(vec(0, 0), 2)) and not value(spark, V.embedding_broken(vec(1, 0), 2))


def test_chunks(spark):
    assert value(spark, T.fixed_chunks(F.lit("abcdefg"), 3)) == ["abc", "def", "g"]
    assert value(spark, T.with_overlap(T.fixed_chunks(F.lit("abcdefghij"), 5), 2)) == ["abcde", "de fghij"]
    text = "One sentence here. Another one!\n\n" + "x" * 25 + " tail words follow"
    for size in (10, 30):
        assert all(len(c) <= size for c in C.recursive_chunks(text, size))
    assert C.adaptive_chunks("a\n\nb\n\n" + "c" * 9, 5) == ["a\n\nb", "c" * 9]


def test_summary_and_keywords(spark):
    assert value(spark, T.summarize(F.lit("Short."), 10)) == "Short."
    assert value(spark, T.summarize(F.lit("First one. Second is long"), 12)) == "First one.…"
    docs = spark.createDataFrame([("1", "kernel kernel kernel scheduler scheduler the that")], "id string, body string")
    assert [(r["word"], r["n"]) for r in C.keywords(docs, 2).orderBy("place").collect()] == [("kernel", 3), ("scheduler", 2)]


def test_classifiers(spark):
    assert value(spark, T.classify_label(F.lit("Allen Institute"))) == "organization"
    assert value(spark, T.classify_label(F.lit("Transformer"))) == "concept"
    assert value(spark, T.relation_for(F.lit("was created by"))) == "created_by"
    assert value(spark, T.max_hops(F.lit("what depends on the kernel"))) == 2
    assert value(spark, T.permits(F.lit("graph.*"), F.lit("graph.read"))) and not value(spark, T.permits(F.lit("a_b"), F.lit("axb")))


def balance(text):
    """Bracket balance, a character at a time."""
    text = text.strip()
    if text[:1] not in ("{", "["):
        return "skip", None
    waiting, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            escaped, quoted = c == "\\" and not escaped, escaped or c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            waiting.append("]" if c == "[" else "}")
        elif c in "]}":
            if not waiting:
                return "fail", "unbalanced closing delimiter"
            if waiting.pop() != c:
                return "fail", "mismatched closing delimiter"
    return ("fail", "unbalanced delimiters") if waiting else ("pass", None)


def test_json_balance(spark):
    deep = "[{" * 3000
    texts = ['{"a": [1]}', "[{]}", "plain", '{"a": "}"}', "}", "[1", '["open]', "", '[]"]\\', '["\\\\"]', '["\\""]', "{}]", "[" * 2048 + "]" * 2048, deep + "}]" * 3000, deep + "]", deep, '["' + '\\"' * 50000 + '"]']
    draw = random.Random(5)
    texts += ["[" + "".join(draw.choice('[]{}"\\x ') for _ in range(draw.randrange(12))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string").select("i", C.check_json(F.col("t")).alias("v")).collect()
    assert {r["i"]: (r["v"]["status"], r["v"]["reason"]) for r in rows} == dict(enumerate([balance(t) for t in texts] + [("skip", None)]))


@pytest.mark.parametrize(("text", "status"), [("2 + 2 = 5", "fail"), ("2 + 2 = 4", "pass"), ("-5 + 3 = -2", "skip"), ("1 + 2 * 3 = 7", "skip"), ("2 + 2 = 5 - 1", "skip"), ("1,000 + 1 = 1001", "skip"), ("2 + 2 = 4.5", "skip"), ("7 / 2 = 3", "skip"), ("8 / 2 = 4", "pass"), ("", "skip")])
def test_arithmetic(text, status):
    assert C.arithmetic(text)[0] == status


def test_checks(spark):
    status = lambda check, text: value(spark, check(F.lit(text)))["status"]
    assert status(C.check_non_empty, " \n") == "fail"
    assert status(C.check_citations, "see [2]\n[1] source") == "fail"
    assert status(C.check_citations, "see [1]\n[1] source") == "pass"
    assert status(C.check_citations, "none") == "skip"
    assert status(C.check_repetition, "go " * 10) == "fail"
    assert status(C.check_repetition, "buy buy now " * 4) == "fail"
    assert status(C.check_repetition, "yes yes") == "pass"
    assert status(C.check_forbidden, "my PASSWORD=x") == "fail"


def test_extraction(spark):
    docs = spark.createDataFrame([("1", "The Scheduler depends on Memory. Scheduler uses Memory. Acme Corp was created by Vaswani. Scheduler, alone")], "id string, body string")
    m = C.entity_mentions(docs).cache()
    nodes = {r["name"]: r for r in C.extracted_nodes(m).collect()}
    assert nodes["scheduler"]["confidence"] == 75 and nodes["scheduler"]["label"] == "Scheduler"
    assert nodes["acme corp"]["kind"] == "organization"
    edges = {(r["src"], r["dst"]): r["kind"] for r in C.extracted_edges(m).collect()}
    assert edges == {("scheduler", "memory"): "depends_on", ("acme corp", "vaswani"): "created_by"}
    known = spark.createDataFrame([("scheduler", "memory")], "src string, dst string")
    assert C.extracted_edges(m, known).count() == 1


def runs(sentence):
    """Entities and gaps, a word at a time."""
    out, run, gap = [], [], []
    for word in [*sentence.split(), None]:
        word = None if word is None else word.strip(string.punctuation)
        if word is not None and len(word) > 1 and word[0].isupper():
            run.append(word)
            continue
        while run and run[0] in C.LEADING_STOP_WORDS:
            run.pop(0)
        if run:
            out.append((" ".join(run), " ".join(gap) if out else ""))
            run, gap = [], []
        if word and out:
            gap.append(word.lower())
    return out


def test_entity_runs(spark):
    draw = random.Random(7)
    words = ["The", "A", "An", "Kernel", "(API)", "uses", "--", "É-Net,", "x", "B", "iOS", "Acme's", "It"]
    texts = ["", "The The", "The", "Kernel The", "-- Kernel", "Kernel The -- uses The API The", *[" ".join(draw.choice(words) for _ in range(draw.randrange(1, 14))) for _ in range(400)], "The " * 30000 + "Kernel", "Kernel " * 30000, "a" + "-" * 200000 + "b Kernel"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "id string, body string")
    found = {}
    for r in C.entity_mentions(docs).orderBy("id", "sentence", "at").collect():
        found.setdefault(r["id"], []).append((r["entity"], r["gap"]))
    assert found == {str(i): runs(t) for i, t in enumerate(texts) if runs(t)}


def test_edges_of_a_sentence_in_blocks(spark, monkeypatch):
    text = " uses ".join(f"E{(i * 7) % 23}x" for i in range(40))
    docs = spark.createDataFrame([("1", text), ("2", "Ab, Cd. Ab uses Cd")], "id string, body string")
    m = C.entity_mentions(docs).cache()
    whole = {tuple(r) for r in C.extracted_edges(m).collect()}
    monkeypatch.setattr(C, "PAIR_BLOCK", 3)
    assert {tuple(r) for r in C.extracted_edges(m).collect()} == whole
    assert len([e for e in whole if e[0] != "ab cd"]) == len({(a, b) for a, b, _ in whole}) >= 23 * 22 // 2


def test_extraction_and_json_stay_in_the_jvm(spark, sf_dir):
    from lorespark.queries import QUERIES

    for name in ("extract_nodes", "extract_edges", "verify_json"):
        assert "Python" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_garbage(spark):
    rows = [("a", "note", "t", "b", 10, {}, [1.0]), ("b", "note", "t", "b", 100, {}, [1.0]), ("c", "note", "x", "y", 90, {"expires": "2024-01-01"}, None), ("d", "note", "z", "y", 90, {"expires": "2099-01-01"}, [0.0]), ("e", "note", "q", "q", 1, {}, None)]
    docs = spark.createDataFrame(rows, "id string, doc_type string, title string, body string, confidence int, metadata map<string,string>, embedding array<double>")
    assert {(r["id"], r["reason"]) for r in C.garbage(docs, "2026-06-29", 5, 1).collect()} == {("a", "duplicate"), ("c", "expired"), ("d", "broken_embedding"), ("e", "low_confidence")}
    once = C.consolidate(docs.withColumn("body", F.repeat("body", 50)), 40)
    assert once.where("due").count() == 5 and C.consolidate(once.drop("due"), 40).where("due").count() == 0
