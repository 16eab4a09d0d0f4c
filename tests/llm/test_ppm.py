import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lorespark.llm import kernels as K
from lorespark.llm import ppm


def plain_model(texts, order):
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = bytes([ppm.END] * order) + t + bytes([ppm.END])
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k:i], s[i]] += 1
    nodes = [{} for _ in range(order + 1)]
    for k, c in enumerate(counts):
        for (ctx, sym), n in c.items():
            nodes[k].setdefault(ctx, {})[sym] = n
    return nodes


def plain_log10(nodes, order, context, symbol):
    out, refused = 0.0, set()
    for k in range(order, -1, -1):
        seen = nodes[k].get(context[order - k:])
        if seen is None:
            continue
        left = {s: n for s, n in seen.items() if s not in refused}
        if not left:
            continue
        total = sum(left.values()) + len(left)
        if symbol in left:
            return out + math.log10(left[symbol] / total)
        out += math.log10(len(left) / total)
        refused |= set(left)
    return out - math.log10(256 - len(refused))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcab d") for _ in range(rng.randrange(40))).encode() for _ in range(60)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    framed, first = ppm.framed(data, offsets, 3)
    keys = ppm.keys_at(framed, 3)
    own = keys[ppm._own(first, np.diff(offsets), 3, len(keys))]
    assert len(own) == len(data) + len(texts)
    return texts, spark.createDataFrame([(int(k), int(n)) for k, n in zip(*K.counted(own), strict=True)], "key long, n long")


def test_probabilities_equal_a_plain_model_and_sum_to_one(spark, model):
    texts, grams = model
    nodes = plain_model(texts, 3)
    contexts = (b"\xff\xff\xff", b"abc", b"zab", b"zzz", b"a d", b"\xff\xffd")
    keys = {int.from_bytes(c + bytes([s]), "big"): (c, s) for c in contexts for s in range(256)}
    got = {r["key"]: r["logp"] for r in ppm.log10_probabilities(spark.createDataFrame([(k,) for k in keys], "key long"), grams, 3).collect()}
    assert len(got) == len(keys)
    for k, (c, s) in keys.items():
        assert got[k] == pytest.approx(plain_log10(nodes, 3, c, s), abs=1e-9)
    for c in contexts:
        assert sum(10 ** got[k] for k, (own, _) in keys.items() if own == c) == pytest.approx(1)


def test_no_counts_give_the_uniform_model(spark, model):
    wanted = spark.createDataFrame([(7,), (300,)], "key long")
    assert [r["logp"] for r in ppm.log10_probabilities(wanted, model[1].limit(0), 3).collect()] == [pytest.approx(-math.log10(256))] * 2


def fields(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), n, round(base, 4)))
    return sorted(out)


@pytest.mark.parametrize("top", [5, 1 << 17])
def test_base_fields_equal_brute_force(spark, documents, top):
    docs = documents.select("doc_id", "text").repartition(3)
    rows = ppm.score(docs, top_words=top).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)
    want = fields([tuple(r) for r in docs.collect()])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert max(abs(g[5] - w[5]) for g, w in zip(got, want, strict=True)) < 1e-3
    assert sum(r["score"] for r in rows if r["held_out"]) < 0


@pytest.mark.parametrize("top", [0, 40, 1 << 20])
def test_score_is_the_texts_code_length(spark, documents, top):
    docs = documents.select("doc_id", "text").limit(40).repartition(2)
    held = [(r["doc_id"], (r["text"] or "")) for r in docs.collect()]
    low = {i: "".join(c.lower() if c.isascii() else c for c in t).encode() for i, t in held}
    nodes = plain_model([t for i, t in low.items() if zlib.crc32(str(i).encode()) % 10], 5)
    for r in ppm.score(docs, top_grams=top).collect()[::6]:
        s = bytes([255] * 5) + low[r["doc_id"]] + b"\xff"
        assert r["score"] == pytest.approx(sum(plain_log10(nodes, 5, s[i - 5:i], s[i]) for i in range(5, len(s))), rel=1e-9, abs=1e-9)


def test_awkward_rows(awkward, nothing):
    rows = ppm.score(awkward).collect()
    assert len(rows) == awkward.count() and all(r["score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert ppm.score(nothing).count() == 0
    alone = ppm.score(awkward.where("doc_id = 3")).collect()
    assert len(alone) == 1
