import hashlib
import random
import re

import pytest

from lorespark.llm import queries, substring
from tests import oracle


def brute(rows, length):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k:k + length])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - length + 1):
                if least[tuple(w[k:k + length])] < i:
                    gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(9)}" for _ in range(rng.randrange(40, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"u{rng.randrange(5000)}" for _ in range(rng.randrange(30))]
            p = list(rng.choice(passages))
            a = rng.randrange(len(p))
            words += p[a // 3:]
            if rng.random() < 0.5 and words:
                words[rng.randrange(len(words))] = f"e{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    often = " ".join(passages[0] + passages[1])
    rows += [(n + 4, f"{often} head " * 3), (n + 5, f"tail {often} " * 5)]
    rows += [(n, "same " * 130), (n + 1, "same " * 90), (n + 2, rows[3][1]), (n + 3, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [1, 4096])
def test_equals_brute_force(spark, hot, monkeypatch):
    rows = corpus(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = substring.repeated_spans
    monkeypatch.setattr(substring, "repeated_spans", lambda d, length=50: plain(d, length, hot_rows=hot))
    assert found(substring.remove_repeats(docs)) == brute(rows, 50)


def test_equals_its_sql(spark, sf_dir):
    oracle.same(spark, oracle.connect(sf_dir), queries.op5_substring_dedup, queries.oracle_sql()["op5_substring_dedup"], sf_dir)


def test_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(substring.remove_repeats(awkward)) == brute(rows, 50)
    assert substring.remove_repeats(nothing).count() == 0
    left = substring.without_repeats(awkward)
    assert left.columns == awkward.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert {r["text"] for r in left.where("doc_id = 2").collect()} == {"other head"}


def test_automaton_matches_every_window():
    rng = random.Random(9)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    a = substring.Automaton()
    for i, t in enumerate(texts):
        a.add(t, i)
    a.finish()
    for t in [*texts, [rng.randrange(4) for _ in range(50)]]:
        want = [min((i for i, o in enumerate(texts) if any(o[j:j + 5] == t[k:k + 5] for j in range(len(o) - 4))), default=2**63 - 1) for k in range(len(t) - 4)]
        assert a.first_documents(t, 5) == want


@pytest.mark.parametrize("hot", [1, 20])
def test_a_hot_shard_makes_few_rows(spark, hot):
    """The edges of one passage in many documents: not a row for each of their windows."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(80)]
    texts = [[f"u{rng.randrange(99999)}" for _ in range(40)] + passage[i % 3:] + [f"v{rng.randrange(99999)}" for _ in range(40)] for i in range(200)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made, plain = [], substring._dealt
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substring, "_dealt", lambda runs, n: (made.append(runs.count()), plain(runs, n))[1])
        spans = substring.repeated_spans(docs, 50, hot_rows=hot).collect()
    gone = {i: set() for i, _ in rows}
    for s in spans:
        gone[s["doc_id"]].update(range(s["first"], s["stop"]))
    want = {i: n for i, _, n, _ in brute(rows, 50)}
    assert {i: len(g) for i, g in gone.items()} == want
    assert len(made) > 1 and max(made[1:]) < 2 * made[0]
