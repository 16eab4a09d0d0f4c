import random

import pytest

from lorespark.llm import decontaminate as D


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def edited(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        k = rng.randrange(len(s))
        op = rng.randrange(3)
        s[k:k + 1] = ["q"] if op == 0 else [] if op == 1 else [s[k], "q"]
    return "".join(s)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    items = [(k, text(rng, 30 + 10 * (k % 3))) for k in range(12)] + [(50, "tiny"), (51, None), (52, ""), (53, "twelve chars!"), (0, "again " + text(rng, 30))]
    docs, want = [], set()
    for i in range(120):
        body = text(rng, rng.randrange(5, 120))
        if i % 3 == 0:
            k = rng.randrange(12)
            at = rng.randrange(len(body))
            part = items[k][1] if i % 2 else items[k][1].upper().replace(" ", "\n  ")
            body = body[:at] + " " + edited(rng, part, i % 4) + " " + body[at:]
            want.add((i, k))
        docs.append((i, body))
    return docs, items, want


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [4 << 20, 800])
def test_planted_passages_are_found_and_others_left(spark, planted, block):
    docs, items, want = planted
    rows = D.find_leaks(*frames(spark, docs, items), block_chars=block).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    body = dict(docs)
    for r in rows:
        piece = body[r["doc_id"]][r["start"]:r["end"]]
        assert len(piece) >= 60 and r["distance"] <= 3


def distance(a, b):
    """Of a to the nearest part of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_equals_full_alignment_of_every_window(spark):
    rng = random.Random(4)
    item = text(rng, 20)[:63] + "x"
    docs = [(i, text(rng, 10) + " " + edited(rng, item, i % 9) + " " + text(rng, 10)) for i in range(60)]
    i = D.index([(1, item)])
    assert len(i.item) == 1 and i.edits[0] == 3
    got = {r["doc_id"]: r["distance"] for r in D.find_leaks(*frames(spark, docs, [(1, item)])).collect()}
    want = {d: distance(item, t) for d, t in docs}
    assert got == {d: n for d, n in want.items() if n <= 3}


def test_awkward_rows(spark, awkward, nothing):
    benchmark = spark.createDataFrame([(1, " ".join(f"common{i % 7}word{i}" for i in range(20, 60)), 5), (None, "w7919 w2916 w48 w7967 w4 and so on", 5), (2, None, None)], "item_id long, text string, doc_id long")
    rows = D.find_leaks(awkward, benchmark).collect()
    assert sorted((r["doc_id"] for r in rows if r["item_id"] == 1), key=str) == sorted([1, 2, 2, None, 9], key=str)
    rest = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))[500:600]
    named = spark.createDataFrame([(None, rest), (-1, "Short\n item"), (-1, "is not one")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in D.find_leaks(awkward, named).collect()] == [(6, None)]
    short = spark.createDataFrame([(1, " short ITEM"), (2, "a short item")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in D.find_leaks(short, named).collect()] == [(1, -1, 0)]
    left = D.remove_leaks(awkward, benchmark)
    assert left.columns == awkward.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([3, 4, 5, 6, 7, 7, 8, None], key=str)
    assert left.where("doc_id is null and text is not null").count() == 0
    assert D.find_leaks(nothing, benchmark).count() == 0 and D.find_leaks(awkward, benchmark.where("false")).count() == 0
    assert D.remove_leaks(nothing, benchmark).count() == 0 and D.remove_leaks(awkward, benchmark.where("false")).count() == awkward.count()


def test_every_quote_of_71_characters_is_found(spark):
    rng = random.Random(5)
    item = text(rng, 60)[:233].strip() + "é É"
    docs = [(at, text(rng, 9) + "\t" + item[at:at + 71].upper().replace(" ", " \n ") + text(rng, 9)) for at in range(0, len(item) - 70, 7)]
    rows = D.find_leaks(*frames(spark, docs, [(1, item)])).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in docs}
    body = dict(docs)
    for r in rows:
        assert r["distance"] == 0 and " ".join(body[r["doc_id"]][r["start"]:r["end"]].lower().split()) in item.lower()


def test_windows_that_hold_each_gram():
    rng = random.Random(6)
    i = D.index([(k, text(rng, 30)[:n]) for k, n in enumerate((12, 40, 63, 64, 65, 72, 130))])
    for place, first, n in zip(i.place.tolist(), i.first.tolist(), i.windows.tolist(), strict=True):
        own = [w for w in range(len(i.start)) if i.start[w] <= place and place + D.Q <= i.start[w] + i.size[w]]
        assert own == list(range(first, first + n))


def test_common_grams_do_not_part_bands(spark):
    item = "ab " * 40
    docs = [(1, "x " + item + " y"), (2, "ab " * 3000), (3, "ab " * 15 + "cd " * 60)]
    got = {r["doc_id"] for r in D.find_leaks(*frames(spark, docs, [(1, item)])).collect()}
    assert got == {1, 2}
