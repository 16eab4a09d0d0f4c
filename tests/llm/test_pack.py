import zlib

import numpy as np
import pytest

from lorespark.llm import pack
from lorespark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def held_up(rows, docs, tokenizer):
    """Each id in one piece; sequences gapless from 0 and no longer than the window."""
    texts = sorted((str(i), t or "") for i, t in docs)
    want = sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts)
    got, sequences = {}, {}
    for r in rows:
        got.setdefault(str(r["doc_id"]), []).append((r["start"], r["length"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(n for v in got.values() for _, n, _ in v) == sum(n for _, n in want)
    for v in sequences.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    return sequences


def test_documents_are_packed_tightly(documents, tokenizer):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    rows = pack.pack(documents.repartition(3), tokenizer_path()).collect()
    sequences = held_up(rows, docs, tokenizer)
    fill = sum(n for v in sequences.values() for _, n in v) / (2048 * len(sequences))
    assert fill > 0.97
    text = dict(docs)
    for r in rows[:200]:
        ids = np.array([*tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())


def test_awkward_rows(awkward, nothing, tokenizer):
    docs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    rows = pack.pack(awkward, tokenizer_path(), with_ids=True).collect()
    held_up(rows, docs, tokenizer)
    assert {(r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] in (3, 4, 5)} == {(1, 1)}
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert pack.pack(nothing, tokenizer_path()).count() == 0


def test_differencing():
    assert sorted(np.bincount(pack.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 513, 800)
    at = pack.fill(lengths)
    sums = np.bincount(at, weights=lengths)
    assert sums.max() <= 2048 and len(sums) <= lengths.sum() / 2048 * 1.01 + 2
    assert len(set(pack.fill(np.array([2000, 2000, 2000])).tolist())) == 3
    assert pack.fill(np.zeros(0, np.int64)).tolist() == []


def test_pieces_equal_the_tokenizer(tokenizer):
    import random

    import pyarrow as pa

    from lorespark.llm import kernels as K

    rng = random.Random(2)
    odd, plain = "aB cé'sDtÜß1²½ İ́ \x85\x1c\x0b　日本 Σ.,!?<|startoftext|>\n\t'll're😀ﬁª_-×÷ÀÞ", "abC ÉéßÜ×1290.,-!\n ñ"
    texts = ["".join(rng.choice(odd if i % 2 else plain) for _ in range(rng.randrange(40))) for i in range(1500)] + ["a<|startoftext|>b", "<|STARTOFTEXT|>", "don't'S I'LL", ""]
    data, offsets = K.column_bytes(pa.array(texts))
    flat, bounds = pack.Pieces(tokenizer).token_ids(data, offsets)
    for k, t in enumerate(texts):
        assert flat[bounds[k]:bounds[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_another_tokenizer_gets_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)} | {"?": 70_000}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(str(tmp_path / "t.json"))
    docs = spark.createDataFrame([(1, "w5 w69999 W5"), (2, "")], "doc_id long, text string")
    rows = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in pack.pack(docs, str(tmp_path / "t.json"), with_ids=True).collect()}
    assert rows == {1: [5, 69_999, 70_000, 1], 2: [1]}
