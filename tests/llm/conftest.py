import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, shard int, slot long, key long, spans string, sequence_id long, "
COLUMNS += "predicted int, n_spans int, _n long, _block int, _ticket long, _place long, _spans string, _id long, _key long, _same string, _least string, _t string, text_key long, _group int, node long, class_id long, `a.b` string, `a b` string, `a``b` string, `c0_` int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing column names."""
    passage = " ".join(f"common{i % 7}word{i}" for i in range(70))
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    texts = [
        (1, f"{passage} first tail"), (2, f"other head {passage}"), (2, f"other head {passage}"), (3, None), (4, ""), (5, "   \n\t "),
        (None, f"{passage} without an id"), (None, None), (6, long), (7, "one two"), (7, "same id, other text"), (8, "é ß 日本 \u0000 \U0001f600 idiot!"), (9, passage),
    ]
    rows = [(i, t, None, None, None, 1.0, 0, 1, 1, 1, "x", 1, 1, 1, 2, 2, 2, 2, "s", 3, 3, "v", "w", "t", 4, 4, 5, 5, "dot", "blank", "tick", 6) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
