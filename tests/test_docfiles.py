import os

import pytest
from pyspark.sql import functions as F

from lorespark.sources import docfiles, files

DOC = "id string, doc_type string, title string, author string, body string, metadata map<string,string>, embedding array<float>, confidence int"
ROWS = [
    ("plain", "note", "A title", "ann", "a body\n\nwith lines\r\n", {"k": "v", "a:b\\c": "x\ny"}, [0.5, -1.0], 70),
    ("a/b%2F.c", "note", "", None, "", {}, None, 0),
    (".hidden", "t", "é\n\r\\n", None, "x: y\n\nz: w", {"": ""}, None, 100),
    ("_staged", "t", "t", None, "long " * 50_000, {"m": ""}, None, 1),
]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*[c.split()[0] for c in DOC.split(", ")]).collect())


def names(folder):
    return sorted(n for n in os.listdir(folder))


def test_round_trip_replace_overwrite_delete(spark, tmp_path):
    folder = f"{tmp_path}/docs"
    docfiles.save(spark.createDataFrame(ROWS, DOC).repartition(3), folder)
    got, bad = docfiles.load(spark, folder)
    assert rows_of(got) == sorted(ROWS) and bad.count() == 0
    assert names(folder) == ["%2Ehidden.doc", "%5Fstaged.doc", "a%2Fb%252F.c.doc", "plain.doc"]
    new = [("plain", "note", "B", None, "other", {}, None, 5), ("more", "note", "C", None, "more", {}, None, 5)]
    docfiles.save(spark.createDataFrame(new, DOC), f"file:{folder}")
    assert rows_of(docfiles.load(spark, folder)[0]) == sorted([*ROWS[1:], *new])
    docfiles.delete(spark.createDataFrame([("a/b%2F.c",), ("none",), (None,), ("",)], "id string"), folder)
    assert rows_of(docfiles.load(spark, folder)[0]) == sorted([*ROWS[2:], *new])
    docfiles.save(spark.createDataFrame(new[1:], DOC), folder, "overwrite")
    assert names(folder) == ["more.doc"]
    docfiles.save(spark.createDataFrame([], DOC), folder, "overwrite")
    assert names(folder) == [] and docfiles.load(spark, folder)[0].count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/docs"
    docfiles.save(spark.createDataFrame(ROWS[:1], DOC), folder)
    docfiles.register(spark)
    many = spark.range(40).repartition(4).select(F.concat(F.lit("d"), "id").alias("id"), F.when(F.col("id") != 33, "text").alias("content"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="needs an id and a content"):
            many.write.format(docfiles.NAME).mode(mode).save(folder)
    assert names(folder) == ["plain.doc"] and rows_of(docfiles.load(spark, folder)[0]) == ROWS[:1]


def test_parts_and_files_that_are_no_text(spark, tmp_path):
    for k in range(25):
        (tmp_path / f"f{k:02}.doc").write_text(f"title: {k}\n\nbody {k}")
    (tmp_path / "bad.doc").write_bytes(b"\xff\xfe")
    (tmp_path / "other.txt").write_text("no document")
    docfiles.register(spark)
    raw = spark.read.format(docfiles.NAME).option("partitionFiles", 10).load(str(tmp_path))
    assert raw.rdd.getNumPartitions() == 3 and raw.count() == 26
    good, bad = docfiles.load(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[-1] for r in bad.collect()] == ["bad.doc"]
    assert rows_of(good) == rows_of(files.read_documents(spark, str(tmp_path))[0])


def test_files_are_handed_to_threads_in_shares():
    handed, done = [], []

    class Counting(docfiles.ThreadPoolExecutor):
        def submit(self, *args, **kwargs):
            handed.append(args)
            return super().submit(*args, **kwargs)

    for n in (0, 1, 500):
        handed.clear(), done.clear()
        with Counting(docfiles.MOVERS) as movers:
            docfiles.each_of(movers, done.append, list(range(n)))
        assert sorted(done) == list(range(n)) and len(handed) <= docfiles.MOVERS
    with Counting(docfiles.MOVERS) as movers, pytest.raises(ZeroDivisionError):
        docfiles.each_of(movers, lambda i: 1 / i, [1, 0, 2])


def test_a_files_lines_are_read_once(spark):
    raw = spark.createDataFrame([("a", "type: x\ntype: y\nmeta.k: v\n\nbody")], "id string, content string")
    made = files.parse_documents(raw)
    assert (made.first()["doc_type"], made.first()["metadata"], made.first()["body"]) == ("y", {"k": "v"}, "body")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 3  # the lines once, and an embedding's numbers twice
