import json
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lorespark.functions.json_text import json_text, number
from lorespark.sources import files


def plain(x):
    if not math.isfinite(x):
        return "null"
    if x == int(x):
        return format(Decimal(repr(x)), "f").removesuffix(".0") if x else "0"
    return format(Decimal(repr(x)), "f")


def test_numbers_have_no_exponent(spark):
    values = [0.0, -0.0, 1.0, 100.0, 0.125, -0.5, 1e7, 12345678.9, 123456789012.25, 1e15, 1e16, 1.5e16, 1e21, 1.7e308, 1e-3, 9.5e-4, 1.25e-7, 2.5e-310, -3.7e-9, -2e9, float("nan"), float("inf"), -float("inf"), 1 / 3, 2 / 3e10, 1e6 / 7]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", number(F.col("v")).alias("t"))
    assert [r["t"] for r in df.collect()] == [plain(v) for v in values]
    tiny = spark.createDataFrame([(5e-324,)], "v double").select(number(F.col("v")).alias("t")).first()["t"]
    assert float(tiny) == 5e-324 and "E" not in tiny  # two digits, not the one that would do
    (r,) = spark.sql("select 7 as i, cast(9007199254740993 as bigint) as l, cast(0.1 as float) as f, cast(2.50 as decimal(9,2)) as d").select(*[number(F.col(c)).alias(c) for c in "ilfd"]).collect()
    assert tuple(r) == ("7", "9007199254740992", "0.10000000149011612", "2.5")


def test_rows_are_read_back(spark):
    text = "".join(map(chr, range(40))) + '"\\/é 漢😀\x7f'
    rows = [(1, text, [1.5, None], {"b": ["x", None], "a": []}, (True, None), None), (None, None, None, None, None, None), (2, "", [], {}, (False, "s"), None)]
    df = spark.createDataFrame(rows, "n long, `a.b ``c` string, l array<double>, m map<string,array<string>>, s struct<t:boolean,u:string>, z string").coalesce(1)
    lines = [r["value"] for r in files.json_lines(df).collect()]
    assert [json.loads(x) for x in lines] == [
        {"n": 1, "a.b `c": text, "l": [1.5, None], "m": {"a": [], "b": ["x", None]}, "s": {"t": True, "u": None}, "z": None},
        dict.fromkeys(("n", "a.b `c", "l", "m", "s", "z")),
        {"n": 2, "a.b `c": "", "l": [], "m": {}, "s": {"t": False, "u": "s"}, "z": None},
    ]
    assert lines[2] == '{"n":2,"a.b `c":"","l":[],"m":{},"s":{"t":false,"u":"s"},"z":null}'
    assert "\\u0001" in lines[0] and "\\n" in lines[0] and "\x7f" in lines[0]


def test_clashing_names_empty_tables_and_files(spark, tmp_path):
    df = spark.range(2).selectExpr("id", "id + 1 as id").coalesce(1)
    files.write_json(df, f"{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"id":0,"id":1}', '{"id":1,"id":2}']
    assert files.json_lines(df.where("false")).count() == 0
    with pytest.raises(TypeError):
        json_text(F.col("x"), spark.sql("select binary('a') as x").schema["x"].dataType)
