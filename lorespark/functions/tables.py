"""Table functions for SQL: chunks and equations of a text, called by LATERAL.

    register(spark)
    spark.sql("SELECT d.doc_id, c.* FROM documents d, LATERAL text_chunks(d.text, how => 'adaptive', size => 400) c")

They run row by row in Python workers, with rows sent as Arrow batches; a null text has no rows. For very many
short texts there is ``equations_in``, a function of a column that takes whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lorespark.operators.corpus import CHUNKINGS, chunked, equations

EQUATION = StructType([StructField("at", IntegerType(), False), StructField("equation", StringType(), False), StructField("holds", BooleanType(), False)])
LIMITS = {"size": 1, "overlap": 0}  # the smallest values


def _is_text(name: str, given: AnalyzeArgument) -> None:
    if given.isTable or not isinstance(given.dataType, StringType) and given.dataType.typeName() != "void":
        raise ValueError(f"{name} must be a string")


def _constant(name: str, given: AnalyzeArgument | None, kind: type[DataType]) -> object:
    """The value of a named argument, or None where it is left out."""
    if given is None:
        return None
    if not given.isConstantExpression or not isinstance(given.dataType, kind):
        raise ValueError(f"{name} must be a constant of type {kind().simpleString()}")
    return given.value


class TextChunks:
    """text_chunks(text, how => 'recursive', size => 800, overlap => 0): at, chunk. Arguments are judged when the query is analyzed."""

    @staticmethod
    def analyze(text: AnalyzeArgument, how: AnalyzeArgument | None = None, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _is_text("text", text)
        way = _constant("how", how, StringType)
        if how is not None and way not in CHUNKINGS:
            raise ValueError(f"how must be one of {', '.join(sorted(CHUNKINGS))}")
        for name, given in (("size", size), ("overlap", overlap)):
            value = _constant(name, given, IntegerType)
            if given is not None and (value is None or value < LIMITS[name]):
                raise ValueError(f"{name} must be at least {LIMITS[name]}")
        return AnalyzeResult(StructType([StructField("at", IntegerType(), False), StructField("chunk", StringType(), False)]))

    def eval(self, text: str | None, how: str = "recursive", size: int = 800, overlap: int = 0) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunked(text, how, size, overlap))


class TextEquations:
    """text_equations(text): at, equation, holds, of every equation that the arithmetic check reads."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _is_text("text", text)
        return AnalyzeResult(EQUATION)

    def eval(self, text: str | None) -> Iterator[tuple[int, str, bool]]:
        for at, (equation, holds) in enumerate(equations(text or "")):
            yield at, equation, holds


@arrow_udf(ArrayType(EQUATION))
def equations_in(texts: pa.Array) -> pa.Array:
    """equations_in(text): the rows of text_equations as a list, made a batch at a time; a null text has an empty one."""
    ends, at, found, holds = [0], [], [], []
    for text in texts.to_pylist():
        for k, (equation, right) in enumerate(equations(text or "")):
            at.append(k)
            found.append(equation)
            holds.append(right)
        ends.append(len(at))
    rows = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(found, pa.string()), pa.array(holds, pa.bool_())], ["at", "equation", "holds"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udf.register("equations_in", equations_in)
    for name, function in (("text_chunks", TextChunks), ("text_equations", TextEquations)):
        spark.udtf.register(name, udtf(function, useArrow=True))
