"""JSON text of any column, derived from its type, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, MapType, NullType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_LONG = {chr(k): f"\\u{k:04x}" for k in range(32) if chr(k) not in _SHORT}


def quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters are escaped, all else stays."""

    def put(value: Column, table: dict[str, str]) -> Column:
        return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), table.items(), value)

    short = put(text, _SHORT)
    rare = F.rlike(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return F.concat(F.lit('"'), F.when(rare, put(short, _LONG)).otherwise(short), F.lit('"'))


def number(value: Column) -> Column:
    """A JSON number of the value as a double: null where it is not finite, whole numbers without a fraction, never an exponent.

    The digits are the JVM's: the fewest that read back as the same double, but at least two (5e-324 has 49 at its end).
    """
    v = value.cast("double")
    plain = F.abs(v).cast("string")
    digits = F.replace(F.regexp_replace(plain, r"(\.0)?E.*$", ""), F.lit("."), F.lit(""))
    power = F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int")
    large = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    unsigned = F.when(power.isNull(), F.regexp_replace(plain, r"\.0$", "")).when(power >= 0, large).otherwise(small)
    signed = F.when(v < 0, F.concat(F.lit("-"), unsigned)).otherwise(unsigned)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit("null")).otherwise(signed)


def json_text(value: Column, kind: DataType) -> Column:
    """The JSON text of a value of this type; null is ``null``.

    Fields keep their order; a map's keys are in order. Dates and times are text as
    Spark casts them. Other types (binary, intervals, variants) have no JSON text here and raise a TypeError.
    """
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit("," if k else ""), quoted(F.lit(f.name)), F.lit(":"), json_text(value.getField(f.name), f.dataType)) for k, f in enumerate(kind.fields)]
        made = F.when(value.isNotNull(), F.concat(F.lit("{"), *fields, F.lit("}")))
    elif isinstance(kind, ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        pair = lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), json_text(e["value"], kind.valueType))
        in_order = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("key"), F.element_at(value, k).alias("value")))
        made = F.concat(F.lit("{"), F.array_join(F.transform(in_order, pair), ","), F.lit("}"))
    elif isinstance(kind, BooleanType | NullType):
        made = value.cast("string")
    elif isinstance(kind, NumericType):
        made = number(value)
    elif isinstance(kind, StringType | DateType | TimestampType | TimestampNTZType):
        made = quoted(value.cast("string"))
    else:
        raise TypeError(f"no JSON text for {kind.simpleString()}")
    return F.coalesce(made, F.lit("null"))
