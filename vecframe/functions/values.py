"""Metadata values: a long, a double or a string, tagged so that values of all kinds have one order."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, STRING = 0, 1, 2
VALUE = T.StructType([T.StructField("k", T.ByteType()), T.StructField("l", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())])
METADATA = T.MapType(T.StringType(), VALUE)
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", METADATA)])
LARGEST_ID = (1 << 31) - 1
_TYPE = "struct<k:tinyint,l:bigint,d:double,s:string>"


def rank_of(value: int | float | str) -> int:
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        raise ValueError(f"metadata values are integers, floats or strings, not {value!r}")
    return STRING if isinstance(value, str) else DOUBLE if isinstance(value, float) else LONG


def tagged(value: int | float | str) -> tuple:
    """A Python value as a row of VALUE."""
    k = rank_of(value)
    return k, value if k == LONG else None, value if k == DOUBLE else None, value if k == STRING else None


def untagged(value) -> int | float | str:
    return (value["l"], value["d"], value["s"])[value["k"]]


def literal(value: int | float | str) -> Column:
    k = rank_of(value)
    held = {LONG: "l", DOUBLE: "d", STRING: "s"}[k]
    parts = [F.lit(k).cast("tinyint").alias("k")] + [(F.lit(value) if n == held else F.lit(None)).cast(t).alias(n) for n, t in (("l", "bigint"), ("d", "double"), ("s", "string"))]
    return F.struct(*parts)


def column_value(column: Column, rank: int) -> Column:
    """A typed column as VALUE; null stays null."""
    parts = [F.lit(rank).cast("tinyint").alias("k")] + [(column if r == rank else F.lit(None)).cast(t).alias(n) for r, n, t in ((LONG, "l", "bigint"), (DOUBLE, "d", "double"), (STRING, "s", "string"))]
    return F.when(column.isNotNull(), F.struct(*parts))


def rank_of_type(kind: T.DataType) -> int | None:
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return LONG
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        return DOUBLE
    return STRING if isinstance(kind, T.StringType) else None


def metadata_from_json(column: Column) -> Column:
    """A JSON object as METADATA: integers are longs, other numbers doubles; any other value or text raises, null is no metadata."""
    values = F.from_json(column, "map<string,variant>", {"mode": "FAILFAST"})
    kind = lambda v: F.schema_of_variant(v)
    whole = lambda v: kind(v) == "BIGINT"
    broken = lambda v: kind(v).startswith("DECIMAL") | kind(v).isin("DOUBLE", "FLOAT")

    def convert(_, v):
        bad = F.raise_error(F.concat(F.lit("metadata values are integers, floats or strings, not "), kind(v)))
        k = F.when(whole(v), LONG).when(broken(v), DOUBLE).when(kind(v) == "STRING", STRING).otherwise(bad.cast("int"))
        return F.struct(
            k.cast("tinyint").alias("k"), F.when(whole(v), F.try_variant_get(v, "$", "bigint")).alias("l"), F.when(broken(v), F.try_variant_get(v, "$", "double")).alias("d"),
            F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).alias("s"),
        )

    return F.transform_values(values, convert)


def metadata_to_json(column: Column) -> Column:
    """METADATA as a JSON object in the order of the names; an empty or null map gives null."""
    inner = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    quoted = lambda x: inner(F.to_json(F.array(x)))
    text = lambda v: F.when(v["k"] == LONG, v["l"].cast("string")).when(v["k"] == DOUBLE, v["d"].cast("string")).otherwise(quoted(v["s"]))
    entries = F.transform(F.array_sort(F.map_keys(column)), lambda n: F.concat(quoted(n), F.lit(":"), text(F.element_at(column, n))))
    return F.when(F.size(column) > 0, F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))


def parse_record(text: str) -> dict:
    return {name: value for name, value in json.loads(text).items() if rank_of(value) >= 0}
