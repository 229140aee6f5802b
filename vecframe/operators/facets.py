"""Facets of metadata: counts of string values and ranges of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values


def _entries(df: DataFrame, metadata: str | None, fields: list[str] | None) -> DataFrame:
    """(field, value) rows; typed columns become tagged values, so that one aggregation serves both layouts."""
    if metadata:
        return df.select(F.explode(metadata).alias("field", "value"))
    kinds = {f.name: values.rank_of_type(f.dataType) for f in df.schema.fields}
    chosen = [n for n in (fields or kinds) if kinds.get(n) is not None]
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), values.column_value(F.col(f"`{n}`"), kinds[n]).alias("value")) for n in chosen))
    return df.select(F.explode(pairs).alias("e")).select("e.field", "e.value").where("value is not null")


def facet_counts(df: DataFrame, metadata: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """(field, value, n) of every string value."""
    rows = _entries(df, metadata, fields).where(F.col("value.k") == values.STRING)
    return rows.groupBy("field", F.col("value.s").alias("value")).agg(F.count("*").alias("n"))


def facet_ranges(df: DataFrame, metadata: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """(field, low, high) of every numeric field, longs and doubles together, cut to whole numbers toward zero."""
    number = F.when(F.col("value.k") == values.LONG, F.col("value.l")).otherwise(F.col("value.d").try_cast("bigint"))
    return _entries(df, metadata, fields).where(F.col("value.k") != values.STRING).groupBy("field").agg(F.min(number).alias("low"), F.max(number).alias("high"))
