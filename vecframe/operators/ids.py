"""Sets of document ids as predicates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersection(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return a.select(id_col).join(b.select(id_col), id_col, "left_semi").distinct()


def union(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return a.select(id_col).union(b.select(id_col)).distinct()


def difference(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return a.select(id_col).join(b.select(id_col), id_col, "left_anti").distinct()


def ascending(a: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return a.select(id_col).distinct().orderBy(id_col)


def cardinality(a: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: n distinct ids, and size, the largest id plus one (0 without ids)."""
    return a.agg(F.count_distinct(id_col).alias("n"), (F.coalesce(F.max(id_col), F.lit(-1)) + 1).alias("size"))
