"""Filter trees as Catalyst predicates.

Filters have two values: a comparison with a missing field is false, its negation true. NOT is pushed down to the leaves, so
a positive leaf is a plain comparison and a negated one the inverse comparison or a null test; both reach the scan. Values
of different kinds compare by kind (long, double, string): on typed columns that is decided here, from the schema.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values
from .filters import BooleanOp, Comparison, Node, Not, parse

_OPS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
_INVERSE = {"=": "!=", "!=": "=", ">": "<=", "<=": ">", "<": ">=", ">=": "<"}
Leaf = Callable[[Comparison], tuple[Column | None, Column | None]]


def flat_leaf(df: DataFrame) -> Callable[[Comparison, str], tuple[Column, Column] | None]:
    """Leaves over ordinary typed columns: (comparison, column) or None for an unknown field."""
    kinds = {f.name: values.rank_of_type(f.dataType) for f in df.schema.fields}

    def leaf(node: Comparison, op: str):
        rank = kinds.get(node.field)
        if rank is None:
            return None
        column, other = F.col(f"`{node.field}`"), values.rank_of(node.value)
        if rank == other:
            typed = column.cast("double") if dict(df.dtypes)[node.field] in ("float",) or dict(df.dtypes)[node.field].startswith("decimal") else column
            return _OPS[op](typed, F.lit(node.value)), column
        low = op in ("<", "<=", "!=") if rank < other else op in (">", ">=", "!=")
        return (column.isNotNull() if low else F.lit(False)), column

    return leaf


def map_leaf(metadata: str = "metadata") -> Callable[[Comparison, str], tuple[Column, Column] | None]:
    """Leaves over a map of tagged values."""

    def leaf(node: Comparison, op: str):
        value = F.try_element_at(F.col(metadata), F.lit(node.field))
        return _OPS[op](value, values.literal(node.value)), value

    return leaf


def compile_tree(node: Node | None, leaf, negated: bool = False) -> Column:
    if node is None:
        return F.lit(negated)
    if isinstance(node, Not):
        return compile_tree(node.child, leaf, not negated)
    if isinstance(node, BooleanOp):
        left, right = (compile_tree(x, leaf, negated) for x in (node.left, node.right))
        return left & right if (node.op == "AND") != negated else left | right
    if node.op not in _OPS:
        raise ValueError(f"unsupported comparator {node.op}")
    found = leaf(node, _INVERSE[node.op] if negated else node.op)
    if found is None:
        return F.lit(negated)
    test, column = found
    return test | column.isNull() if negated else test


def matching(df: DataFrame, text: str, metadata: str | None = None, strict: bool = False) -> DataFrame:
    """The rows that pass a filter; an empty text passes all, a blank one none. ``metadata``: the map column, else typed columns."""
    if text == "":
        return df
    return df.where(compile_tree(parse(text, strict), map_leaf(metadata) if metadata else flat_leaf(df)))


def flag(df: DataFrame, text: str, metadata: str | None = None) -> Column:
    """The filter as a column of true and false only."""
    return F.coalesce(compile_tree(parse(text), map_leaf(metadata) if metadata else flat_leaf(df)), F.lit(False)) if text else F.lit(True)
