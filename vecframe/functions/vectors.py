"""Distances and reduced precision, as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES, TYPES = ("L2", "IP"), ("FLOAT32", "FLOAT16", "BFLOAT16")
#: Fraction bits, least exponent, and the least magnitude that overflows, of each reduced type.
_FORMATS = {"FLOAT16": (10, -14, 65520.0), "BFLOAT16": (7, -126, float(np.float32(3.3961775292304601e38)))}


def vector_literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def distance(space: str, vector: Column, query: Column) -> Column:
    """L2: the squared Euclidean distance. IP: 1 less the inner product. Both in double; ascending is nearer."""
    if space == "L2":
        terms = F.zip_with(vector, query, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    if space == "IP":
        return F.lit(1.0) - F.aggregate(F.zip_with(vector, query, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"space must be one of {SPACES}")


def normalized(vector: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def _rounded(x: Column, bits: int, least: int, over: float) -> Column:
    x = x.cast("double")
    exponent = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(least))
    unit = F.pow(F.lit(2.0), exponent - bits)
    inf = F.lit(float("inf"))
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == inf), x).when(F.abs(x) >= over, F.signum(x) * inf).otherwise(F.rint(x / unit) * unit)


def quantized(vector: Column, vector_type: str) -> Column:
    """Values rounded to the type, half to even, kept as floats."""
    if vector_type not in TYPES:
        raise ValueError(f"vector type must be one of {TYPES}")
    if vector_type == "FLOAT32":
        return F.transform(vector, lambda x: x.cast("float"))
    return F.transform(vector, lambda x: _rounded(x, *_FORMATS[vector_type]).cast("float"))


def quantized_list(vector, vector_type: str) -> list[float]:
    """The same for one vector on the driver."""
    x = np.asarray(vector, np.float32).astype(np.float64)
    if vector_type == "FLOAT32":
        return x.tolist()
    bits, least, over = _FORMATS[vector_type]
    safe = np.where((x == 0) | ~np.isfinite(x), 1.0, np.abs(x))
    unit = np.exp2(np.maximum(np.floor(np.log2(safe)), least) - bits)
    out = np.where((x == 0) | ~np.isfinite(x), x, np.rint(x / unit) * unit)
    return np.where(np.isfinite(x) & (np.abs(x) >= over), np.copysign(np.inf, x), out).tolist()
