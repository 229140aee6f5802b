"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once; the top bits choose one of BINS bins and the rest is its value there. The hashes are
sorted together with one mark a bin, larger than any value, so the first entry of each bin is its minimum or, in an empty
bin, the mark. An empty bin takes the value of the first filled bin in its own random order of bins (optimal densification):
ATTEMPTS places of a fixed table, then the filled bin with the least hash of both numbers, which is a random choice too. The
low BITS bits of every bin are packed into 64-bit words. Two fingerprints agree in a bin by chance once in 2**BITS, and the
likeness is corrected for that.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS, BITS, WORDS, ATTEMPTS = 256, 8, 5, 6
#: Rows of a range of ids, at least, and ranges, about: at 100 TB a range is a window of some 500 MB, which sorts by spilling.
RANGE_ROWS, RANGES = 512, 200_000
#: Quantiles of the id, between which ranges are even.
QUANTILES = 64
_SHIFT = 63 - BINS.bit_length() + 1
_MASK = (1 << _SHIFT) - 1
_MARKS = [(j << _SHIFT) | _MASK for j in range(BINS)]


def _places() -> list[list[int]]:
    rng = random.Random(5)
    return [[rng.randrange(BINS) for _ in range(BINS)] for _ in range(ATTEMPTS)]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def shingle_hashes(text: Column) -> Column:
    """Hashes of the word shingles of a text; of a shorter text one, of all its words; of none, an empty array."""
    words = F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    run = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))))
    return _let(hashed, lambda w: F.when(F.size(w) >= WORDS, run(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.expr("cast(array() as array<bigint>)")))


def _filled(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK)) != F.lit(_MASK)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint, array<long>; null for a text without words."""
    bins = F.sort_array(F.concat(F.transform(shingle_hashes(text), lambda h: F.shiftrightunsigned(h, 1)), _longs(_MARKS)))
    first = _let(bins, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(F.get(s, i - 1), _SHIFT) != F.shiftright(x, _SHIFT))))

    def densified(f: Column) -> Column:
        def fill(have: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                tries = [F.get(f, F.get(F.expr("array(" + ",".join(map(str, p)) + ")"), j)) for p in _places()]
                rest = F.array_min(F.transform(have, lambda y: F.struct(F.xxhash64(F.shiftright(y, _SHIFT), j).alias("h"), y.alias("y"))))["y"]
                return F.when(_filled(x), x).otherwise(F.coalesce(*(F.when(_filled(t), t) for t in tries), rest))

            return F.when(F.size(have) > 0, F.transform(f, one))

        return _let(F.filter(f, _filled), fill)

    per = 64 // BITS
    part = lambda d, k: sum((F.shiftleft(F.get(d, k * per + i).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * i) for i in range(1, per)), F.get(d, k * per).bitwiseAND(F.lit((1 << BITS) - 1)))
    # the byte shifted highest may turn the sum negative, which is a bit pattern like any other; no two terms share a bit
    packed = lambda d: F.when(d.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), lambda k: part(d, k)))
    return _let(_let(first, densified), packed)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; texts without words are like each other only."""

    def differing(x: Column, y: Column) -> Column:
        v = x.bitwiseXOR(y)
        for step in (4, 2, 1):
            v = v.bitwiseOR(F.shiftrightunsigned(v, step))
        return F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101))).cast("int")

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (1 - apart / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(estimate)


def as_text(fp: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def _part(x: Column, low: Column, high: Column, parts: int) -> Column:
    """Which of so many even parts of [low, high] holds x, from the top down."""
    share = (high.cast("double") - x.cast("double")) / (high.cast("double") - low.cast("double") + 1.0)
    return F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1)).cast("long")


def ranges(rows: DataFrame, n: int) -> Column:
    """The number of a row's range by (o, th) descending, for columns o and th (a hash of the text) of ``n`` rows.

    Quantiles of o cut the rows, and even steps of o cut what lies between two quantiles; a value of o that spans quantiles, so
    that many rows have it, is cut by even steps of th.
    """
    steps = max(1, math.ceil(min(n / RANGE_ROWS, RANGES) / QUANTILES))
    found = rows.select(F.min("o").alias("a"), F.max("o").alias("z"), F.percentile_approx("o", [i / QUANTILES for i in range(1, QUANTILES)], 100 * QUANTILES).alias("q")).first()
    if found is None or found["a"] is None:
        return F.lit(0).cast("long")
    bounds = [found["a"], *found["q"], found["z"]]
    hot = sorted({x for x, y in zip(bounds, bounds[1:]) if x == y})
    cuts = sorted({*bounds, *hot, *(x - 1 for x in hot if x > -(1 << 63))})  # a cell holds the values over one cut up to the next
    cell = F.size(F.filter(_longs(cuts), lambda x: x < F.col("o")))
    low, high = (F.get(_longs(x), cell) for x in ([cuts[0], *cuts], [*cuts, cuts[-1]]))
    inner = _part(F.col("o"), low, high, steps)
    if hot:
        inner = F.when(F.array_contains(_longs(hot), F.col("o")), _part(F.col("th"), F.lit(-(1 << 63)), F.lit((1 << 63) - 1), steps * 4)).otherwise(inner)
    return (F.lit(len(cuts)) - cell).cast("long") * (steps * 4) + inner


def with_next(docs: DataFrame, add: str, value: Column, payload: list[str], order: list[str], number: Column) -> DataFrame:
    """Each row with ``next``, a struct of the payload of the row after it by ``order`` descending; after the last, the first.

    ``number`` ascends with that order, and equal numbers are a range. The first row of each range is copied to the end of the
    range before, so each range is a window of its own. ``add`` is a column of ``value``, computed once a row and copy.
    """
    rows = docs.withColumn("b", number)
    heads = rows.groupBy("b").agg(F.max(F.struct(*order)).alias("head"))
    heads = heads.withColumn("hb", F.col("b"))
    line = Window.orderBy("hb")  # one row a range
    heads = heads.withColumn("to", F.coalesce(F.lag("hb").over(line), F.max("hb").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("hb", "head", "to")
    found = (F.col("b") == F.col("hb")) & (F.struct(*order) == F.col("head"))
    copies = rows.join(F.broadcast(heads), found).dropDuplicates(["hb"])
    copies = copies.select(*docs.columns, F.col("to").alias("b"), F.lit(1).alias("copy"))
    window = Window.partitionBy("b").orderBy("copy", *(F.col(c).desc() for c in order))
    both = rows.select(*docs.columns, "b", F.lit(0).alias("copy")).union(copies).withColumn(add, value)
    return both.withColumn("next", F.lead(F.struct(*payload)).over(window)).where("copy = 0").drop("b", "copy")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fp, next): rows in descending order of id, ties by hash of the text; null ids come last."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    doc_id = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("o"), F.xxhash64(text).alias("th"))
    n = docs.count()
    return with_next(rows, "fp", fingerprint(F.col("text")), ["text", "fp"], ["o", "th"], ranges(rows, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the characters (rounded down) replaced by the first as many, or all, of the next
    row's in descending order of id, after the last the first. A null text is empty; a text without words has an empty
    fingerprint, like other such texts (1) and unlike any other (0). Repeated rows follow each other, null ids come last,
    other columns are ignored, an empty table gives no rows.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = edited_pairs(docs, id_col, text_col)
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
