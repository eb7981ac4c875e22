"""Histograms of whole numbers with three significant digits, mergeable, in bounded memory.

A value below 2048 has a slot of its own; a larger one shares its slot with the values that have the same
eleven leading bits.  A slot is at most 1/1024 of its values wide, and a key has some 56,000 slots at
most whatever its number of values, so what is shuffled are counts that were combined before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading bits that a slot keeps: 2**10 slots for each power of two tell values 0.1 % apart.
BITS = 11


def _shift(value: Column) -> Column:
    return F.greatest(F.lit(0), F.char_length(F.bin(value)) - BITS).cast("int")


def slot(value: Column) -> Column:
    """The least value of a value's slot; null for null and negative values."""
    v = value.cast("bigint")
    shift = _shift(v)
    return F.when(v >= 0, F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift))


def highest(low: Column) -> Column:
    """The greatest value of the slot that begins at ``low``."""
    return low + F.call_function("shiftleft", F.lit(1).cast("bigint"), _shift(low)) - 1


def histogram(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, low, n): counts of the values of each slot; values that are null or negative have none."""
    return rows.select(key, slot(F.col(value)).alias("low")).where("low IS NOT NULL").groupBy(key, "low").agg(F.count("*").alias("n"))


def merge(key: str, *parts: DataFrame) -> DataFrame:
    """The histogram of the values of all parts."""
    return reduce(DataFrame.unionByName, parts).groupBy(key, "low").agg(F.sum("n").alias("n"))


def quantiles(counts: DataFrame, key: str, points: dict[str, float]) -> DataFrame:
    """(key, n_values, each of points, max): the highest value of the slot in which the values up to the
    point, at least one, end."""
    w = Window.partitionBy(key).orderBy("low")
    seen = counts.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy(key))})
    need = lambda p: F.greatest(F.lit(1), F.floor(F.col("total") * p + 0.5))
    top = highest(F.col("low"))
    at = lambda p: F.min(F.when(F.col("upto") >= need(p), top))
    return seen.groupBy(key).agg(F.max("total").alias("n_values"), *(at(p).alias(name) for name, p in points.items()), F.max(top).alias("max"))
