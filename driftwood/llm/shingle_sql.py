"""Words and shingles as SQL expressions, for the operators that run without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import SPACES


BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """array<string> of the words of a text, lower-cased; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # Splitting at one blank is faster than at a pattern, and most texts allow it.
    plain = ~text.rlike("[\\x09-\\x0D]|\\x20\\x20")
    t = F.btrim(F.lower(text), F.lit(BLANKS))
    w = F.when(plain, F.split(t, " ")).otherwise(F.split(t, f"[{SPACES}]+"))
    return F.when(F.btrim(text, F.lit(BLANKS)) == "", F.lit([]).cast("array<string>")).otherwise(w)


def map_shingles(w: Column, token: Callable[[Column, Column], Column], k: int = 5) -> Column:
    """token(hash of the first word, 64-bit hash of the shingle) of each k-word shingle, in order.

    One to k-1 words have one shingle, the whole sequence; no words have none.
    """
    h = F.transform(w, lambda x: F.xxhash64(x))
    # The word hashes are made once, as the single element of an array that is then mapped.
    one = lambda a, x, i: token(x, F.xxhash64(x, *(F.get(a, i + j) for j in range(1, k))))
    per = F.transform(F.array(h), lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - k + 1, F.least(F.size(a), F.lit(1)))), lambda x, i: one(a, x, i)))
    return F.element_at(per, 1)


def shingle_hashes(w: Column, k: int = 5) -> Column:
    """array<bigint>: hashes of the k-word shingles of a word array, in order, repeats kept."""
    return map_shingles(w, lambda _, x: x, k)


def shingle_strings(w: Column, k: int = 5) -> Column:
    """array<string>: the distinct k-word shingles themselves."""
    per = F.transform(F.array(w), lambda a: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(a, i, k), " "))).otherwise(F.lit([]).cast("array<string>")))
    return F.array_distinct(F.element_at(per, 1))
