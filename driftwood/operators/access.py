"""Attributes as clients see them: access bits, wire attributes, requested and updated fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.functions.scalars import ftype

# Access bits.
READ, LOOKUP, MODIFY, EXTEND, DELETE, EXECUTE = 1, 2, 4, 8, 16, 32
U32 = 0xFFFFFFFF


def access_bits(kind: Column, mode: Column, requested: Column, writable: Column) -> Column:
    is_dir = kind == "dir"
    when = lambda c, bits: F.when(c, bits).otherwise(0)
    granted = when(mode.bitwiseAND(0o400) != 0, READ) + when(is_dir, LOOKUP) + when((mode.bitwiseAND(0o100) != 0) & ~is_dir, EXECUTE) + when(writable, MODIFY | EXTEND | DELETE)
    return granted.bitwiseAND(requested)


def wire_attrs(attrs: DataFrame) -> DataFrame:
    """Attributes of version 3: used bytes, device halves, access time from the modification's."""
    return attrs.select(
        "ino", ftype(F.col("kind")).alias("type"), "mode", "size", (F.col("blocks") * 512).alias("used"), F.shiftrightunsigned("rdev", 32).bitwiseAND(U32).alias("rdev_major"), F.col("rdev").bitwiseAND(U32).alias("rdev_minor"),
        F.col("mtime_sec").bitwiseAND(U32).alias("atime"), F.col("mtime_sec").bitwiseAND(U32).alias("mtime"), F.col("ctime_sec").bitwiseAND(U32).alias("ctime"),
    )


def requested_attrs(words: Column, supported: int) -> Column:
    """Ascending numbers of the attributes that are asked for and supported."""
    both = words.bitwiseAND(supported)
    return F.filter(F.lit(list(range(63))), lambda i: F.call_function("shiftrightunsigned", both, i).bitwiseAND(1) == 1)


def update(old: DataFrame, changes: DataFrame, fields: tuple[str, ...], key: str = "ino") -> DataFrame:
    """Only the fields that a change names are set."""
    new = changes.select(F.col(key).alias("__k"), *(F.col(f).alias(f"__{f}") for f in fields))
    out = old.join(new, F.col(key) == F.col("__k"), "left")
    return out.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop("__k", *(f"__{f}" for f in fields))


def squash(attrs: DataFrame, uid: int, gid: int) -> DataFrame:
    return attrs.withColumns({"uid": F.lit(uid), "gid": F.lit(gid)})
