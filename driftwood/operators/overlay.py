"""A side store laid over the real tree: what shows, what is swept, what is evicted, its mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names kept out of the real tree.
SIDE_NAMES = (".DS_Store", ".fseventsd", ".Spotlight-V100", ".Trashes", ".TemporaryItems", ".metadata_never_index", ".hidden")
COMPANION = "._"
GRACE_SECONDS, MAX_BYTES, MAX_ROW = 60, 64 << 20, 1 << 20


def is_side_name(name: Column) -> Column:
    return name.isin(*SIDE_NAMES) | name.startswith(COMPANION)


def visible(real: DataFrame, side: DataFrame) -> DataFrame:
    """Entries (parent, name, origin): all real ones, and side rows whose name no real entry has."""
    shown = side.where(is_side_name(F.col("name"))).join(real.select("parent", "name"), ["parent", "name"], "left_anti")
    return real.select("parent", "name", F.lit("real").alias("origin")).unionByName(shown.select("parent", "name", F.lit("side").alias("origin")))


def orphans(real: DataFrame, side: DataFrame, now: int) -> DataFrame:
    """Side rows to sweep: the parent is gone, or a companion's anchor is and the row is old."""
    dirs = real.where("kind = 'dir'").select(F.col("ino").alias("parent")).unionByName(side.where("kind = 'dir'").select(F.col("ino").alias("parent"))).distinct().withColumn("has_parent", F.lit(True))
    anchors = real.select("parent", F.col("name").alias("anchor")).distinct().withColumn("has_anchor", F.lit(True))
    keyed = side.withColumn("anchor", F.when(F.col("name").startswith(COMPANION), F.expr("substring(name, 3)")))
    out = keyed.join(dirs, "parent", "left").join(anchors, ["parent", "anchor"], "left")
    lost = F.col("has_parent").isNull()
    alone = F.col("anchor").isNotNull() & F.col("has_anchor").isNull() & (F.lit(now) - F.col("mtime_sec") > GRACE_SECONDS)
    return out.where(lost | alone).select("parent", "name", F.when(lost, "parent").otherwise("anchor").alias("reason"))


def evict(side: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Oldest rows of each share that go until the rest fits."""
    w = Window.partitionBy("share").orderBy("mtime_sec", "parent", "name")
    before = F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("len").over(Window.partitionBy("share"))
    return side.withColumn("left", total - before).where(F.col("left") > max_bytes).select("share", "parent", "name", "len")


def create(side: DataFrame, asked: DataFrame) -> DataFrame:
    """Status of creations (parent, name, kind): only files and dirs with side names; one wins."""
    known = side.select("parent", "name", F.lit(True).alias("known"))
    rank = F.row_number().over(Window.partitionBy("parent", "name").orderBy("seq"))
    status = F.when(~F.col("kind").isin("file", "dir") | ~is_side_name(F.col("name")), "access").when(F.coalesce("known", F.lit(False)) | (F.col("rank") > 1), "exist").otherwise("ok")
    return asked.withColumn("rank", rank).join(known, ["parent", "name"], "left").select("parent", "name", "seq", status.alias("status"))


def remove(side: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows that are left after removing names; a real file takes its companion along."""
    names = asked.select("parent", "name").unionByName(asked.select("parent", F.concat(F.lit(COMPANION), "name").alias("name"))).distinct()
    return side.join(names, ["parent", "name"], "left_anti")


def write(data: Column, off: Column, put: Column) -> Column:
    """Bytes after a write at an offset, zeros in between; null if the row would be too large."""
    n = F.octet_length(data)
    zeros = F.to_binary(F.repeat(F.lit("00"), F.greatest(F.lit(0), off - n)), F.lit("hex"))
    end = off + F.octet_length(put)
    out = F.concat(F.substring(data, F.lit(1), off), zeros, put, F.substring(data, end + 1, F.greatest(F.lit(0), n - end)))
    return F.when(F.greatest(n, end) <= MAX_ROW, out)
