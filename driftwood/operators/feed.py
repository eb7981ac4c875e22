"""The change feed: JSON lines of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feed_lines(records: DataFrame) -> DataFrame:
    """A JSON line for each record that has one: op, share, path, and the size of a content record."""
    op = F.when(F.col("op") == "self_removed", "removed").otherwise(F.col("op"))
    body = F.struct(op.alias("op"), F.col("share").alias("share"), "path", F.when(F.col("op") == "content", F.col("size")).alias("size"))
    return records.where(~F.col("op").isin("overflow", "echo")).withColumn("line", F.to_json(body))


def feed_match(prefix: str, *paths: str) -> Column:
    """Whether any path begins with the prefix, as plain text; null paths don't."""
    out = F.lit(False)
    for p in paths:
        out = out | F.coalesce(F.col(p).startswith(prefix), F.lit(False))
    return out
