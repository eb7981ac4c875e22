"""The change feed as a Structured Streaming query, of one source or of several in one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators.feed import feed_lines, feed_match


def merged_records(sources: dict[str, DataFrame]) -> DataFrame:
    """Records of all sources with the name of theirs in ``source``.

    Each source keeps its own progress in the query's checkpoint, so one that is slow or silent holds
    up no other, and a restart goes on in each where it had come to.
    """
    if not sources:
        raise ValueError("no sources to merge")
    return reduce(DataFrame.unionByName, (df.withColumn("source", F.lit(name)) for name, df in sorted(sources.items())))


def feed_stream(records: DataFrame, prefix: str | None = None) -> DataFrame:
    """JSON lines of records (op, share, path, size), of those under a plain text prefix if given."""
    rows = records if prefix is None else records.where(feed_match(prefix, "path"))
    keep = ["source", "seq"] if "source" in rows.columns else ["seq"]
    return feed_lines(rows).select(*keep, F.col("line").alias("value"))
