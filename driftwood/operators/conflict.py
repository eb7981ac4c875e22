"""Two-sided changes: collisions, echo fences, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SECONDS, RING = 5.0, 1024


def micros(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def conflicts(touches: DataFrame, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Touches (share, node, side, us: microseconds, seq) less than ``seconds`` after the other
    side's last touch of the node."""
    w = Window.partitionBy("share", "node").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda side: F.last(F.when(F.col("side") == side, F.col("us")), ignorenulls=True).over(w)
    seen = touches.withColumn("other_us", F.when(F.col("side") == "guest", last("host")).otherwise(last("guest")))
    gap = F.col("us") - F.col("other_us")
    return seen.where(gap < int(seconds * 1e6)).withColumn("kind", F.when(F.col("side") == "guest", "guest-over-host").otherwise("host-over-guest"))


def echo_fence(touches: DataFrame, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Touches without the guest's that echo a host write of less than ``seconds`` before."""
    w = Window.partitionBy("share", "node").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    host = F.last(F.when(F.col("side") == "host", F.col("us")), ignorenulls=True).over(w)
    echo = (F.col("side") == "guest") & (F.col("us") - host < int(seconds * 1e6))
    return touches.withColumn("echo", F.coalesce(echo, F.lit(False))).where("not echo").drop("echo")


def report(found: DataFrame, ring: int = RING) -> DataFrame:
    """The last ``ring`` conflicts of each share, with the total."""
    total = F.count("*").over(Window.partitionBy("share"))
    rank = F.row_number().over(Window.partitionBy("share").orderBy(F.desc("us"), F.desc("seq")))
    return found.withColumns({"total": total, "rank": rank}).where(F.col("rank") <= ring)
