"""Connected components by hooking and pointer jumping, all on DataFrames.

Each round every class takes the least label among its neighbours' (a minimum with map-side
combine, so a hub that holds a third of all links meets in no single task), then labels are
followed twice.  Rounds grow with the logarithm of the longest path.  State is cut through the
shared checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import durable

#: Links of a partition, and so many at most that labels (of two numbers each) are broadcast.
PART_ROWS, BROADCAST_LINKS = 200_000, 1_000_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, copy: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """(id, component) for every id that stands in a link to another; the least id names a class.

    Links with a null end or to themselves are left out; repeats don't matter; no links, no rows.
    ``copy`` cuts lineages.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    e = copy(e)
    links = e.count()
    # Small frames are held in few partitions and sent whole; larger ones are joined by shuffles.
    parts = -(-links // PART_ROWS) or 1
    few = parts < int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = lambda df: copy(df.coalesce(parts) if few else df)
    side = lambda df: F.broadcast(df) if links <= BROADCAST_LINKS else df
    e = e.coalesce(parts) if few else e
    # Each id with the least neighbour or itself: a forest whose parents are never larger.
    up = e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("p")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("p"))).groupBy("id").agg(F.min("p").alias("p"))
    up = held(up)
    for _ in range(max_rounds):
        # Follow labels to the end of what is known.
        jumped = up.alias("x").join(side(up).alias("y"), F.col("x.p") == F.col("y.id")).select(F.col("x.id").alias("id"), F.col("y.p").alias("p"), (F.col("y.p") != F.col("x.p")).alias("moved"))
        jumped = held(jumped)
        moving = not jumped.where("moved").isEmpty()
        up = jumped.select("id", "p")
        if moving:
            continue
        # All trees are stars; hook roots over links between different stars.
        roots = e.join(side(up.select(F.col("id").alias("a"), F.col("p").alias("ra"))), "a").join(side(up.select(F.col("id").alias("b"), F.col("p").alias("rb"))), "b")
        hooks = roots.where("ra != rb").select(F.greatest("ra", "rb").alias("id"), F.least("ra", "rb").alias("q")).groupBy("id").agg(F.min("q").alias("q"))
        hooks = held(hooks)
        if hooks.isEmpty():
            return up.select("id", F.col("p").alias("component"))
        up = held(up.join(side(hooks), "id", "left").select("id", F.coalesce("q", "p").alias("p")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
