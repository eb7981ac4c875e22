"""Reports: status, checks, buckets of failures, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_bucket(line: Column) -> Column:
    """Class of a failed test's line; the order of the tests is their precedence."""
    return (
        F.when(line.rlike("tried '.*-[ug] "), "perm").when(line.rlike("tried 'l?chown"), "chown")
        .when(line.rlike("tried '(link|mkfifo|mknod|bind)|got (EOPNOTSUPP|ENOTSUP)"), "notsupp").when(line.contains("expected ENAMETOOLONG"), "ntl").otherwise("other")
    )


def freshness(observed: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Median time between observations that differ from the one before."""
    w = Window.partitionBy(key).orderBy(ts)
    changed = observed.withColumn("was", F.lag(value).over(w)).where(F.col("was").isNull() | (F.col("was") != F.col(value)))
    gaps = changed.withColumn("gap", F.col(ts) - F.lag(ts).over(w)).where("gap IS NOT NULL")
    return gaps.groupBy(key).agg(F.median("gap").alias("median_gap"), F.count("*").alias("changes"))


def status(rows: DataFrame) -> DataFrame:
    """A row for each machine: its shares in order, with totals."""
    return rows.groupBy("vm").agg(F.sort_array(F.collect_list(F.struct("share", "state", "nodes"))).alias("shares"), F.sum("nodes").alias("nodes"))


SEVERITY = {"ok": 0, "warn": 1, "fail": 2}


def doctor(checks: DataFrame) -> DataFrame:
    """Counts by result of (check, result), and the worst as an exit code."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("result")]
    return checks.agg(*(F.count_if(F.col("result") == r).alias(r) for r in SEVERITY), F.when(F.max(rank) == 2, 2).when(F.max(rank) == 1, 1).otherwise(0).alias("exit_code"))


def negotiate(rows: DataFrame, key: str, features: str) -> DataFrame:
    return rows.groupBy(key).agg(F.bit_and(features).alias("features"))
