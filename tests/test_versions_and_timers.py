"""Versioned tables over replays and broken writes; entries that timers forget."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftwood.sources.versions import VersionedTable
from driftwood.streaming import replica, writes


def held(df) -> list:
    return sorted(r["x"] for r in df.collect())


def make(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x bigint")


def test_replayed_batches_change_nothing_and_torn_writes_are_never_read(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.last_version() == 0
    assert t.commit(make(spark, 1, 2), 0)
    assert not t.commit(make(spark, 9), 0)
    # A write that broke off before its log row.
    make(spark, 7, 7, 7).write.parquet(f"file://{tmp_path}/t/version-2-batch-1")
    assert held(t.read()) == [1, 2]
    assert t.commit(t.read().unionByName(make(spark, 3)), 1)
    assert held(t.read()) == [1, 2, 3]
    assert held(VersionedTable(spark, t.path).read()) == [1, 2, 3] and t.log().count() == 2


def test_volatile_commits_survive_once_persisted(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(make(spark, 1), 0)
    t.commit(make(spark, 2), 1, durable=False)
    t.commit(make(spark, 3), 2, durable=False)
    assert held(t.read()) == [3] and held(t.read(survived=True)) == [1]
    t.persist()
    assert held(t.read(survived=True)) == [3]
    t.commit(make(spark, 4), 3, durable=False)
    assert held(t.read()) == [4] and held(t.read(survived=True)) == [3]


def test_stream_keeps_its_latest_state_over_a_restart(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    for i in range(2):
        make(spark, *range(10 * i, 10 * i + 5)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        df = spark.readStream.schema("x bigint").parquet(f"file://{tmp_path}/in").groupBy((F.col("x") % 2).alias("x")).agg(F.count("*").alias("n"))
        t.keep(df, f"file://{tmp_path}/checkpoint", every=None).awaitTermination()
        assert {r["x"]: r["n"] for r in t.read().collect()} == {0: [3, 6][i], 1: [2, 4][i]}
    assert t.last_version() == 2


def test_entries_are_forgotten_when_idle_or_quiet(spark, tmp_path):
    session = replica.store_session(spark)
    began = datetime(2024, 1, 1)
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "file bigint, kind string, at timestamp"

    def step(*events):
        """Events, and what is forgotten by the time of the last one; the watermark is the clock."""
        rows = [(f, k, began + timedelta(seconds=s)) for f, k, s in events]
        session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        df = session.readStream.schema(schema).parquet(source).withWatermark("at", "0 seconds")
        writes.forgotten(df, clock="eventTime").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["file"], r["reason"], r["writes"]) for r in session.read.parquet(out).collect())

    tick = lambda s: (99, "commit", s)  # noqa: E731  a file without an entry
    assert step((1, "write", 0), (1, "landed", 1), (2, "write", 0), (3, "write", 0), (3, "landed", 1), (4, "write", 0), (4, "landed", 1), tick(2)) == []
    assert step((3, "commit", 5), (4, "write", 13), (4, "landed", 14), tick(14)) == []
    assert step(tick(19)) == [(3, "quiet", 1)]  # ten seconds after its commit
    assert step(tick(25)) == [(1, "idle", 1), (3, "quiet", 1)]  # 2 is under way, 4 was written again
    assert step((2, "landed", 30), tick(32)) == [(1, "idle", 1), (2, "idle", 1), (3, "quiet", 1)]
    assert step(tick(40)) == [(1, "idle", 1), (2, "idle", 1), (3, "quiet", 1), (4, "idle", 2)]
    assert step((1, "write", 41), (1, "landed", 42), tick(70)) + step(tick(99)) != []
    assert sum(r[0] == 1 for r in step(tick(120))) == 2
