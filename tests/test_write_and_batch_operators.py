"""Packing of batches, overlays of writes and histograms against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import cas, histogram, journal, lease


def plain_batches(sizes: list[int], records: int, max_bytes: int) -> list[tuple[int, int, int]]:
    out, first, n, total = [], 1, 0, 0
    for i, s in enumerate(sizes, 1):
        n, total = n + 1, total + s
        if n == records or total >= max_bytes:
            out.append((first, n, total))
            first, n, total = i + 1, 0, 0
    return out + ([(first, n, total)] if n else [])


@pytest.mark.parametrize(("records", "max_bytes", "block"), [(5, 200, 7), (16, 500, 16), (3, 10_000, 64), (8, 1, 8), (7, 333, 1000)])
def test_batches_against_greedy_packing(spark, records, max_bytes, block):
    rng = random.Random(records)
    names = {s: [("created", "n" * rng.randrange(1, 120)) for _ in range(n)] for s, n in ((0, 150), (1, 1), (2, 64))}
    df = spark.createDataFrame([(s, 10 * i + 3, op, n) for s, rows in names.items() for i, (op, n) in enumerate(rows)], "share bigint, seq bigint, op string, name string").repartition(3)
    got: dict[int, list] = {}
    for r in journal.micro_batches(df, records, max_bytes, block).orderBy("share", "batch").collect():
        assert r["batch"] == len(got.setdefault(r["share"], []))
        got[r["share"]].append((r["first_seq"], r["n"], r["bytes"]))
    assert got == {s: plain_batches([48 + len(n) for _, n in rows], records, max_bytes) for s, rows in names.items()}
    assert journal.micro_batches(df.limit(0), records, max_bytes, block).count() == 0


@pytest.mark.parametrize(("bucket", "salts"), [(8, 1), (8, 4), (64, 3), (1 << 16, 16)])
def test_overlay_against_bytes(spark, bucket, salts):
    rng = random.Random(bucket + salts)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows, want = [], {}
    for arrival in range(300):
        f, off, n = rng.choice([1, 1, 1, 2, 3]), rng.randrange(200), rng.randrange(0, 30)
        data = "".join(rng.choices(letters, k=n))
        rows.append((f, arrival, off, n, data))
        for i, c in enumerate(data):
            want[f, off + i] = (c, arrival)
    df = spark.createDataFrame(rows, "file bigint, arrival bigint, off bigint, len bigint, data string").repartition(4)
    got, segments = {}, cas.overlay_bytes(cas.write_overlay(df, bucket, salts), df).collect()
    for r in segments:
        for i, c in enumerate(r["bytes"]):
            assert (r["file"], r["start"] + i) not in got
            got[r["file"], r["start"] + i] = (c, r["arrival"])
    assert got == want
    ends = {(r["file"], r["arrival"], r["end"]) for r in segments}
    assert not any((r["file"], r["arrival"], r["start"]) in ends for r in segments)  # nothing is left cut
    assert cas.write_overlay(df.limit(0), bucket, salts).count() == 0


def test_histogram_is_within_a_thousandth_and_merges(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(0, 3000, 500), (10 ** (rng.random(3000) * 15)).astype(np.int64), [0, 2047, 2048, 2**40 - 1, 2**40, 2**62]])
    df = spark.createDataFrame([(int(v) % 2, int(v)) for v in values] + [(0, None), (1, -5)], "k bigint, v bigint")
    points = {f"p{i}": i / 100 for i in (0, 1, 25, 50, 90, 99, 100)}
    once = histogram.histogram(df, "k", "v")
    parts = histogram.merge("k", *(histogram.histogram(df.where(F.pmod(F.coalesce("v", F.lit(0)), F.lit(3)) == i), "k", "v") for i in range(3)))
    got = {r["k"]: r.asDict() for r in histogram.quantiles(once, "k", points).collect()}
    assert got == {r["k"]: r.asDict() for r in histogram.quantiles(parts, "k", points).collect()}
    for k in (0, 1):
        own = np.sort(values[values % 2 == k])
        assert got[k]["n_values"] == len(own)
        for name, p in points.items():
            exact = int(own[max(1, int(len(own) * p + 0.5)) - 1])
            assert exact <= got[k][name] <= exact * 1.001
    plan = histogram.quantiles(once, "k", points)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SortAggregate" not in plan


def test_unstable_writes_grow_and_move_on(spark):
    w = spark.createDataFrame([(1, 1, 0, 5, 10), (1, 2, 20, 5, 10), (1, 3, 0, 1, 7), (2, 1, 0, 1, 1)], "file bigint, arrival bigint, off bigint, len bigint, us bigint")
    z = spark.createDataFrame([(1, 9, 10_000)], "file bigint, size bigint, mtime_ns bigint")
    got = sorted((r["arrival"], r["size"], r["mtime_ns"]) for r in cas.unstable_writes(w, z).collect())
    assert got == [(1, 9, 10_001), (2, 25, 10_002), (3, 25, 10_003)]


def plain_leases(events: list[tuple], cap: int) -> list[tuple]:
    held: dict[int, int | None] = {}
    out = []
    for node, seq, us, kind, may, bound in events:
        effect, latency = "none", None
        if kind == "open" and may and node not in held:
            effect = "granted" if len(held) < cap else "refused"
            if effect == "granted":
                held[node] = None
        elif kind == "return" and node in held:
            effect, at = "returned", held.pop(node)
            latency = None if at is None else us - at
        elif kind == "inval" and node in held and held[node] is None:
            effect = "recalled" if bound else "revoked"
            if bound:
                held[node] = us
            else:
                del held[node]
        out.append((seq, node, effect, latency))
    return out


@pytest.mark.parametrize(("cap", "block", "busy"), [(3, 10, 30), (6, 25, 12), (1000, 10, 30), (5, 1000, 30)])
def test_leases_under_a_cap(spark, cap, block, busy):
    rng = random.Random(cap)
    rows = []
    for seq in range(300):
        calm = seq % 100 < 50  # few nodes, so that runs with and without the cap take turns
        kind = rng.choice(["open", "open", "inval", "return"])
        rows.append((rng.randrange(2 if calm else busy), seq, 1000 * seq, kind, rng.random() < 0.8, rng.random() < 0.7))
    df = spark.createDataFrame(rows, "node bigint, seq bigint, us bigint, kind string, may boolean, bound boolean").repartition(3)
    got = lease.admission(df, cap, block).orderBy("seq").collect()
    assert [(r["seq"], r["node"], r["effect"], r["latency_us"]) for r in got] == plain_leases(rows, cap)
    assert lease.admission(df.limit(0), cap, block).count() == 0
