"""Clustering and whitening of vectors against plain versions in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.llm import kmeans, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"
ODD = [None, [], [0.5] * 63, [None] + [0.5] * 63, [float("nan")] + [0.5] * 63, [float("inf")] + [0.5] * 63]


def rows_of(seed: int, n: int, dims: int = 64):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, dims))
    x = middle[rng.integers(0, 6, n)] + 0.3 * rng.standard_normal((n, dims))
    x[n // 2 : n // 2 + 5] = x[0]  # ties
    return [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(x)]


def plain_kmeans(vectors: list[tuple[int, list[int]]], k: int, rounds: int):
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in vectors)
    centroids = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups: dict[int, list[list[int]]] = {}
        for _, x in vectors:
            groups.setdefault(near(x)[1], []).append(x)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else centroids[j] for j in range(len(centroids))]
    return [(i, *near(x)[::-1]) for i, x in vectors], centroids


@pytest.mark.parametrize(("n", "k", "rounds"), [(150, 8, 10), (5, 8, 3), (40, 3, 1)])
def test_clusters_against_all_distances(spark, n, k, rounds):
    rows = rows_of(n, n)
    df = spark.createDataFrame([*rows, *((1000 + i, v, 0) for i, v in enumerate(ODD))], SCHEMA).withColumns({"cluster": F.lit("clash"), "x": F.lit(1)}).repartition(3)
    whole = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v, _ in rows]
    want, centroids = plain_kmeans(whole, k, rounds)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = {j: sum(d for _, c, d in want if c == j) for j in range(len(centroids))}
    got = kmeans.clusters(df, k=k, rounds=rounds).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    assert all(r["centroid_sha256"] == hashes[r["cluster"]] and r["cluster_inertia"] == per[r["cluster"]] and r["inertia"] == sum(per.values()) for r in got)
    if n == 150:
        assert np.mean([r["compared"] for r in got]) < 0.6 * k  # most centroids are screened out


def test_clusters_of_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0] * 64, 0), (1, [1.0] * 64, 0), (1, [2.0] * 64, 0), (1, [2.0] * 64, 0)], SCHEMA)
    got = kmeans.clusters(df, k=2).collect()
    assert len(got) == 4 and len({r["cluster"] for r in got}) == 2 and {r["inertia"] for r in got} == {0}
    empty = kmeans.clusters(df.limit(0))
    assert empty.count() == 0 and empty.dtypes == kmeans.clusters(df).dtypes
    assert kmeans.clusters(df.where("vec_id IS NULL")).count() == 0
    with pytest.raises(Exception, match="too large"):
        kmeans.clusters(spark.createDataFrame([(1, [2e5] * 64, 0)], SCHEMA)).collect()


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(4)
    for scale in (3, 1000, 1 << 26):
        x, c = (rng.integers(-scale, scale, (n, 64)) for n in (300, 20))
        c[:5] = x[:5]
        bounds = kmeans.lower_bounds(*kmeans.compress(x, 8), *kmeans.compress(c, 8), 64)
        exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (bounds <= exact).all()
        who, best, _ = kmeans.nearest(x, *kmeans.compress(x, 8), c)
        assert (best == exact.min(axis=1)).all() and (who == exact.argmin(axis=1)).all()


def plain_whitening(vectors: np.ndarray, k: int):
    x = np.floor(1024 * vectors) + 100_000
    y = x - x.mean(axis=0)
    e, u = np.linalg.eigh(y.T @ y / len(y))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return x.astype(np.int64), y @ u / np.sqrt(e), e / (y * y).sum() * len(y)


@pytest.mark.parametrize(("passes", "spread"), [(0, 1.0), (4, 1.0), (8, 0.02)])
def test_whitening_against_the_whole_covariance(spark, passes, spread):
    rng = np.random.default_rng(passes)
    # Sixteen strong directions of falling strength, and noise of ``spread`` in all 64.
    x = rng.standard_normal((400, 16)) * 2.0 ** -np.arange(16) * 30 @ np.linalg.qr(rng.standard_normal((64, 16)))[0].T + spread * rng.standard_normal((400, 64))
    x = x.astype(np.float32)
    df = spark.createDataFrame([*((i, v.tolist(), 0) for i, v in enumerate(x)), *((1000 + i, v, 0) for i, v in enumerate(ODD))], SCHEMA).withColumns({"n": F.lit("clash"), "v": F.lit(2)}).repartition(3)
    got = whitening.whiten(df, passes=passes).toPandas().sort_values(["vec_id", "component"])
    whole, white, explained = plain_whitening(x.astype(float), 8)
    assert len(got) == 400 * 8 and (got["n"] == 400).all()
    assert got["deviation"].to_numpy()[::8].tolist() == ((400 * whole - whole.sum(axis=0)) ** 2).sum(axis=1).tolist()
    w = got["whitened"].to_numpy().reshape(400, 8)
    assert np.abs(w * np.sign((w * white).sum(axis=0)) - white).max() < 1e-7
    assert np.allclose(got["explained"].to_numpy()[:8], explained, rtol=1e-9)
    assert (got["identity_error"] < 1e-9).all()


def test_range_finder_stops_early_or_grows():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    steep, flat = (q * 10.0 ** -np.arange(64)) @ q.T, (q * np.linspace(2, 1, 64)) @ q.T
    for v, grows in ((steep, False), (flat, True)):
        e, u, full = whitening.leading(lambda b, v=v: v @ b, 64, 8)
        assert full == grows
        assert np.abs(v @ u - u * e).max() < 1e-12 and np.abs(u.T @ u - np.eye(8)).max() < 1e-12


def test_whitening_of_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (1, [3.0, 4.0], 0), (2, [9.0], 0), (3, [0.0, 0.0, 0.0], 0)], SCHEMA)
    got = whitening.whiten(df).collect()
    assert len(got) == 6 and {r["n"] for r in got} == {3}
    by = lambda c: sorted({(r["whitened"] is None, round(r["explained"], 6)) for r in got if r["component"] == c})
    assert by(1) == [(False, 1.0)] and by(2) == [(True, 0.0)]
    assert whitening.whiten(df.limit(0)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)).collect()
    assert {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in same} == {(None, 0.0, 0, 0.0)}
    big = whitening.whiten(spark.createDataFrame([(1, [1e8, 1.0], 0), (2, [-1e8, 1.0], 0)], SCHEMA)).collect()
    assert all(r["deviation"] is None for r in big) and abs(abs(big[0]["whitened"]) - 1) < 1e-9
