"""Centroid clustering of vectors in whole numbers, exact to the last unit.

Method: block-norm screening.  A vector is cut into ``BLOCKS`` segments; the sum of each segment and
the norm of what is left of it beside its mean are computed once and kept with the vector.  With the
same of a centroid they give a lower bound of the squared distance: a segment adds

    (difference of sums)^2 / length + (difference of norms)^2

of which the second part is the Cauchy-Schwarz inequality on the rests.  A row first gets the exact
distance to the centroid of its least bound; of the others only those whose bound does not exceed the
best distance so far get theirs.  Bounds are computed in doubles and lowered by more than their
rounding, so no nearest centroid is screened out, and equal distances are all compared.

A round is one pass over the vectors: each partition sums its vectors by centroid, and the sums, of
``k * (dims + 1)`` numbers, are added up by Spark.  Sums and distances are whole numbers throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, table
from ._vectors import matrices, totals, whole

DIMS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
BLOCKS = 8
#: Components are below this, so that a squared distance of 64 differences fits in 63 bits.
LIMIT = 1 << 27
#: What a bound is lowered by, relative to the squares it is made of.
SLACK = 1e-9

PACKED = "vec_id bigint, x binary, sums binary, rests binary"
ASSIGNED = "vec_id bigint, cluster int, distance bigint, compared int"


def compress(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of each segment, norm of the segment less its mean), one row a vector."""
    cuts = np.linspace(0, x.shape[1], blocks + 1).astype(int)
    sums, rests = np.zeros((len(x), blocks), np.int64), np.zeros((len(x), blocks))
    for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = x[:, lo:hi]
        sums[:, b] = part.sum(axis=1)
        rest = part - sums[:, b : b + 1] / max(1, hi - lo)
        rests[:, b] = np.sqrt((rest * rest).sum(axis=1))
    return sums, rests


def lower_bounds(sums: np.ndarray, rests: np.ndarray, c_sums: np.ndarray, c_rests: np.ndarray, dims: int) -> np.ndarray:
    """Lower bounds of squared distances, vectors by centroids."""
    cuts = np.linspace(0, dims, sums.shape[1] + 1).astype(int)
    length = np.maximum(1, np.diff(cuts)).astype(float)
    out = np.zeros((len(sums), len(c_sums)))
    for j in range(len(c_sums)):
        d, r = (sums - c_sums[j]).astype(float), rests - c_rests[j]
        # The norms' own rounding is relative to their size, not to that of their difference.
        size = (rests * rests + c_rests[j] * c_rests[j]).sum(axis=1)
        out[:, j] = (d * d / length).sum(axis=1) * (1 - SLACK) + (r * r).sum(axis=1) - SLACK * size
    return out


def nearest(x: np.ndarray, sums: np.ndarray, rests: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance, centroids compared exactly) of each row; ties to the smaller number."""
    bounds = lower_bounds(sums, rests, *compress(centroids, sums.shape[1]), x.shape[1])
    first = bounds.argmin(axis=1)
    d = x - centroids[first]
    best, who, compared = (d * d).sum(axis=1), first.copy(), np.ones(len(x), np.int32)
    for j in range(len(centroids)):
        m = np.flatnonzero((first != j) & (bounds[:, j] <= best))
        d = x[m] - centroids[j]
        d = (d * d).sum(axis=1)
        better = (d < best[m]) | ((d == best[m]) & (j < who[m]))
        best[m[better]], who[m[better]] = d[better], j
        compared[m] += 1
    return who, best, compared


def _pack_batches(dims: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at, v in matrices(batch, 1, dims):
                x = whole(v, LIMIT)
                sums, rests = compress(x, blocks)
                rows = [pa.array([r.tobytes() for r in c], pa.binary()) for c in (x.astype(np.int32), sums.astype(np.int32), rests)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *rows], ["vec_id", "x", "sums", "rests"])

    return run


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = lambda i, t: np.frombuffer(b"".join(batch.column(i).to_pylist()), t).reshape(batch.num_rows, -1)
    return read(1, np.int32).astype(np.int64), read(2, np.int32).astype(np.int64), read(3, np.float64)


def _slices(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        for a in range(0, batch.num_rows, 4096):
            yield batch.slice(a, 4096)


def _sum_by_centroid(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]:
    def emit(found: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in _slices(found):
            x, sums, rests = _unpack(batch)
            who, *_ = nearest(x, sums, rests, centroids)
            total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64) if total is None else total
            for j in np.unique(who):
                m = who == j
                total[j, 0] += int(m.sum())
                total[j, 1:] += x[m].sum(axis=0)
        return total

    return emit


def _assign_batches(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(found):
            if batch.num_rows:
                who, best, compared = nearest(*_unpack(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(best), pa.array(compared)], ["vec_id", "cluster", "distance", "compared"])

    return run


def clusters(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared), one row a kept vector.

    Kept are vectors of ``dims`` entries, all finite; others have no row.  Rows that share an id, or
    have none, each count; where ids that start a centroid repeat, the least vector comes first, and
    a row without id starts none.  Fewer kept rows with ids than ``k`` make fewer centroids; none, no
    rows.  ``compared`` is the number of centroids that got an exact distance in the last pass.
    A component of 131072 or more is an error, as distances would not fit in a long.
    """
    source = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("v"))
    packed = durable(source.mapInArrow(_pack_batches(dims, blocks), PACKED))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = packed.where("vec_id IS NOT NULL").select("x", order.alias("h")).orderBy("h", "x").limit(k).collect()  # k rows
    if not seeds:
        return _told(vectors.sparkSession.createDataFrame([], ASSIGNED), np.zeros((0, dims), np.int64))
    centroids = np.stack([np.frombuffer(bytes(r["x"]), np.int32) for r in seeds]).astype(np.int64)
    for _ in range(rounds):
        sums = totals(packed, _sum_by_centroid(centroids), exact=True)
        fresh = centroids.copy()
        for j in range(len(centroids)):
            count, *components = sums[j * (dims + 1) : (j + 1) * (dims + 1)]
            if count:
                fresh[j] = [s // count for s in components]
        if np.array_equal(fresh, centroids):
            break  # nothing moves any more, so the rounds that are left change nothing
        centroids = fresh
    return _told(durable(packed.mapInArrow(_assign_batches(centroids), ASSIGNED)), centroids)


def _told(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the sums of distances and the centroids' hashes, which are a row a centroid."""
    of = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    value = lambda told: F.element_at(F.array(*(F.lit(x) for x in told)), F.col("cluster") + 1) if told else F.lit(None)
    inertia = value([of.get(j, 0) for j in range(len(centroids))]).cast("bigint")
    hashes = value([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]).cast("string")
    return assigned.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(sum(of.values())).cast("bigint").alias("inertia"), hashes.alias("centroid_sha256"), "compared")


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("compared")


def oracle_sql(rounds: int = ROUNDS, k: int = CLUSTERS) -> str:
    """The rounds one after another, every distance in full, in DuckDB's dialect."""
    out = [
        f"""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS cluster, x AS c FROM v WHERE vec_id IS NOT NULL ORDER BY cluster LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, unnest(arg_min(struct_pack(cluster, distance), (distance, cluster))) FROM (SELECT row_number() OVER () AS n, * FROM v) JOIN LATERAL (SELECT cluster, {distance} AS distance FROM c{r}) ON true GROUP BY n, vec_id, x)")
        if r < rounds:
            mean = "((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::bigint"
            out.append(f"m{r} AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, {mean} AS m FROM (SELECT cluster, unnest(x)::hugeint AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))")
    return ",\n".join(out) + f"""
SELECT vec_id, cluster::int AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::bigint AS cluster_inertia, (sum(distance) OVER ())::bigint AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""

