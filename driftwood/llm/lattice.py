"""Near-duplicate vectors by lattice hashing.

Method: each table projects unit vectors by a random matrix to eight dimensions and decodes them to
the nearest point of the lattice E8.  A vector is indexed in its cell and searches its cell and the
neighbouring cells, nearest first (the lattice's 240 shortest vectors lead to them).  Pairs that
meet in any table are verified by cosine in double precision.

Equal vectors are one class: they share cells, are verified once and never expanded into pairs.
A class is named by its least id and a hash of its vector, as ids may repeat with other vectors.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, release, table
from ._hashing import mix
from .components import connected_components

MIN_COSINE = 0.95
TABLES, PROBES, SCALE, SEED = 8, 8, 1.2, 11
_ROWS = 2048
#: Name of a class; the least name of a component begins with its least id.
_NAME = "struct<vec_id:bigint,hash:bigint>"


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 (rows), doubled so that they are whole numbers."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        off = y - r
        odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) % 2)
        k = np.abs(off[odd]).argmax(axis=1)
        r[odd, k] += np.where(off[odd, k] < 0, -1, 1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


@functools.cache
def short_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    whole = [v for i, j in itertools.combinations(range(8), 2) for s, t in itertools.product((2, -2), repeat=2) for v in [[0] * 8] if not (v.__setitem__(i, s) or v.__setitem__(j, t))]
    half = [v for v in itertools.product((1, -1), repeat=8) if np.prod(v) == 1]
    return np.array([*whole, *half], dtype=np.int64)


def _keys(points: np.ndarray, number: int) -> np.ndarray:
    h = np.full(points.shape[:-1], number + 1, np.uint64)
    for j in range(8):
        h = mix(h * np.uint64(31) + points[..., j].astype(np.uint64))
    return h.view(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(own cell of each vector and table, probed cells of each vector, table and rank)."""
    rng = np.random.default_rng(seed)
    own, probed, short = [], [], short_vectors()
    for t in range(tables):
        y = unit @ (rng.standard_normal((unit.shape[1], 8)) * scale)
        p = decode_e8(y)
        near = np.argpartition(-((y - p / 2) @ short.T), probes - 1, axis=1)[:, : probes - 1]
        own.append(_keys(p, t))
        probed.append(np.concatenate((own[-1][:, None], _keys(p[:, None, :] + short[near], t)), axis=1))
    return np.stack(own, axis=1), np.stack(probed, axis=1)


def _cell_batches(tables: int, probes: int, scale: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    x = np.array(part.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), d)
                    x /= np.abs(x).max(axis=1)[:, None]
                    x /= np.sqrt((x * x).sum(axis=1))[:, None]
                    own, probed = cells(x, tables, probes, scale, seed)
                    ids = part.column(0).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(list(own), pa.list_(pa.int64())), pa.array(list(probed.reshape(len(at), -1)), pa.list_(pa.int64()))], ["id", "own", "probed"])

    return run


def _cosine_batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        keep = np.zeros(batch.num_rows, bool)
        for a in range(0, batch.num_rows, _ROWS):
            u, v = (batch.column(i).slice(a, _ROWS) for i in (2, 3))
            n, m = (c.value_lengths().to_numpy(zero_copy_only=False) for c in (u, v))
            for d in np.unique(n[n == m]):
                at = np.flatnonzero((n == d) & (m == d))
                x, y = (np.array(c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), d) for c in (u, v))
                x, y = (z / np.abs(z).max(axis=1)[:, None] for z in (x, y))
                cos = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                keep[a + at] = cos >= MIN_COSINE
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])


def usable(v) -> F.Column:
    """A vector that can have a cosine: not null, not empty, all components finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Null, zero or non-finite vectors link with nothing; vectors of different lengths don't link.
    Equal vectors link, and each counts.  A row without id stays with itself (component null,
    kept); rows that share an id count as vectors of their own, whether theirs are equal or not.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    good = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = durable(good.groupBy("h1", "h2").agg(F.struct(F.min("vec_id").cast("bigint").alias("vec_id"), F.col("h1").alias("hash")).alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    # The representative's vector stands for the class.
    hashed = durable(classes.select("rep", "v").mapInArrow(_cell_batches(tables, probes, scale, seed), f"id {_NAME}, own array<bigint>, probed array<bigint>"))
    u, v = classes.select(F.col("rep").alias("a"), F.col("v").alias("u")), classes.select(F.col("rep").alias("b"), "v")
    # Table by table, so that no more than one table's cells, pairs and vectors are on disk at once.
    found = []
    for t in range(tables):
        index = hashed.select(F.col("id").alias("j"), F.get("own", F.lit(t)).alias("cell"))
        search = hashed.select(F.col("id").alias("i"), F.explode(F.slice("probed", t * probes + 1, probes)).alias("cell"))
        pairs = search.join(index, "cell").where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
        found.append(durable(pairs.join(u, "a").join(v, "b").select("a", "b", "u", "v").mapInArrow(_cosine_batches, f"a {_NAME}, b {_NAME}")))
        release(vectors.sparkSession)
    links = durable(functools.reduce(DataFrame.unionByName, found).distinct())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    comp = connected_components(links)
    told = classes.select("h1", "h2", "rep", "copies").join(degree, "rep", "left").join(comp, F.col("rep") == F.col("id"), "left").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep")["vec_id"].alias("c"))
    keyed = rows.select("vec_id", F.when(usable(F.col("v")) & F.col("vec_id").isNotNull(), F.xxhash64("v")).alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    out = keyed.join(told.hint("merge"), ["h1", "h2"], "left")
    comp_id = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))


def op10_lattice_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
