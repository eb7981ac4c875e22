"""Content-addressed chunks: cutting, deduplication, manifests, scrubbing, eviction, reads, coverage.

Content hashes are SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions.lineage import durable

CHUNK = 4 << 20
EVICT_TO, PROTECT_SECONDS, TOUCH_SECONDS, DIRTY_SECONDS = 0.9, 600, 3600, 5


def chunks(blobs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, off, len, hash, data) of each chunk of (node, data); an empty blob has none."""
    n = F.octet_length("data")
    cut = blobs.where(n > 0).select("node", "data", F.explode(F.sequence(F.lit(0), ((n - 1) / chunk).cast("int"))).alias("i"))
    piece = cut.select("node", (F.col("i").cast("bigint") * chunk).alias("off"), F.substring("data", F.col("i") * chunk + 1, F.lit(chunk)).alias("data"))
    return piece.select("node", "off", F.octet_length("data").cast("bigint").alias("len"), F.sha2("data", 256).alias("hash"), "data")


def new_blobs(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each hash that isn't stored yet."""
    return found.join(known.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.min("len").alias("len"))


def dedup_ratio(found: DataFrame) -> DataFrame:
    each = found.groupBy("hash").agg(F.max("len").alias("len"), F.count("*").alias("uses"))
    return each.agg(F.sum(F.col("len") * F.col("uses")).alias("total"), F.sum("len").alias("stored"), F.sum("uses").alias("refs"), F.count("*").alias("blobs"))


def merge_manifests(rows: DataFrame) -> DataFrame:
    """Manifest entries (share, ino, gen, content_version, off, len, hash, seq): the newest version of
    a node replaces all others; in it, the last chunk at an offset."""
    newest = rows.groupBy("share", "ino", "gen").agg(F.max_by("content_version", "seq").alias("content_version"))
    own = rows.join(newest, ["share", "ino", "gen", "content_version"], "left_semi")
    return own.groupBy("share", "ino", "gen", "content_version", "off").agg(F.max_by(F.struct("len", "hash"), "seq").alias("x")).select("share", "ino", "gen", "content_version", "off", "x.len", "x.hash")


def rebind(manifests: DataFrame, moves: DataFrame) -> DataFrame:
    """Manifests whose (ino, content_version) moves to a new version; no source, no change."""
    m = moves.select("ino", F.col("from_version").alias("content_version"), "to_version")
    return manifests.join(m, ["ino", "content_version"], "left").withColumn("content_version", F.coalesce("to_version", "content_version")).drop("to_version")


def drop_nodes(manifests: DataFrame, nodes: DataFrame) -> DataFrame:
    return manifests.join(nodes.select("ino").distinct(), "ino", "left_anti")


def touch(rows: DataFrame, now: Column, stale: int = TOUCH_SECONDS) -> DataFrame:
    """Recency in memory, and what is persisted: only where it is stale by an hour."""
    recent = F.greatest(F.col("last_access"), now)
    return rows.withColumns({"recent": recent, "last_access": F.when(now - F.col("last_access") >= stale, recent).otherwise(F.col("last_access"))})


def evict(rows: DataFrame, now: int, max_bytes: int, evict_to: float = EVICT_TO, protect: int = PROTECT_SECONDS) -> DataFrame:
    """Victims among (hash, len, last): oldest first down to the target, the protected ones only if
    the hard cap still needs it.

    Running sums over all rows would meet in one task; sums of whole seconds of ``last`` are run
    instead (bounded by the seconds there are, not by the rows), and rows of one second follow.
    """
    target = int(max_bytes * evict_to)
    free = F.col("last") <= now - protect
    total = rows.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    first = _drain(rows.where(free), F.lit(target), total)
    spent = first.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("freed"))
    left = total.select((F.col("total") - spent.scalar()).alias("total"))
    second = _drain(rows.join(first.select("hash"), "hash", "left_anti"), F.lit(target), left, F.lit(max_bytes))
    return first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))


def _drain(rows: DataFrame, target: Column, total: DataFrame, only_over: Column | None = None) -> DataFrame:
    """Rows in order of (last, hash) until the total, less what went before, is at most the target."""
    by_second = rows.groupBy("last").agg(F.sum("len").alias("s"))
    run = by_second.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("last").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("last", "before")
    inner = F.coalesce(F.sum("len").over(Window.partitionBy("last").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = total.scalar()
    out = rows.join(run, "last").withColumn("prior", F.col("before") + inner).where(whole - F.col("prior") > target)
    if only_over is not None:
        out = out.where(whole > only_over)
    return out.select("hash", "len", "last")


def scrub(stored: DataFrame) -> DataFrame:
    """Counts over (hash, data): data null is missing, another hash is corrupt."""
    missing = F.col("data").isNull()
    corrupt = ~missing & (F.sha2("data", 256) != F.col("hash"))
    return stored.agg(F.count("*").alias("checked"), F.count_if(corrupt).alias("corrupt"), F.count_if(missing).alias("missing"))


def scrub_and_drop(stored: DataFrame, sample: int = 0) -> DataFrame:
    """Each blob (hash, data, len) that is looked at with its state: ok, corrupt or missing; the last two
    are to be dropped (``kept``).  ``sample`` takes so many by hash; 0 takes all."""
    looked = stored if sample == 0 else stored.orderBy("hash").limit(sample)
    state = F.when(F.col("data").isNull(), "missing").when(F.sha2("data", 256) != F.col("hash"), "corrupt").otherwise("ok")
    return looked.select("hash", "len", state.alias("state"))


def kept(stored: DataFrame, looked: DataFrame) -> DataFrame:
    """What a scrub or a verified read leaves in the store."""
    return stored.join(looked.where("state <> 'ok'").select("hash").distinct(), "hash", "left_anti")


def verified_read(asked: DataFrame, stored: DataFrame, verify: bool = True) -> DataFrame:
    """``asked`` (req, hash, off, len) with n, bytes and the blob's state; a blob that is missing or, if
    ``verify``, has another hash than its own gives null, as after its drop."""
    state = F.when(F.col("data").isNull(), "missing").when(F.lit(verify) & (F.sha2("data", 256) != F.col("hash")), "corrupt").otherwise("ok")
    # A blob is hashed once, however often it is read.
    told = stored.join(asked.select("hash").distinct(), "hash", "left_semi").select("hash", "data", state.alias("state"))
    hit = asked.join(told, "hash", "left").withColumn("state", F.coalesce("state", F.lit("missing")))
    fine = F.col("state") == "ok"
    n = F.greatest(F.lit(0), F.least(F.octet_length("data").cast("bigint"), F.col("off") + F.col("len")) - F.col("off"))
    part = F.substring("data", (F.col("off") + 1).cast("int"), n.cast("int"))
    return hit.select("req", "hash", "off", F.when(fine, n).alias("n"), F.when(fine, part).alias("bytes"), "state")


def drop_share(manifest: DataFrame, share: int) -> DataFrame:
    """The manifest without a share's rows: after a reseed its versions start again."""
    return manifest.where(F.col("share") != share)


def ingest(found: DataFrame, known: DataFrame, now: int, max_bytes: int) -> DataFrame:
    """The store (hash, len, last, fresh) after the chunks ``found`` (hash, len) have come to ``known``
    (hash, len, last): new blobs are accounted, known ones touched, and what is over ``max_bytes`` goes, the
    longest unused first."""
    new = found.groupBy("hash").agg(F.max("len").alias("new_len"))
    both = known.join(new, "hash", "full_outer")
    rows = durable(both.select("hash", F.coalesce("len", "new_len").alias("len"), F.when(F.col("new_len").isNotNull(), F.lit(now)).otherwise(F.col("last")).cast("bigint").alias("last"), F.col("len").isNull().alias("fresh")))
    total = rows.agg(F.sum("len")).first()[0] or 0
    return rows if total <= max_bytes else rows.join(evict(rows.select("hash", "len", "last"), now, max_bytes).select("hash"), "hash", "left_anti")


def read_range(blobs: DataFrame, off: str = "off", length: str = "len") -> DataFrame:
    """n bytes from an offset, and eof; short at the end of the blob."""
    size = F.octet_length("data").cast("bigint")
    n = F.greatest(F.lit(0), F.least(size, F.col(off) + F.col(length)) - F.col(off))
    return blobs.withColumns({"n": n, "eof": F.col(off) + F.col(length) >= size, "bytes": F.substring("data", (F.col(off) + 1).cast("int"), n.cast("int"))})


def assemble_read(asked: DataFrame, manifest: DataFrame, chunk: int) -> DataFrame:
    """Ranges (req, node, off, len) read through chunks: how many bytes come before the first gap."""
    want = asked.where("len > 0").select("req", "node", "off", "len", F.explode(F.sequence(F.floor(F.col("off") / chunk), F.floor((F.col("off") + F.col("len") - 1) / chunk))).alias("i"))
    have = manifest.select(F.col("node").alias("cn"), F.col("off").alias("coff"), F.col("len").alias("clen"))
    hit = want.join(have, (F.col("node") == F.col("cn")) & (F.col("i") * chunk == F.col("coff")), "left")
    end = F.least(F.col("off") + F.col("len"), F.col("coff") + F.col("clen"))
    part = F.when(F.col("coff").isNotNull(), F.greatest(F.lit(0), end - F.greatest("off", "coff")))
    full = F.least(F.col("off") + F.col("len"), (F.col("i") + 1) * chunk) - F.greatest(F.col("off"), F.col("i") * chunk)
    rows = hit.withColumns({"part": F.coalesce(part, F.lit(0)), "short": F.coalesce(part < full, F.lit(True))})
    before = F.coalesce(F.max(F.col("short").cast("int")).over(Window.partitionBy("req").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where("before = 0").groupBy("req").agg(F.sum("part").alias("n"))


def fetch_plan(misses: DataFrame, sizes: DataFrame, chunk: int) -> DataFrame:
    """Chunks to fetch, each once, with the next one where the file has it."""
    own = misses.select("node", (F.col("off") - F.col("off") % chunk).alias("off"), F.lit(False).alias("prefetch"))
    next_ = own.select("node", (F.col("off") + chunk).alias("off"), F.lit(True).alias("prefetch"))
    both = own.unionByName(next_).groupBy("node", "off").agg(F.min("prefetch").alias("prefetch"))
    return both.join(sizes, "node").where(F.col("off") < F.col("size")).select("node", "off", "prefetch")


def islands(ranges: DataFrame, key: str = "file") -> DataFrame:
    """Maximal covered intervals (key, start, end) of ranges (key, off, len)."""
    w = Window.partitionBy(key).orderBy("off", "end")
    rows = ranges.where("len > 0").withColumn("end", F.col("off") + F.col("len"))
    fresh = F.col("off") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return rows.withColumn("island", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "island").agg(F.min("off").alias("start"), F.max("end").alias("end")).drop("island")


def covered_chunks(ranges: DataFrame, sizes: DataFrame, chunk: int, key: str = "file") -> DataFrame:
    """(key, off) of the chunks that the writes cover in full; the last one up to the file's size."""
    i = islands(ranges, key).join(sizes, key)
    at = i.select(key, "start", "end", "size", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))).alias("c"))
    off = F.col("c") * chunk
    return at.where((off >= F.col("start")) & (off < F.col("size")) & (F.least(off + chunk, F.col("size")) <= F.col("end"))).select(key, off.alias("off"))


def _paint(bucket: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of a bucket, newest first: each keeps the bytes that no newer one has; a bucket's are one map."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, free, left = None, np.zeros(0, bool), 0
        for pdf in parts:
            out = []
            for key, salt, b, lo, hi, arrival in zip(*(pdf[c].tolist() for c in ("file", "salt", "bucket", "start", "end", "arrival")), strict=True):
                if (key, salt, b) != at:
                    at, free, left = (key, salt, b), np.ones(bucket, bool), bucket
                if not left:
                    continue
                i = lo - b * bucket
                part = free[i : hi - b * bucket]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], part, [False])).view(np.int8))).tolist()
                out += [(key, b, lo + x, lo + y, arrival) for x, y in zip(edges[::2], edges[1::2], strict=True)]
                left -= int(part.sum())
                part[:] = False
            yield pd.DataFrame(out, columns=["file", "bucket", "start", "end", "arrival"], dtype="int64")

    return run


def write_overlay(writes: DataFrame, bucket: int = 1 << 16, salts: int = 16) -> DataFrame:
    """(file, start, end, arrival): the bytes of each file after its writes (file, arrival, off, len), each
    from the newest write that has it.  Nothing covers holes.

    Writes are cut at multiples of ``bucket``.  The newest of a bucket are painted first and older ones
    fill what is left, so a task holds one bucket's map, however many writes there are.  As the newest
    of parts is the newest of all, a bucket's writes are first painted in ``salts`` parts side by side.
    """
    at = F.floor(F.col("off") / bucket)
    cut = writes.where("len > 0").select("file", "arrival", "off", (F.col("off") + F.col("len")).alias("to"), F.explode(F.sequence(at, F.floor((F.col("off") + F.col("len") - 1) / bucket))).alias("bucket"))
    rows = cut.select("file", "bucket", F.greatest("off", F.col("bucket") * bucket).alias("start"), F.least("to", (F.col("bucket") + 1) * bucket).alias("end"), "arrival")
    schema = "file bigint, bucket bigint, start bigint, end bigint, arrival bigint"
    for salt in ([F.pmod(F.xxhash64("arrival"), F.lit(salts))] if salts > 1 else []) + [F.lit(0)]:
        keyed = rows.select(*(F.col(c).cast("bigint") for c in ("file", "bucket", "start", "end", "arrival")), salt.cast("bigint").alias("salt"))
        rows = keyed.repartition("file", "bucket", "salt").sortWithinPartitions("file", "bucket", "salt", F.desc("arrival"), "start").mapInPandas(_paint(bucket), schema)
    # Pieces that a bucket's edge has cut are one again.
    w = Window.partitionBy("file", "arrival").orderBy("start")
    fresh = F.coalesce(F.lag("end").over(w) != F.col("start"), F.lit(True))
    return rows.withColumn("piece", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("file", "arrival", "piece").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("file", "start", "end", "arrival")


def overlay_bytes(segments: DataFrame, writes: DataFrame) -> DataFrame:
    """``segments`` with their bytes, out of ``data`` of the writes."""
    data = writes.select("file", "arrival", "off", "data")
    return segments.join(data, ["file", "arrival"]).withColumn("bytes", F.substring("data", (F.col("start") - F.col("off") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).drop("off", "data")


def unstable_writes(writes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each unstable write (file, arrival, off, len, us) with the attributes it is answered with: the size
    never shrinks and the time is after all before it in nanoseconds, whatever the clock; ``sizes``
    (file, size, mtime_ns) is what the files had.  A file that isn't there has no answer."""
    w = Window.partitionBy("file").orderBy("arrival")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = writes.join(sizes, "file").withColumn("rn", F.row_number().over(w))
    base = F.greatest(F.col("us") * 1000, F.col("mtime_ns"))
    return rows.select(
        "file", "arrival", F.greatest("size", F.max(F.col("off") + F.col("len")).over(past)).alias("size"), (F.max(base - F.col("rn")).over(past) + F.col("rn") + 1).alias("mtime_ns"),
    )


def commit_waits(commits: DataFrame, batches: DataFrame, bucket: int) -> DataFrame:
    """(commit, batch) whose ranges meet, through buckets of the range so that it is an equi-join."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket)))
    left = commits.where("c_end > c_off").select("*", span("c_off", "c_end").alias("k"))
    right = batches.where("b_len > 0").withColumn("b_end", F.col("b_off") + F.col("b_len")).select("*", span("b_off", "b_end").alias("k"))
    return left.join(right, ["file", "k"]).where("b_off < c_end AND b_end > c_off").select("file", "commit", "batch").distinct()


def route(age: Column) -> Column:
    return F.when(age < DIRTY_SECONDS, "source").otherwise("cache")
