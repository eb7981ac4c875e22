"""Ordered change records: versions, gaps, batches, coalescing, latest state, clocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions.lineage import durable
from driftwood.functions.scalars import approx_record_size

BATCH_RECORDS, BATCH_BYTES = 512, 64 * 1024

# Bits of an event mask.
FAN_MODIFY, FAN_ATTRIB, FAN_CLOSE_WRITE = 0x2, 0x4, 0x8
FAN_MOVED_FROM, FAN_MOVED_TO, FAN_CREATE, FAN_DELETE, FAN_DELETE_SELF = 0x40, 0x80, 0x100, 0x200, 0x400
FAN_RENAME = 0x10000000


def latest_state(journal: DataFrame) -> DataFrame:
    """Last writer wins in each group of fields, a row for each (share, node_ino).

    created and attr set all attributes, content sets size and time and bumps the version; plain
    maxima by sequence number, combined before the shuffle.
    """
    attrs, sized = F.col("op").isin("created", "attr"), F.col("op").isin("created", "attr", "content")
    last = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    return journal.groupBy("share", "node_ino").agg(
        last("mode", attrs).alias("mode"), last("size", sized).alias("size"), last("ts", sized).alias("mtime"),
        F.count_if(F.col("op") == "content").alias("content_version"), F.max_by("op", "seq").alias("last_op"), F.max("seq").alias("last_seq"),
    )


def version_counter(journal: DataFrame) -> DataFrame:
    w = Window.partitionBy("share", "node_ino").orderBy("seq")
    return journal.where("op = 'content'").withColumn("version", F.row_number().over(w))


def numbered(rows: DataFrame, key: str, order: str, name: str, width: int = 8192, ties: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their place in their key by ``order``, a column of whole numbers, and ``ties``, from 1.

    Places are counted inside blocks of ``width`` values of ``order``, so no window holds a whole key; the
    blocks' counts, one row each, are summed over the key.
    """
    at = rows.withColumn("__block", F.floor(F.col(order) / width))
    counts = at.groupBy(key, "__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(key, "__block").orderBy(order, *ties))
    return at.withColumn("__in", inside).join(counts, [key, "__block"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__block", "__in", "__before")


def share_seq(journal: DataFrame) -> DataFrame:
    return numbered(journal, "share", "seq", "share_seq")


def gaps(batches: DataFrame) -> DataFrame:
    """(share, expected, got, missing) wherever a batch (share, first_seq, n) doesn't follow on.

    Only the neighbours of batch edges matter, so rows before the window are batches, not records.
    """
    w = Window.partitionBy("share").orderBy("first_seq")
    seen = batches.withColumn("expected", F.lag(F.col("first_seq") + F.col("n")).over(w))
    return seen.where(F.col("expected").isNotNull() & (F.col("expected") != F.col("first_seq"))).select("share", "expected", F.col("first_seq").alias("got"), (F.col("first_seq") - F.col("expected")).alias("missing"))


def _ends(size: np.ndarray, records: int, max_bytes: int) -> np.ndarray:
    """Where the batch that begins at each record ends, exclusive: the size is looked at before a record
    is taken, so the batch ends with the record that reaches ``max_bytes``."""
    total = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(len(size))
    return np.minimum(np.searchsorted(total[:-1], total[:-1] + max_bytes, side="left"), at + records)


def _links(records: int, max_bytes: int, block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of each record at which a block's first batch can begin: where the next block's first one does."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q")
        first, own = int(pdf["home"].iloc[0]) * block + 1, int((pdf["q"] <= (pdf["home"].iloc[0] + 1) * block).sum())
        to = _ends(pdf["size"].to_numpy(), records, max_bytes)
        for i in range(own - 1, -1, -1):
            if to[i] < own:
                to[i] = to[to[i]]
        n = min(records, own)
        return pd.DataFrame({"share": pdf["share"].iloc[0], "a": first + np.arange(n), "b": first + to[:n]})

    return run


def _packed(records: int, max_bytes: int, block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A block's batches from the one that begins at ``start``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q")
        own = int((pdf["q"] <= (pdf["home"].iloc[0] + 1) * block).sum())
        size, q, out = pdf["size"].to_numpy(), pdf["q"].to_numpy(), []
        to, at = _ends(size, records, max_bytes), int(pdf["start"].iloc[0] - q[0])
        while at < own:
            out.append((q[at], to[at] - at, int(size[at : to[at]].sum())))
            at = to[at]
        told = pd.DataFrame(out, columns=["first_seq", "n", "bytes"], dtype="int64")
        told.insert(0, "share", pdf["share"].iloc[0])
        return told

    return run


def micro_batches(journal: DataFrame, records: int = BATCH_RECORDS, max_bytes: int = BATCH_BYTES, block: int = 8192) -> DataFrame:
    """(share, batch, first_seq, n, bytes): batches end at ``records`` records or when ``max_bytes`` is reached.

    Where a batch begins depends on all before it.  So blocks of ``block`` records (with the records that
    a batch can reach beyond) first tell where each of their possible first batches leads to in the next
    block; these links are doubled until they span the share, from which each block knows its first batch
    and packs its own.  A task never holds more than a block.
    """
    if block < records:
        raise ValueError("a block is shorter than a batch")
    rows = share_seq(journal.select("share", "seq", approx_record_size(F.col("op"), F.col("name")).cast("bigint").alias("size")))
    home = F.floor((F.col("share_seq") - 1) / block)
    reach = F.array_distinct(F.array(home, F.floor((F.greatest(F.col("share_seq") - records + 1, F.lit(1)) - 1) / block)))
    sized = durable(rows.select("share", F.col("share_seq").alias("q"), "size", F.explode(reach).alias("home")))
    starts = durable(sized.groupBy("share").agg(F.lit(1).cast("bigint").alias("q"), F.max("q").alias("end")))
    blocks = ((starts.agg(F.max("end")).first()[0] or 1) - 1) // block + 1
    ends, starts = starts.select("share", "end"), starts.select("share", "q")
    if blocks > 1:
        links = durable(sized.groupBy("share", "home").applyInPandas(_links(records, max_bytes, block), "share bigint, a bigint, b bigint").join(ends, "share").where("b <= end").select("share", "a", "b"))
        for left in range((blocks - 1).bit_length(), 0, -1):
            starts = durable(starts.unionByName(starts.join(links, (links["share"] == starts["share"]) & (links["a"] == starts["q"])).select(starts["share"], F.col("b").alias("q"))))
            if left > 1:
                onward = links.select(F.col("share").alias("s"), F.col("a").alias("m"), F.col("b").alias("to"))
                links = durable(links.join(onward, (F.col("share") == F.col("s")) & (F.col("b") == F.col("m"))).select("share", "a", F.col("to").alias("b")))
    begun = starts.select("share", F.floor((F.col("q") - 1) / block).alias("home"), F.col("q").alias("start"))
    packed = sized.join(begun, ["share", "home"]).groupBy("share", "home").applyInPandas(_packed(records, max_bytes, block), "share bigint, first_seq bigint, n bigint, bytes bigint")
    return numbered(packed, "share", "first_seq", "batch", width=block * 1024).withColumn("batch", F.col("batch") - 1)


def coalesce_modify(journal: DataFrame, records: int = BATCH_RECORDS) -> DataFrame:
    """The first in-progress content record of each node in each drain batch."""
    batched = journal.where("in_progress").withColumn("batch", F.floor((F.col("seq") - 1) / records))
    return batched.groupBy("batch", "share", "node_ino").agg(F.min("seq").alias("seq"))


def synthesize(mask: Column) -> Column:
    """Operation of an event mask; the order of the tests is their precedence."""
    has = lambda bits: mask.bitwiseAND(bits) != 0
    return (
        F.when(has(FAN_RENAME), "renamed").when(has(FAN_CREATE), "created").when(has(FAN_DELETE | FAN_MOVED_FROM), "removed").when(has(FAN_MOVED_TO), "created")
        .when(has(FAN_DELETE_SELF), "self_removed").when(has(FAN_CLOSE_WRITE), "content").when(has(FAN_ATTRIB), "attr").when(has(FAN_MODIFY), "modify")
    )


def contains(root: Column | str, path: Column) -> Column:
    """Whether a path lies in the subtree, at component boundaries."""
    r = F.lit(root) if isinstance(root, str) else root
    return (path == r) | path.startswith(F.concat(r, F.lit("/")))


def cross_boundary(from_in: Column, to_in: Column) -> Column:
    """What a rename is from inside the subtree; null if it doesn't touch it."""
    return F.when(from_in & to_in, "renamed").when(from_in, "removed").when(to_in, "created")


def name_reason(name: Column) -> Column:
    """Why a name is not one, null if it is: 1 to 255 bytes, no slash or NUL, not . or .. ."""
    return F.when(name.isNull() | (F.octet_length(name) == 0), "empty").when(F.octet_length(name) > 255, "long").when(F.instr(name, "/") > 0, "slash").when(name.contains("\0"), "nul").when(name.isin(".", ".."), "dots")


def attr_reason(kind: Column, target: Column) -> Column:
    n = F.octet_length(target)
    return F.when((kind == "symlink") & target.isNull(), "no target").when((kind != "symlink") & target.isNotNull(), "target").when((kind == "symlink") & ~n.between(1, 4096), "target length")


def cap_reason(kind: Column, n: Column) -> Column:
    """Caps of messages by kind."""
    bad = lambda k, lo, hi: (kind == k) & ~n.between(lo, hi)
    return F.when(bad("batch", 1, 512), "batch").when(bad("snap", 0, 2048), "snap").when(bad("stat", 0, 4096), "stat").when(bad("read", 1, 4 << 20), "read").when(bad("shares", 0, 64), "shares").when(bad("string", 0, 128), "string").when(bad("endpoints", 0, 8), "endpoints")


def dir_cookies(ops: DataFrame) -> DataFrame:
    """Cookie of each insert (dir, seq, insert): fresh from 3 in its directory, never reused."""
    w = Window.partitionBy("dir").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return ops.withColumn("cookie", F.when(F.col("insert"), 2 + F.sum(F.col("insert").cast("bigint")).over(w)))


def dir_generation(ops: DataFrame) -> DataFrame:
    """Generation of each directory after each operation: +1 an insert, removal or replacement.

    ops: (dir, name, seq, op, node), op in set and del.  Setting the entry a name has is no change,
    nor is removing a name that isn't there.
    """
    by_name = Window.partitionBy("dir", "name").orderBy("seq")
    before = F.lag(F.when(F.col("op") == "set", F.col("node"))).over(by_name)
    effect = F.when(F.col("op") == "set", (before.isNull() | (before != F.col("node"))).cast("int")).otherwise(before.isNotNull().cast("int"))
    marked = ops.withColumn("effect", effect).withColumn("insert", (F.col("op") == "set") & (F.col("effect") == 1))
    w = Window.partitionBy("dir").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return dir_cookies(marked).withColumn("dirgen", F.sum("effect").over(w))


def unique_clock(rows: DataFrame, key: str, base: str, order: str) -> DataFrame:
    """Strictly increasing times: each is the larger of its base and the last, plus one."""
    w = Window.partitionBy(key).orderBy(order)
    ranked = rows.withColumn("rn", F.row_number().over(w))
    top = F.max(F.col(base) - F.col("rn")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("stamp", top + F.col("rn") + 1).drop("rn")


def clamp_attrs(rows: DataFrame) -> DataFrame:
    """Sizes and times that never fall, by node."""
    w = Window.partitionBy("node_ino").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"clamped_size": F.max("size").over(w), "clamped_mtime": F.max("ts").over(w)})


def bump(sec: Column, nsec: Column) -> tuple[Column, Column]:
    """A time one nanosecond later, carried."""
    full = nsec >= 999_999_999
    return F.when(full, sec + 1).otherwise(sec), F.when(full, 0).otherwise(nsec + 1)
