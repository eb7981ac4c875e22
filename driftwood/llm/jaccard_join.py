"""Near-duplicate documents: an exact Jaccard metric-space join over distinct 5-word shingles.

Jaccard distance, one minus the Jaccard index, is a metric, and two documents link at a distance of
``1 - threshold`` = r or less.  The join has four steps, each exact:

1. Isolation.  A document that links with another shares at least ``threshold`` of its shingles
   with it, so documents with fewer shingles that occur in any other document are done.  Shingles
   travel packed, a row for each batch of documents and range of hashes; a shingle that repeats
   inside a batch is settled there, so a frequent one is sent once a batch at most.
2. Regions.  Documents with the same set are one item.  Step 1 is done again among items, whose own
   shingles bound the size of what they can link with.  Items that link share one of their
   ``n - ceil(threshold * n) + 1`` rarest hashes, so each such hash names a region.
3. Pivots.  In each region with items that no pivot holds yet, those with the fewest shingles of
   their own become pivots and the others that sizes and own shingles allow are compared with them.  Items
   within r of a pivot fall into its cell and link with it; the rest recur with more pivots, 1, 4, 16 and
   so on, so rounds grow with the logarithm of the region.  Cells need no pairs inside: all their items
   hang on the pivot.  A pivot that nothing links with has no cell and costs nothing further.
4. Windows.  By the triangle inequality an item x of the cell of p can link with an item y outside
   only if d(y, p) - d(x, p) <= r.  Only now, for the cells that there are and the y whose component
   differs from the cell's, is d(y, p) computed; the y of the window are replicated to the cell and
   verified against its items.

What no step has paired can't link, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, copied, release, shuffle_partitions, small, small_batches, table
from ._hashing import mix, shingle_sets, slices, tidy
from .components import connected_components

PERCENT = 75
#: Lists of up to so many ids are broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 2_000_000
GROUP = 4
#: So many of the most frequent hashes, at most, are put last in the order of regions.
FREQUENT = 200_000
#: Bytes of text whose shingles are packed together, and shingles of a range of hashes, about.
PACKED_BYTES, RANGE_SHINGLES = 8 << 20, 8 << 20
#: The last round comes when pairs inside regions are no more than so many times the items.
LAST_ROUND = 200


def _set_batches(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to (doc_id, n, f1, s, bits): size, fingerprint, sorted hashes and bitmap of the set."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in found for x in slices(whole, 1, PACKED_BYTES)):
            ids, at = batch.column(0), 0
            part: list[np.ndarray] = []
            size = 0
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            for i, s in enumerate(sets):
                part.append(s)
                size += len(s)
                if size > 1 << 18 or i + 1 == batch.num_rows:
                    n = np.array([len(x) for x in part], np.int64)
                    fold = np.array([np.bitwise_xor.reduce(mix(x + np.uint64(1))) if len(x) else 0 for x in part], np.uint64).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate([*part, np.zeros(0, np.uint64)]).view(np.int64)))
                    bits = pa.array([_bitmap(x) for x in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), pa.array(n), pa.array(fold), lists, bits], ["doc_id", "n", "f1", "s", "bits"])
                    part, size, at = [], 0, i + 1

    return tidy(run)


SETS = "doc_id bigint, n bigint, f1 bigint, s array<bigint>, bits binary"


def _bitmap(s: np.ndarray) -> bytes:
    """A bit for each hash, four to eight times as many as hashes, at least 64."""
    on = np.zeros(max(64, 4 << int(len(s) - 1).bit_length()), np.uint8) if len(s) else np.zeros(64, np.uint8)
    on[(s & np.uint64(len(on) - 1)).astype(np.int64)] = 1
    return np.packbits(on).tobytes()


def _bound_batches(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, n, m, u, v) to the (a, b) whose index can reach ``least`` percent.

    Each bit of u that v lacks is a hash, at least, that b lacks: this bounds the intersection.
    """

    def fold(x: np.ndarray, size: int) -> np.ndarray:
        return np.bitwise_or.reduce(x.reshape(-1, size), axis=0)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            shared = np.zeros(batch.num_rows, np.int64)
            for i, (u, v) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(u.as_buffer(), np.uint8), np.frombuffer(v.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                x, y = fold(x, size), fold(y, size)
                shared[i] = min(n[i] - int(np.bitwise_count(x & ~y).sum()), m[i] - int(np.bitwise_count(y & ~x).sum()))
            keep = pa.array(100 * shared >= least * (n + m - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return tidy(run)


def _range_batches(ranges: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text or set) to (range, ids, counts, tokens, common): packed shingles of the range.

    tokens: low 32 bits of hashes, document by document, ``counts`` of them each; ``common``: how
    many more of each document's repeat in this batch and so are known to be shared; the first of
    each such kind goes along without a document, last in ``tokens``.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in found for x in (slices(whole, 1, PACKED_BYTES) if pa.types.is_string(whole.column(1).type) else [whole])):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if pa.types.is_string(batch.column(1).type):
                sets = list(shingle_sets(batch.column(1).to_pylist(), k))
            else:
                sets = [x.values.to_numpy().view(np.uint64) for x in batch.column(1)]
            n = np.array([len(s) for s in sets], np.int64)
            # The sizes go to a group by the first id, so to as many groups as there are.
            key = int(mix(ids[:1].view(np.uint64))[0] % np.uint64(ranges))
            yield pa.RecordBatch.from_arrays([pa.array([-1 - key], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, n.astype(np.uint32), n[:0], n[:0]))], ["range", "ids", "counts", "tokens", "common"])
            if not n.sum():
                continue
            h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            del sets
            r = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.argsort(h, kind="stable")
            h, doc, r = h[order], doc[order], r[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            single = new & np.concatenate((new[1:], [True]))
            cuts = np.searchsorted(r, np.arange(ranges + 1).astype(np.uint64))
            for x in range(ranges):
                a, b = cuts[x], cuts[x + 1]
                if a == b:
                    continue
                one = single[a:b]
                d = doc[a:b][one]
                by = np.argsort(d, kind="stable")
                who = np.unique(doc[a:b])
                counts = np.bincount(d, minlength=len(n))[who].astype(np.uint32)
                common = np.bincount(doc[a:b][~one], minlength=len(n))[who].astype(np.uint32)
                low = (h[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                tokens = np.concatenate((low[one][by], low[new[a:b] & ~one]))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids[who], counts, tokens, common))], ["range", "ids", "counts", "tokens", "common"])

    return tidy(run)


def _shared_in_range(group: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The packed rows of one range to (ids, shared): shingles that occur elsewhere too.

    Two hashes of a range that agree in their low 32 bits count as one, so a document can keep a
    few too many, never too few.
    """
    rows = [(np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.uint32), np.frombuffer(c.as_py(), np.uint32), np.frombuffer(d.as_py(), np.uint32)) for batch in group for a, b, c, d in zip(*(batch.column(i) for i in (1, 2, 3, 4)), strict=True)]
    tokens = np.sort(np.concatenate([t for _, _, t, _ in rows]))
    twice = np.unique(tokens[1:][tokens[1:] == tokens[:-1]])
    for ids, counts, t, common in rows:
        own = t[: int(counts.sum())]
        at = np.searchsorted(twice, own)
        hit = (twice[np.minimum(at, max(len(twice) - 1, 0))] == own) if len(twice) else np.zeros(len(own), bool)
        total = np.concatenate(([0], np.cumsum(hit)))
        end = np.cumsum(counts.astype(np.int64))
        shared = total[end] - total[end - counts] + common
        some = shared > 0
        yield ids[some], shared[some].astype(np.int64)


def _by_bucket(found: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """All (ids, numbers) dealt out by a hash of the ids."""
    ids, v = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))
    key = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
    for part in np.split(order, cuts[1:]) if len(order) else []:
        yield int(key[part[0]]), ids[part], v[part]


def _one_range(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """One group of packed rows, as ``applyInArrow`` hands it over, sizes or a range of hashes, to packed
    (bucket, kind, ids, numbers): sizes (kind 0) or how many shingles occur elsewhere too (kind 1)."""

    def run(group: pa.Table) -> pa.Table:
        sizes = group.column(0)[0].as_py() < 0
        if sizes:
            found = [(np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.uint32).astype(np.int64)) for a, b in zip(group.column(1), group.column(2), strict=True)]
        else:
            found = list(_shared_in_range(iter(group.to_batches())))
        rows = [(k, 0 if sizes else 1, i.tobytes(), v.tobytes()) for k, i, v in _by_bucket(found, buckets)]
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("v", pa.binary())])
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(schema.types)], schema=schema)

    return run


def _one_bucket(group: pa.Table) -> pa.Table:
    """The packed rows of one bucket to (id, sizes, shared)."""
    parts = {0: [], 1: []}
    for kind, a, b in zip(group.column(1), group.column(2), group.column(3), strict=True):
        parts[kind.as_py()].append((np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)))
    (ids, n), (at, more) = (tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in parts[k])]) for i in (0, 1)) for k in (0, 1))
    order = np.argsort(ids, kind="stable")
    name, first = np.unique(ids[order], return_index=True)
    shared = np.zeros(len(name), np.int64)
    np.add.at(shared, np.searchsorted(name, at), more)
    offsets = pa.array(np.concatenate((first, [len(ids)])).astype(np.int32))
    return pa.Table.from_arrays([pa.array(name), pa.ListArray.from_arrays(offsets, pa.array(n[order])), pa.array(shared)], ["id", "sizes", "shared"])


def _frequent_batches(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(s) to (token, k): hashes that a batch holds ``least`` times or more."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            token, k = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token[k >= least]), pa.array(k[k >= least])], ["token", "k"])

    return tidy(run)


def _region_batches(frequent, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, n, s) to (id, n, region): the rarest hashes of each item, enough for each link to share one."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, k = frequent.value
        for batch in found:
            ids, n = (batch.column(i).to_numpy() for i in (0, 1))
            flat, end = batch.column(2).flatten().to_numpy(), np.cumsum(n)
            at = np.minimum(np.searchsorted(token, flat), max(len(token) - 1, 0))
            often = np.where(token[at] == flat, k[at], 0) if len(token) else np.zeros(len(flat), np.int64)
            first = n + 1 - -(-n * percent // 100)
            out = [flat[e - m : e][np.lexsort((flat[e - m : e], often[e - m : e]))[:f]] for e, m, f in zip(end, n, first, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, first)), pa.array(np.repeat(n, first)), pa.array(np.concatenate([*out, np.zeros(0, np.int64)]))], ["id", "n", "region"])

    return tidy(run)


def _distance_batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb) to (a, b, shared, whole): sizes of intersection and union."""
    for batch in found:
        sa, sb = batch.column(2), batch.column(3)
        shared, whole = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        fa, fb = sa.flatten().to_numpy(), sb.flatten().to_numpy()
        ea, eb = (np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False)))) for c in (sa, sb))
        for i in range(batch.num_rows):
            x, y = fa[ea[i] : ea[i + 1]], fb[eb[i] : eb[i + 1]]
            z = np.concatenate((x, y))
            z.sort(kind="stable")
            shared[i] = np.count_nonzero(z[1:] == z[:-1])
            whole[i] = len(z) - shared[i]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(whole)], ["a", "b", "shared", "whole"])


def _distances(pairs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """(a, b, shared, whole) of the pairs (a, b) of items whose index is ``least`` percent or more.

    Bitmaps, a fraction of the sets' size, are compared first.
    """
    one, two = (items.select(F.col("id").alias(i), F.col("n").alias(n), F.col("bits").alias(u)) for i, n, u in (("a", "n", "u"), ("b", "m", "v")))
    near = copied(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "u", "v").mapInArrow(_bound_batches(least), "a bigint, b bigint"))
    one = items.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    two = items.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    told = near.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_distance_batches, "a bigint, b bigint, shared bigint, whole bigint")
    return told.where(100 * F.col("shared") >= least * F.col("whole"))


def shared_counts(docs: DataFrame, k: int = 5) -> DataFrame:
    """(id, sizes, shared): step 1.  ``docs`` has doc_id (not null) and text.

    sizes: the set size of each row with the id; shared: how many shingles occur in other rows too.
    """
    return _shared(docs, k, F.char_length("text") / 6)  # a word and its blank take about six characters


def _shared(rows: DataFrame, k: int, size) -> DataFrame:
    ranges = max(shuffle_partitions(rows.sparkSession), int(rows.agg(F.sum(size)).first()[0] or 0) // RANGE_SHINGLES)
    packed = rows.mapInArrow(_range_batches(ranges, k), "range int, ids binary, counts binary, tokens binary, common binary")
    told = packed.groupBy("range").applyInArrow(_one_range(ranges), "bucket int, kind int, ids binary, v binary")
    return told.groupBy("bucket").applyInArrow(_one_bucket, "id bigint, sizes array<bigint>, shared bigint")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, *, doc_id: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    Documents link when 100 * |intersection| >= percent * |union|.  A text that is null or has no
    words has an empty set and links with nothing; one of fewer than k words has its whole
    sequence as its one shingle.  A row without id is returned with a null component and links with
    nothing; rows that share an id all get the least component of them.  No rows give no rows.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    keyed = rows.where(F.col("doc_id").isNotNull())
    small_batches(docs.sparkSession)
    counts = copied(shared_counts(keyed, k))
    live = counts.where((F.array_max("sizes") > 0) & (100 * F.col("shared") >= percent * F.array_min("sizes"))).select(F.col("id").alias("__id"))
    members, links = links_of(keyed.join(_side(live), F.col("doc_id") == F.col("__id"), "left_semi"), percent, k)
    comp = connected_components(links, copy=copied)
    placed = copied(members.join(comp, "id", "left").select("doc_id", F.coalesce("component", "id").alias("c")))
    least = placed.groupBy("c").agg(F.min("doc_id").alias("component"))
    named = placed.join(least, "c").groupBy("doc_id").agg(F.min("component").alias("component"))
    out = counts.join(_side(copied(named)), F.col("id") == F.col("doc_id"), "left").select(F.col("id").alias("doc_id"), F.explode("sizes").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    lost = rows.where(F.col("doc_id").isNull()).mapInArrow(_size_batches(k), "doc_id bigint, n_shingles bigint").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(lost)


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_IDS) else df


def _size_batches(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            n = np.fromiter((len(s) for s in shingle_sets(batch.column(1).to_pylist(), k)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["doc_id", "n_shingles"])

    return run


def links_of(live: DataFrame, percent: int = PERCENT, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Steps 2 to 4 over (doc_id, text): (doc_id, id) of each row with words, id its item, and
    enough links (a, b) between items for their components to be those of all links."""
    sets = copied(live.select("doc_id", "text").mapInArrow(_set_batches(k), SETS).where("n > 0"))
    # An item is named by the fingerprint of its set.
    items = copied(sets.groupBy(F.col("f1").alias("id")).agg(F.first("n").alias("n"), F.first("s").alias("s"), F.first("bits").alias("bits")))
    members = sets.select("doc_id", F.col("f1").alias("id"))
    # Shingles that no other item has are in no partner, which bounds a partner's size by ``most``.
    known = _shared(items.select("id", "s"), k, F.size("s")).select("id", "shared")
    most = (F.floor(F.col("shared") * F.lit((100 + percent) / percent) + 1e-9) - F.col("n")).alias("most")
    sizes = copied(items.select("id", "n").join(known, "id").where(100 * F.col("shared") >= percent * F.col("n")).select("id", "n", most, (F.col("n") - F.col("shared")).alias("own")))
    items = copied(items.join(_side(sizes.select("id", "most")), "id"))
    release(live.sparkSession)
    n_items = sizes.count()
    # Any order that all items share is exact; hashes that many items hold come last in it.
    often = items.select("s").mapInArrow(_frequent_batches(4), "token bigint, k bigint").groupBy("token").agg(F.sum("k").alias("k")).orderBy(F.desc("k"), "token").limit(FREQUENT).collect()
    often.sort(key=lambda r: r["token"])
    frequent = live.sparkSession.sparkContext.broadcast(tuple(np.array([r[c] for r in often], np.int64) for c in ("token", "k")))
    open_ = items.select("id", "n", "s").mapInArrow(_region_batches(frequent, percent), "id bigint, n bigint, region bigint")
    open_ = copied(open_.join(_side(sizes.select("id", "own", "most")), "id").select("id", "n", "region", "own", "most"))
    far = 2 * percent - 100  # 100 * (1 - 2r): pairs less alike than this are outside every window

    def alike(n: str, m: str, least: int):
        return 100 * F.least(n, m) >= least * F.greatest(n, m)

    asked, tested, per_region = None, None, 1
    while True:
        # Items with the fewest shingles of their own come first: in a group of near copies, its centre.
        if per_region == 1:
            first_item = F.min(F.struct("own", F.xxhash64("id").alias("o"), F.col("id").alias("p"), F.col("n").alias("m"), F.col("most").alias("nb")))
            pivots = open_.groupBy("region").agg(first_item.alias("x"), F.count("*").alias("k")).where("k > 1").select("region", "x.p", "x.m", "x.nb")
        else:
            rank = F.row_number().over(Window.partitionBy("region").orderBy("own", F.xxhash64("id"), "id"))
            pivots = open_.withColumn("rank", rank).where(F.col("rank") <= per_region).select("region", F.col("id").alias("p"), F.col("n").alias("m"), F.col("most").alias("nb"))
        met = copied(open_.join(pivots, "region").select("region", "id", "n", "own", "most", "p", "m", "nb"))
        if per_region == 1:
            held = copied(met.groupBy("id").agg(F.count("*").alias("regions")))
        pairs = met.where(F.col("id") != F.col("p")).where(alike("n", "m", far)).select(F.col("id").alias("a"), F.col("p").alias("b"), "n", "m", F.col("most").alias("na"), "nb").distinct()
        fresh = copied(pairs if asked is None else pairs.join(asked.select("a", "b").hint("merge"), ["a", "b"], "left_anti"))
        asked = fresh if asked is None else asked.unionByName(fresh)
        near = _distances(fresh.where(alike("n", "m", percent)).where("m <= na AND n <= nb").select("a", "b"), items, percent)
        tested = copied(near if tested is None else tested.unionByName(near))
        release(live.sparkSession)
        links = tested.select("a", "b")
        # Items that are a pivot of the region, or in the cell of one, are done there.
        cell = links.select(F.col("a").alias("id"), F.col("b").alias("p"), F.lit(True).alias("hit"))
        done = F.max((F.col("id") == F.col("p")) | F.coalesce("hit", F.lit(False)))
        left = copied(met.join(cell.hint("merge"), ["id", "p"], "left").groupBy("region", "id", "n", "own", "most").agg(done.alias("done")).where("not done").select("region", "id", "n", "own", "most"))
        many = left.groupBy("region").count().where("count > 1")
        sizes_left = many.agg(F.max("count").alias("most"), F.sum(F.col("count") * F.col("count")).alias("pairs")).first()
        if sizes_left["most"] is None:
            break
        open_ = left.join(many.select("region"), "region", "left_semi")
        if sizes_left["pairs"] > LAST_ROUND * n_items:
            per_region *= GROUP
            continue
        # The last round: what is left meets in full.  Of two items that link, the one whose rarest
        # hashes end first has all but what the link lets it miss of them in the other's; those in
        # regions where one of the two is done are not seen here and count as shared.
        one, two = (open_.select("region", F.col("id").alias(i), F.col("n").alias(n), F.col("most").alias(x)) for i, n, x in (("a", "n", "na"), ("b", "m", "nb")))
        rare = lambda n: F.col(n) + 1 - F.ceil(F.col(n) * percent / 100)
        miss = lambda n, m: (100 * F.col(n) - percent * F.col(m)) / (100 + percent)
        least = F.least(rare("n") - miss("n", "m"), rare("m") - miss("m", "n"))
        unseen = copied(held.join(open_.groupBy("id").agg(F.count("*").alias("k")), "id").select("id", (F.col("regions") - F.col("k")).alias("u")))
        met = one.join(two, "region").where("a < b AND m <= na AND n <= nb").where(alike("n", "m", percent)).groupBy("a", "b", "n", "m").agg(F.count("*").alias("k"))
        met = met.join(unseen.select(F.col("id").alias("a"), F.col("u").alias("ua")), "a").join(unseen.select(F.col("id").alias("b"), F.col("u").alias("ub")), "b").where(F.col("k") + F.col("ua") + F.col("ub") >= least - 1e-9)
        last = _distances(met.select("a", "b"), items, percent)
        links = copied(links.unionByName(last.select("a", "b")))
        break
    release(live.sparkSession)
    # Step 4: windows around the cells, where components still differ.
    comp = copied(connected_components(links, copy=copied))
    label = copied(sizes.join(comp, "id", "left").select("id", "n", "most", "own", F.coalesce("component", "id").alias("c")))
    named = lambda own, c, n, m: label.select(F.col("id").alias(own), F.col("c").alias(c), F.col("n").alias(n), F.col("most").alias(m), (F.col("n") - F.col("own")).alias(f"h{own}"))
    index = F.col("shared") / F.col("whole")
    inner = tested.select(F.col("a").alias("x"), F.col("b").alias("p"), index.alias("jx"), F.col("shared").alias("sx")).join(named("x", "cx", "nx", "mx"), "x")
    # The cells, and of the items that met their pivots those that sizes let link with one of a cell.
    cells = copied(inner.groupBy("p").agg(F.first("cx").alias("cp"), F.min("nx").alias("least"), F.max("mx").alias("most")))
    about = asked.select(F.col("a").alias("y"), F.col("b").alias("p")).join(_side(cells), "p").join(_side(named("y", "cy", "ny", "my")), "y").where("cy <> cp AND least <= my AND ny <= most")
    outer = _distances(about.select(F.col("y").alias("a"), F.col("p").alias("b")), items, far)
    outer = outer.select(F.col("a").alias("y"), F.col("b").alias("p"), index.alias("jy"), F.col("shared").alias("sy")).join(named("y", "cy", "ny", "my"), "y")
    fits = (F.col("jx") - F.col("jy") <= 1 - percent / 100 + 1e-9) & (F.col("cx") != F.col("cy")) & (F.col("nx") <= F.col("my")) & (F.col("ny") <= F.col("mx")) & alike("nx", "ny", percent)
    # What x and y share is in p too or, at most, what each shares with others beside it.
    through = F.least("sx", "sy") + F.least(F.col("hx") - F.col("sx"), F.col("hy") - F.col("sy"))
    fits = fits & ((100 + percent) * through >= percent * (F.col("nx") + F.col("ny")))
    o, i = outer.alias("o"), inner.alias("i")
    window = o.join(i, (F.col("o.p") == F.col("i.p")) & fits)
    rest = window.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    late = _distances(rest, items, percent).select("a", "b")
    return members, copied(links.unionByName(late))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """All pairs that share a shingle, and the closure of the links, in DuckDB's dialect."""
    from .decontam import shingles_sql

    return f"""
WITH RECURSIVE {shingles_sql("d", "documents", "doc_id", f"translate(text, '{UPPER}', '{LOWER}')")},
size AS MATERIALIZED (SELECT id, count(*) AS n FROM d GROUP BY id),
common AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS k FROM d x JOIN d y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT a AS id, b AS r FROM link UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT documents.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(least(documents.doc_id, m.r), documents.doc_id) AS component_id
FROM documents LEFT JOIN size ON size.id = documents.doc_id LEFT JOIN (SELECT id, min(r) AS r FROM reach GROUP BY id) m ON m.id = documents.doc_id
"""
