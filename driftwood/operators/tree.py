"""The namespace tree: assembly, counts, paths, subtrees, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions.lineage import durable_files as durable
from driftwood.functions.lineage import forget
from driftwood.functions.scalars import path_join

#: Names of a path are followed to this depth at most.
MAX_DEPTH = 512
#: Lists of up to so many rows of one or two numbers are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def assemble(entries: DataFrame) -> DataFrame:
    """Snapshot entries, in any order and repeated, to one entry for each (parent_ino, name).

    The last by ``seq`` wins, ``ino`` breaking ties; a maximum by key is combined before the shuffle.
    """
    rest = [c for c in entries.columns if c not in ("parent_ino", "name")]
    best = F.max(F.struct("seq", "ino", *(c for c in rest if c not in ("seq", "ino"))))
    return entries.groupBy("parent_ino", "name").agg(best.alias("x")).select("parent_ino", "name", *(F.col(f"x.{c}") for c in rest))


def assemble_dirs(records: DataFrame) -> DataFrame:
    """Snapshot records (dir, rec, last, entries array) to (dir, complete, n_records, entry...)."""
    state = records.groupBy("dir").agg(F.bool_or("last").alias("complete"), F.count("*").alias("n_records"))
    entries = records.select(F.col("dir").alias("parent_ino"), F.col("rec").alias("seq"), F.explode("entries").alias("e")).select("parent_ino", "seq", "e.*")
    return state.join(assemble(entries), F.col("dir") == F.col("parent_ino"), "left").drop("parent_ino")


def stats(tree: DataFrame) -> DataFrame:
    """Nodes and dirs, the root among them, and entries."""
    nodes = tree.groupBy("ino").agg(F.max((F.col("kind") == "dir").cast("int")).alias("d"), F.count("*").alias("links"))
    return nodes.agg((F.count("*") + 1).alias("nodes"), (F.sum("d") + 1).alias("dirs"), F.sum("links").alias("entries"))


def link_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("ino").agg(F.count("*").alias("links"))


def paths(tree: DataFrame, root: int = 1, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(ino, path, depth, kind, size, parent_ino) of all that the root reaches, itself included.

    A level at a time: each join goes down one level, so rows are made once and the number of jobs
    is the depth.  Each level is a copy in the checkpoint folder.  A tree that goes
    on below max_depth, or has a cycle, is an error: a part of it is no answer.
    """
    spark = tree.sparkSession
    edges = durable(tree.select(F.col("parent_ino").alias("__p"), F.col("ino").alias("i"), F.col("name").alias("n"), F.col("kind").alias("k"), F.col("size").alias("s")))
    level = spark.createDataFrame([(root, "/", 0, "dir", 0, None)], "ino bigint, path string, depth int, kind string, size bigint, parent_ino bigint")
    out = level
    for depth in range(1, max_depth + 1):
        level = level.where("kind = 'dir'").join(edges, F.col("ino") == F.col("__p")).select(
            F.col("i").alias("ino"), path_join(F.col("path"), F.col("n")).alias("path"), F.lit(depth).alias("depth"), F.col("k").alias("kind"), F.col("s").alias("size"), F.col("__p").alias("parent_ino")
        )
        level = durable(level)
        if level.isEmpty():
            forget(level, edges)
            return out
        out = out.unionByName(level)
    if not level.where("kind = 'dir'").join(edges, F.col("ino") == F.col("__p")).isEmpty():
        raise RuntimeError(f"the tree goes on below {max_depth} levels")
    return out


def path_of(tree: DataFrame, nodes: DataFrame, root: int = 1, max_depth: int = MAX_DEPTH, parents: DataFrame | None = None) -> DataFrame:
    """(ino, path) of each node of ``nodes`` by climbing to the root; null if it isn't reached.

    A node with several entries climbs to its own parent (``parents``: ino, own) and has there the name of
    its first entry by ``cookie``; a node without an entry there isn't reached.  Without ``parents`` or
    cookies any parent is its own and the least name is the first.  All nodes climb together.
    """
    if parents is not None:
        own = parents.select(F.col("ino").alias("__n"), F.col("own").alias("__own"))
        # That the parents are equal is no key: rows then stay by node for what follows.
        at_own = (F.col("parent_ino") <= F.col("__own")) & (F.col("parent_ino") >= F.col("__own"))
        tree = tree.join(own, (F.col("ino") == F.col("__n")) & at_own)
    order = ["cookie", "name", "parent_ino"] if "cookie" in tree.columns else ["name", "parent_ino"]
    up = durable(tree.groupBy("ino").agg(F.min(F.struct(*order)).alias("x")).select(F.col("ino").alias("__i"), "x.name", "x.parent_ino"))
    state = nodes.select("ino").distinct().select("ino", F.col("ino").alias("at"), F.lit("").alias("tail"))
    # A node that has arrived stays in the state, as does one that can't go on, whose place is null.
    for step in range(max_depth - 1):
        climbed = state.where(F.col("at") != root).join(up, F.col("at") == F.col("__i"), "left").select("ino", F.col("parent_ino").alias("at"), F.concat(F.lit("/"), F.col("name"), F.col("tail")).alias("tail"))
        next_ = durable(climbed.unionByName(state.where(F.col("at").isNull() | (F.col("at") == root))))
        if step == 0:
            # From here on nodes climb from what holds something.
            holds = up.select(F.col("parent_ino").alias("__i")).distinct()
            whole, up = up, durable(up.join(holds, "__i", "left_semi"))
            forget(whole)
        else:
            forget(state)
        state = next_
        if state.where(F.col("at") != root).isEmpty():
            break
    forget(up)
    return state.select("ino", F.when(F.col("at") == root, F.when(F.col("tail") == "", "/").otherwise(F.col("tail"))).alias("path"))


def clean_path(path: str) -> Column:
    """The path without empty components."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/"))


def as_deep(all_paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``all_paths`` that are as deep as some path of ``wanted`` (path); no other can be one of them."""
    depth = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    depths = wanted.select(depth(clean_path("path")).alias("__d")).distinct()
    return all_paths.join(F.broadcast(depths), depth(F.col("path")) == F.col("__d"), "left_semi")


def resolve(all_paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path) to (path, ino, status): ok, badpath, noent, notdir.

    Empty components are skipped; ``.`` and ``..`` are bad.  What lies under a file is notdir.
    """
    slash = F.lit("/")
    bad = F.exists(F.split("path", "/"), lambda x: x.isin(".", ".."))
    clean = clean_path("path")
    # Rows are joined by a hash of the path: paths begin alike and are slow to sort by.  That the paths are
    # equal too is no key, so the rows that are told apart by hash stay where they are.
    hashed = lambda c: F.xxhash64(c)
    same = lambda a: (F.col("p") <= a) & (F.col("p") >= a)
    # Filters that Spark would add to some of the joins only are there from the start, so that they share their shuffles.
    fine = clean.isNotNull() & ~bad
    q = wanted.where(F.col("path").isNotNull() & fine).select("path", hashed(clean).alias("h")).repartition("h").dropDuplicates(["h", "path"])
    known = all_paths.select(F.col("path").alias("p"), F.col("ino").alias("i"), F.coalesce("kind", F.lit("dir")).alias("k")).where("p IS NOT NULL AND i IS NOT NULL").withColumn("ph", hashed("p"))
    hit = q.join(known.drop("k"), (F.col("h") == F.col("ph")) & same(clean), "left")
    none = F.lit(None).cast(all_paths.schema["ino"].dataType).alias("ino")
    wrong = wanted.where(F.col("path").isNull() | bad).select("path").distinct().select("path", none, F.when(F.col("path").isNull(), "noent").otherwise("badpath").alias("status"))
    told = hit.where("i IS NOT NULL").select("path", F.col("i").alias("ino"), F.lit("ok").alias("status"))
    # The longest known prefix of a miss tells notdir from noent; for most that is what it lies in.
    up = F.regexp_replace(clean, "/[^/]*$", "")
    miss = hit.where("i IS NULL").select("path", F.when(up == "", slash).otherwise(up).alias("up")).withColumn("uh", hashed("up"))
    above = miss.join(known, (F.col("uh") == F.col("ph")) & same(F.col("up")), "left").select("path", "up", "i", "k")
    near = above.where("i IS NOT NULL").select("path", (F.col("k") != "dir").alias("under"))
    names = F.split("up", "/")
    far = above.where("i IS NULL").select("path", "up")
    prefixes = far.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))).alias("prefix"))
    under = prefixes.join(known.where("k <> 'dir'"), (hashed("prefix") == F.col("ph")) & same(F.col("prefix")), "left_semi").select(F.col("path").alias("u")).distinct()
    far = far.join(under, F.col("path") == F.col("u"), "left").select("path", F.col("u").isNotNull().alias("under"))
    missed = near.unionByName(far).select("path", none, F.when(F.col("under"), "notdir").otherwise("noent").alias("status"))
    return told.unionByName(wrong).unionByName(missed)


def subtree(all_paths: DataFrame, prefix: str) -> DataFrame:
    """A node and all under it, at component boundaries."""
    return all_paths.where((F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/"))


def collect_garbage(tree: DataFrame, removed: DataFrame) -> DataFrame:
    """The entries that are left after the entries ``removed`` (parent_ino, name) go.

    A node goes when all its entries are gone, and then its own entries go; hard links keep it.
    Each round takes entries away or is the last.
    """
    first = durable(removed.select("parent_ino", "name").distinct())
    kept = tree.join(_side(first), ["parent_ino", "name"], "left_anti")
    hit = durable(tree.join(_side(first), ["parent_ino", "name"], "left_semi").select("ino").distinct())
    # What goes is told by nodes alone; the entries themselves follow once.
    left, dead = durable(kept.select("parent_ino", "ino")), None
    while True:
        new = durable(hit.join(left.select("ino"), "ino", "left_anti").select(F.col("ino").alias("parent_ino")))
        below = durable(left.join(_side(new), "parent_ino", "left_semi").select("ino").distinct())
        dead = new if dead is None else dead.unionByName(new)
        if below.isEmpty():
            forget(hit, left, below)
            return kept.join(_side(dead), "parent_ino", "left_anti")
        next_ = durable(left.join(_side(new), "parent_ino", "left_anti"))
        forget(hit, left)
        left, hit = next_, below


def _side(df: DataFrame) -> DataFrame:
    """Small frames are sent whole, so that the other side of their join stays where it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def listing(all_paths: DataFrame) -> DataFrame:
    """Entries, files and bytes directly in each directory that has some."""
    return all_paths.where("parent_ino IS NOT NULL").groupBy("parent_ino").agg(F.count("*").alias("entries"), F.count_if(F.col("kind") == "file").alias("files"), F.sum("size").alias("bytes"))


def with_cookies(tree: DataFrame) -> DataFrame:
    """Cookies from 3, by order of arrival in each directory."""
    return tree.withColumn("cookie", (F.row_number().over(Window.partitionBy("parent_ino").orderBy("seq", "name")) + 2).cast("bigint"))


def page(entries: DataFrame, after: int, max_entries: int) -> DataFrame:
    """The page of each directory after a cookie, with eof; one more row is looked at than shown."""
    ranked = entries.where(F.col("cookie") > after).withColumn("rn", F.row_number().over(Window.partitionBy("parent_ino").orderBy("cookie"))).where(F.col("rn") <= max_entries + 1)
    more = F.max("rn").over(Window.partitionBy("parent_ino")) > max_entries
    return ranked.withColumn("eof", ~more).where(F.col("rn") <= max_entries).drop("rn")


def page_bytes(entries: DataFrame, after: int, max_bytes: int, plus: bool = True) -> DataFrame:
    """Pages sized by bytes: a count from the budget first, then what really fits."""
    per = 160 if plus else 40
    count = min(4096, max(1, (max_bytes - 128) // per))
    cost = F.sum(F.lit(per) + F.octet_length("name")).over(Window.partitionBy("parent_ino").orderBy("cookie").rowsBetween(Window.unboundedPreceding, 0))
    shown = page(entries, after, count).withColumn("used", cost)
    cut = F.max((F.col("used") > max_bytes).cast("int")).over(Window.partitionBy("parent_ino")) == 1
    return shown.withColumn("eof", F.col("eof") & ~cut).where(F.col("used") <= max_bytes)


#: A reply record's bytes at most, and what of them isn't entries.
MAX_RECORD, RECORD_REST = 2 << 20, 512


def page_v4(entries: DataFrame, after: int, max_bytes: int, attr_bytes: int) -> DataFrame:
    """Pages sized by their encoding: an entry is its cookie, its name padded to words and ``attr_bytes`` of
    attributes, with a mark before it; the page ends before the first that doesn't fit with the end's marks.

    Cookies are 3 at least.  A directory whose first entry doesn't fit has no rows.
    """
    size = F.lit(8 + 4 + attr_bytes) + F.ceil(F.octet_length("name") / 4) * 4
    w = Window.partitionBy("parent_ino").orderBy("cookie")
    before = F.coalesce(F.sum(size + 4).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = page(entries, after, 4096).withColumn("fits", before + size + 8 <= min(max_bytes, MAX_RECORD - RECORD_REST))
    cut = F.min(F.col("fits").cast("int")).over(Window.partitionBy("parent_ino")) == 0
    return shown.withColumn("eof", F.col("eof") & ~cut).where("fits").drop("fits").withColumn("cookie", F.greatest("cookie", F.lit(3)))


def lookup(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """(parent_ino, name) asked for, with ino and status ok, noent or notdir."""
    kinds = tree.select(F.col("ino").alias("d"), (F.col("kind") == "dir").alias("is_dir")).distinct()
    e = tree.select(F.col("parent_ino").alias("ep"), F.col("name").alias("en"), F.col("ino").alias("ino"))
    out = asked.join(kinds, F.col("parent_ino") == F.col("d"), "left").join(e, (F.col("parent_ino") == F.col("ep")) & (F.col("name") == F.col("en")), "left")
    status = F.when(~F.coalesce("is_dir", F.lit(True)), "notdir").when(F.col("ino").isNull(), "noent").otherwise("ok")
    return out.select("parent_ino", "name", "ino", status.alias("status"))


def stat_batch(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (batch, inos array): attributes at the same places, null for misses."""
    asked = keys.select("batch", F.posexplode("inos").alias("pos", "ino"))
    return asked.join(nodes, "ino", "left")
