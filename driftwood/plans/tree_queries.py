"""Queries over the namespace tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.functions.lineage import durable_files as durable
from driftwood.functions.lineage import forget
from driftwood.operators import command, tree
from driftwood.sources import fixtures
from driftwood.sources.fixtures import LEVEL, LINES, PATHS_SQL, ROOT, SNAPSHOT_SQL

from .registry import query


def _tree(spark, sf_dir, *columns, placed=None):
    """The whole tree; with ``columns`` those alone beside parent_ino, name, seq and ino."""
    entries = fixtures.snapshot(spark, sf_dir, placed)
    return tree.assemble(entries.select("parent_ino", "name", "seq", "ino", *columns) if columns or placed is not None else entries)


_LINE = ("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "ordinal")


def _copied(spark, sf_dir, *columns, placed=None):
    """A copy of ``_tree``; the lines are copied first, since their window takes most of the disk."""
    line = placed or durable(fixtures.lines(spark, sf_dir).select(*_LINE))
    out = durable(_tree(spark, sf_dir, *columns, placed=line))
    if placed is None:
        forget(line)
    return out


@query(f"WITH {SNAPSHOT_SQL} SELECT parent_ino, name, ino, kind, size, mode, mtime_sec FROM tree")
def snapshot_assemble(spark, sf_dir):
    return _tree(spark, sf_dir).select("parent_ino", "name", "ino", "kind", "size", "mode", "mtime_sec")


@query(f"""WITH {SNAPSHOT_SQL}
SELECT l_orderkey AS dir, count(DISTINCT l_linenumber) AS entries, count(DISTINCT ordinal % 2) AS n_records, bool_or(ordinal % 2 = 0) AS complete FROM lines GROUP BY 1""")
def snapshot_multi_record(spark, sf_dir):
    """Directories whose listing comes in two records, the second the last."""
    line = fixtures.lines(spark, sf_dir)
    entry = F.struct(F.col("l_linenumber").cast("string").alias("name"), F.col("ordinal").cast("bigint").alias("ino"), F.lit("file").alias("kind"))
    records = line.groupBy(F.col("l_orderkey").alias("dir"), (F.col("ordinal") % 2).alias("part")).agg(F.collect_list(entry).alias("entries")).select("dir", (1 - F.col("part")).cast("bigint").alias("rec"), (F.col("part") == 0).alias("last"), "entries")
    out = tree.assemble_dirs(records)
    return out.groupBy("dir").agg(F.count("name").alias("entries"), F.max("n_records").alias("n_records"), F.bool_or("complete").alias("complete"))


@query(f"""WITH {SNAPSHOT_SQL}, n AS (SELECT ino, max(kind = 'dir') AS d, count(*) AS links FROM tree GROUP BY ino)
SELECT count(*) + 1 AS nodes, sum(d::int)::bigint + 1 AS dirs, sum(links)::bigint AS entries FROM n""")
def tree_stats(spark, sf_dir):
    return tree.stats(_tree(spark, sf_dir))


@query(f"WITH {SNAPSHOT_SQL} SELECT parent_ino, count(*) AS entries FROM tree GROUP BY parent_ino")
def entry_recount(spark, sf_dir):
    return _tree(spark, sf_dir).groupBy("parent_ino").agg(F.count("*").alias("entries"))


_HARD = "hard AS (SELECT ino FROM tree UNION ALL SELECT 5 * 1099511627776 + l_orderkey * 1024 + ordinal FROM lines WHERE l_partkey % 3 = 0)"


@query(f"WITH {SNAPSHOT_SQL}, {_HARD} SELECT ino, count(*) AS links FROM hard GROUP BY ino")
def link_counts(spark, sf_dir):
    """Every third part's line has a second name elsewhere."""
    t = _tree(spark, sf_dir).select("ino")
    more = fixtures.lines(spark, sf_dir).where("l_partkey % 3 = 0").select((5 * LEVEL + F.col("l_orderkey") * LINES + F.col("ordinal")).cast("bigint").alias("ino"))
    return tree.link_counts(t.unionByName(more))


@query(f"{PATHS_SQL} SELECT ino, path, depth, kind FROM paths")
def tree_paths(spark, sf_dir):
    return tree.paths(_tree(spark, sf_dir), ROOT).select("ino", "path", "depth", "kind")


@query(f"{PATHS_SQL} SELECT ino, path FROM paths UNION ALL SELECT r_regionkey + 7, NULL FROM region")
def path_of(spark, sf_dir):
    """Every node of the whole tree, and ids that nothing holds.  Every third part's line has a later name in
    its order and one elsewhere; neither is its path."""
    line = durable(fixtures.lines(spark, sf_dir).select(*_LINE, "l_partkey", "l_suppkey"))
    t = _copied(spark, sf_dir, placed=line)
    linked = line.where("l_partkey % 3 = 0").select((5 * LEVEL + F.col("l_orderkey") * LINES + F.col("ordinal")).cast("bigint").alias("ino"), (2 * LEVEL + F.col("l_suppkey") % 25).cast("bigint").alias("else"))
    linked = durable(t.join(linked, "ino"))
    forget(line)
    later = F.lit(1 << 20).cast("bigint") + F.col("seq")
    more = [linked.withColumns({"seq": later, "parent_ino": at, "name": F.concat(F.lit(mark), F.col("ino").cast("string"))}).drop("else") for at, mark in ((F.col("parent_ino"), "!"), (F.col("else"), "!!"))]
    entries = durable(tree.with_cookies(t.unionByName(more[0]).unionByName(more[1])).drop("seq"))
    forget(linked)
    asked = t.select("ino").unionByName(spark.range(ROOT, ROOT + 1).withColumnRenamed("id", "ino")).unionByName(fixtures.read(spark, sf_dir, "region").select((F.col("r_regionkey") + 7).cast("bigint").alias("ino")))
    out = tree.path_of(entries, asked, ROOT, parents=t.select("ino", F.col("parent_ino").alias("own")))
    forget(entries, t)
    return out


@query(f"""{PATHS_SQL},
asked AS (SELECT DISTINCT unnest([path, '/' || path, path || 'x', path || '/deep', path || '/../a']) AS path FROM paths WHERE ino >= {3 * LEVEL}),
clean AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM asked),
hit AS (SELECT c.path, p.ino, list_contains(parts, '..') OR list_contains(parts, '.') AS bad FROM clean c LEFT JOIN paths p ON p.path = '/' || array_to_string(parts, '/')),
under AS (SELECT DISTINCT path FROM (SELECT path, '/' || array_to_string(parts[:n], '/') AS prefix FROM clean, range(1, 9) r(n) WHERE n <= len(parts)) x WHERE prefix IN (SELECT path FROM paths WHERE kind <> 'dir'))
SELECT hit.path, CASE WHEN NOT bad THEN ino END AS ino, CASE WHEN bad THEN 'badpath' WHEN ino IS NOT NULL THEN 'ok' WHEN under.path IS NOT NULL THEN 'notdir' ELSE 'noent' END AS status
FROM hit LEFT JOIN under ON under.path = hit.path""")
def resolve_path(spark, sf_dir):
    """The path of every customer, supplier, order and line, from the tables, with misses beside each."""
    read = lambda n: fixtures.read(spark, sf_dir, n)
    nation = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", F.lit(""), "r_name", "n_name").alias("n_path"))
    held = lambda t, on, name: t.join(nation, F.col(on) == F.col("n_nationkey")).select(t.columns[0], F.concat_ws("/", "n_path", name).alias("path"))
    customer = held(read("customer").select("c_custkey", "c_nationkey", "c_name"), "c_nationkey", "c_name")
    supplier = held(read("supplier").select("s_suppkey", "s_nationkey", "s_name"), "s_nationkey", "s_name")
    order = read("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat_ws("/", "path", F.col("o_orderkey").cast("string")).alias("path"))
    line = read("lineitem").join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("/", "path", F.col("l_linenumber").cast("string")).alias("path"))
    p = F.col("path")
    known = customer.select("path").unionByName(supplier.select("path")).unionByName(order.select("path")).unionByName(line)
    asked = known.select(F.explode(F.array(p, F.concat(F.lit("/"), p), *(F.concat(p, F.lit(x)) for x in ("x", "/deep", "/../a")))).alias("path"))
    return tree.resolve(tree.paths(_tree(spark, sf_dir), ROOT), asked)


@query(f"{PATHS_SQL} SELECT ino, path FROM paths WHERE path = '/ASIA/NATION_12' OR starts_with(path, '/ASIA/NATION_12/')")
def subtree_of(spark, sf_dir):
    return tree.subtree(tree.paths(_tree(spark, sf_dir), ROOT), "/ASIA/NATION_12").select("ino", "path")


@query(f"""{PATHS_SQL} SELECT a.ino AS ino, count(*) AS descendants FROM paths a JOIN paths b ON starts_with(b.path, a.path || '/') WHERE a.depth = 2 GROUP BY a.ino""")
def ancestors_of(spark, sf_dir):
    """Descendants of each node of the second level: whoever climbs through it."""
    p = tree.paths(_tree(spark, sf_dir), ROOT)
    above = F.concat(F.lit("/"), F.substring_index(F.substring(F.col("path"), 2, 1 << 20), "/", 2))
    low = p.where("depth > 2").groupBy(above.alias("a")).agg(F.count("*").alias("descendants"))
    return p.where("depth = 2").join(low, F.col("path") == F.col("a")).select("ino", "descendants")


@query(f"""WITH RECURSIVE {SNAPSHOT_SQL},
dead AS (SELECT ino FROM tree WHERE parent_ino = {2 * LEVEL + 3} OR ino = {LEVEL + 1} UNION SELECT t.ino FROM tree t JOIN dead d ON t.parent_ino = d.ino)
SELECT kind, count(*) AS entries, count(DISTINCT parent_ino) AS parents FROM tree WHERE ino NOT IN (SELECT ino FROM dead) GROUP BY kind""")
def subtree_gc(spark, sf_dir):
    """One region and all of a nation's entries are removed from the whole tree; what hung below goes too."""
    return _collected(_copied(spark, sf_dir, "kind"))


def _collected(t):
    removed = t.where((F.col("parent_ino") == 2 * LEVEL + 3) | (F.col("ino") == LEVEL + 1)).select("parent_ino", "name")
    return tree.collect_garbage(t, removed).groupBy("kind").agg(F.count("*").alias("entries"), F.countDistinct("parent_ino").alias("parents"))


@query(f"""{PATHS_SQL}, l AS (SELECT parent_ino, count(*) AS entries, count(*) FILTER (WHERE kind = 'file') AS files, sum(size)::bigint AS bytes FROM paths WHERE parent_ino IS NOT NULL GROUP BY parent_ino)
SELECT p.path, entries, files, bytes FROM l JOIN paths p ON p.ino = l.parent_ino""")
def tree_listing(spark, sf_dir):
    p = tree.paths(_tree(spark, sf_dir), ROOT)
    return tree.listing(p).join(p.select(F.col("ino").alias("i"), "path"), F.col("parent_ino") == F.col("i")).select("path", "entries", "files", "bytes")


_COOKIES = "c AS (SELECT *, row_number() OVER (PARTITION BY parent_ino ORDER BY seq, name) + 2 AS cookie FROM tree)"


@query(f"""WITH {SNAPSHOT_SQL}, {_COOKIES}, r AS (SELECT *, row_number() OVER (PARTITION BY parent_ino ORDER BY cookie) AS rn, count(*) OVER (PARTITION BY parent_ino) AS n FROM c WHERE cookie > 4)
SELECT parent_ino, name, ino, cookie, n <= 4 AS eof FROM r WHERE rn <= 4""")
def dir_page(spark, sf_dir):
    return tree.page(tree.with_cookies(_tree(spark, sf_dir)), 4, 4).select("parent_ino", "name", "ino", "cookie", "eof")


@query(f"""WITH {SNAPSHOT_SQL}, {_COOKIES}, r AS (SELECT *, row_number() OVER (PARTITION BY parent_ino ORDER BY cookie) AS rn, count(*) OVER (PARTITION BY parent_ino) AS n,
  sum(160 + octet_length(encode(name))) OVER (PARTITION BY parent_ino ORDER BY cookie ROWS UNBOUNDED PRECEDING) AS used FROM c WHERE cookie > 3),
s AS (SELECT *, max(CASE WHEN rn <= 11 AND used > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY parent_ino) AS cut FROM r)
SELECT parent_ino, name, cookie, used::bigint AS used, n <= 11 AND cut = 0 AS eof FROM s WHERE rn <= 11 AND used <= 2000""")
def dir_page_bytes(spark, sf_dir):
    return tree.page_bytes(tree.with_cookies(_tree(spark, sf_dir)), 3, 2000).select("parent_ino", "name", "cookie", "used", "eof")


_PAGE_FROM = f"WITH {SNAPSHOT_SQL}, {_COOKIES}, n AS (SELECT ino, max(kind) AS k, max(size) AS s FROM tree GROUP BY ino)"


@query(f"""{_PAGE_FROM}, r AS (SELECT *, row_number() OVER (PARTITION BY parent_ino ORDER BY cookie) AS rn FROM c)
SELECT parent_ino, name, cookie, k AS attr_kind, s AS attr_size FROM r LEFT JOIN n ON n.ino = r.ino AND r.ino % 3 <> 0 WHERE rn <= 8""")
def readdir_plus(spark, sf_dir):
    """First pages with the attributes of those nodes that are known."""
    t = _tree(spark, sf_dir)
    known = t.where("ino % 3 <> 0").groupBy("ino").agg(F.max("kind").alias("attr_kind"), F.max("size").alias("attr_size"))
    return tree.page(tree.with_cookies(t), 0, 8).join(known, "ino", "left").select("parent_ino", "name", "cookie", "attr_kind", "attr_size")


_ASKED = f"""asked AS (SELECT {3 * LEVEL} + o_custkey AS parent_ino, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE o_orderkey::varchar END AS name FROM orders
  UNION SELECT {6 * LEVEL} + s_suppkey, 'x' FROM supplier)"""


@query(f"""WITH {SNAPSHOT_SQL}, {_ASKED}, d AS (SELECT DISTINCT ino, kind = 'dir' AS is_dir FROM tree)
SELECT a.parent_ino, a.name, t.ino, CASE WHEN NOT coalesce(d.is_dir, true) THEN 'notdir' WHEN t.ino IS NULL THEN 'noent' ELSE 'ok' END AS status
FROM asked a LEFT JOIN d ON d.ino = a.parent_ino LEFT JOIN tree t ON t.parent_ino = a.parent_ino AND t.name = a.name""")
def lookup_status(spark, sf_dir):
    o = fixtures.read(spark, sf_dir, "orders").select((3 * LEVEL + F.col("o_custkey")).alias("parent_ino"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE cast(o_orderkey AS string) END").alias("name"))
    s = fixtures.read(spark, sf_dir, "supplier").select((6 * LEVEL + F.col("s_suppkey")).alias("parent_ino"), F.lit("x").alias("name"))
    return tree.lookup(_tree(spark, sf_dir), o.unionByName(s).distinct())


@query(f"""WITH {SNAPSHOT_SQL}, n AS (SELECT ino, max(kind) AS kind, max(size) AS size FROM tree WHERE ino >= {5 * LEVEL} GROUP BY ino),
asked AS (SELECT o_orderkey AS batch, unnest([{5 * LEVEL} + o_orderkey * {LINES} + 2, {5 * LEVEL} + o_orderkey * {LINES} + 1, {5 * LEVEL} + o_orderkey * {LINES} + 900]) AS ino, unnest([0, 1, 2]) AS pos FROM orders)
SELECT batch, pos, asked.ino, kind, size FROM asked LEFT JOIN n ON n.ino = asked.ino""")
def stat_batch(spark, sf_dir):
    nodes = _tree(spark, sf_dir).where(f"ino >= {5 * LEVEL}").groupBy("ino").agg(F.max("kind").alias("kind"), F.max("size").alias("size"))
    base = 5 * LEVEL + F.col("o_orderkey") * LINES
    keys = fixtures.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), F.array(*((base + x).cast("bigint") for x in (2, 1, 900))).alias("inos"))
    return tree.stat_batch(nodes, keys).select("batch", "pos", "ino", "kind", "size")


_WANTED = f"""wanted AS (SELECT DISTINCT path FROM (SELECT unnest([path, path || '/', '/' || path || 'x', path || '/./a']) AS path FROM paths WHERE ino < {5 * LEVEL} OR ino >= {6 * LEVEL}))"""


def _wanted(p):
    path = F.col("path")
    return p.where(f"ino < {5 * LEVEL} OR ino >= {6 * LEVEL}").select(F.explode(F.array(path, F.concat(path, F.lit("/")), F.concat(F.lit("/"), path, F.lit("x")), F.concat(path, F.lit("/./a")))).alias("path"))


@query(f"""{PATHS_SQL}, {_WANTED}, n AS (SELECT ino, max(mode) AS mode, max(mtime_sec) AS mtime_sec FROM tree GROUP BY ino),
c AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM wanted), h AS (SELECT c.path, list_contains(parts, '.') AS bad, p.ino, p.kind, p.size FROM c LEFT JOIN paths p ON p.path = '/' || array_to_string(parts, '/')),
r AS (SELECT *, NOT bad AND ino IS NOT NULL AS ok FROM h)
SELECT r.path, ok, CASE WHEN ok THEN r.ino END AS ino, CASE WHEN ok THEN r.kind END AS kind, CASE WHEN ok THEN r.size END AS size, CASE WHEN ok THEN mode END AS mode, CASE WHEN ok THEN mtime_sec END AS mtime_sec,
  CASE WHEN NOT ok THEN r.path || CASE WHEN bad THEN ': invalid path' ELSE ': no such entry' END END AS error FROM r LEFT JOIN n ON n.ino = r.ino""")
def stat_paths(spark, sf_dir):
    """The attributes of every directory and supplier by path, with misses and invalid paths beside each."""
    t = durable(_tree(spark, sf_dir))
    p = durable(tree.paths(t, ROOT))
    # The root has no entry, so its attributes are its path's alone.
    attrs = p.select("ino", "kind", "size").join(t.select("ino", "mode", "mtime_sec"), "ino", "left")
    return command.stat(p, attrs, _wanted(p)).select("path", "ok", "ino", "kind", "size", "mode", "mtime_sec", "error")


@query(f"""{PATHS_SQL}, {_COOKIES}, d AS (SELECT path, ino, kind FROM paths WHERE ino < {5 * LEVEL} OR ino >= {6 * LEVEL}),
e AS (SELECT *, row_number() OVER (PARTITION BY parent_ino ORDER BY cookie) AS place, count(*) OVER (PARTITION BY parent_ino) AS n FROM c)
SELECT d.path, place, e.name, e.kind, e.size, n > 20 AS truncated FROM d JOIN e ON e.parent_ino = d.ino WHERE place <= 20
UNION ALL SELECT path, 1, string_split(path, '/')[-1], kind, (SELECT max(size) FROM tree WHERE tree.ino = d.ino), false FROM d WHERE kind <> 'dir'""")
def ls_paths(spark, sf_dir):
    """Listings of every directory, twenty entries at most; suppliers list themselves."""
    bare = _copied(spark, sf_dir, "kind", "size")
    t = durable(tree.with_cookies(bare).drop("seq"))
    forget(bare)
    p = tree.paths(t, ROOT)
    wanted = p.where(f"ino < {5 * LEVEL} OR ino >= {6 * LEVEL}").select("path")
    out = command.ls(p, t, p.select("ino", "size"), wanted, 20)
    forget(p, t)
    return out


@query(f"""WITH {SNAPSHOT_SQL}, {_COOKIES}, z AS (SELECT *, 8 + 4 + 84 + ((octet_length(encode(name)) + 3) // 4) * 4 AS b, row_number() OVER (PARTITION BY parent_ino ORDER BY cookie) AS rn, count(*) OVER (PARTITION BY parent_ino) AS n FROM c WHERE cookie > 4),
f AS (SELECT *, coalesce(sum(b + 4) OVER (PARTITION BY parent_ino ORDER BY cookie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b + 8 <= 2048 AS fits FROM z WHERE rn <= 4096)
SELECT parent_ino, name, cookie, n <= 4096 AND bool_and(fits) OVER (PARTITION BY parent_ino) AS eof FROM f QUALIFY fits""")
def dir_page_v4(spark, sf_dir):
    """Each directory's page after cookie 4 in 2048 bytes, with 84 bytes of attributes an entry."""
    return tree.page_v4(tree.with_cookies(_tree(spark, sf_dir)), 4, 2048, 84).select("parent_ino", "name", "cookie", "eof")
