"""Queries over the content store."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.operators import cas, command
from driftwood.sources import fixtures
from driftwood.sources.fixtures import LINES_SQL

from .registry import query

SIZE = 1024
_CHUNKS = f"""blob AS (SELECT doc_id AS node, encode(coalesce(text, '')) AS data FROM documents),
cut AS (SELECT node, data, unnest(range(0, octet_length(data), {SIZE})) AS off FROM blob WHERE octet_length(data) > 0),
chunk AS (SELECT node, off, octet_length(data[off + 1 : off + {SIZE}])::bigint AS len, sha256(data[off + 1 : off + {SIZE}]) AS hash FROM cut)"""


def _chunks(spark, sf_dir):
    return cas.chunks(fixtures.blobs(spark, sf_dir), SIZE)


@query(f"WITH {_CHUNKS} SELECT node, off, len, hash FROM chunk")
def cas_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("node", "off", "len", "hash")


@query(f"WITH {_CHUNKS}, known AS (SELECT DISTINCT hash FROM chunk WHERE node % 3 = 0) SELECT hash, min(len) AS len FROM chunk WHERE hash NOT IN (SELECT hash FROM known) GROUP BY hash")
def cas_ingest(spark, sf_dir):
    """Blobs to write when those of every third node are stored already."""
    c = _chunks(spark, sf_dir)
    return cas.new_blobs(c, c.where("node % 3 = 0").select("hash").distinct())


@query(f"WITH {_CHUNKS}, e AS (SELECT hash, max(len) AS len, count(*) AS uses FROM chunk GROUP BY hash) SELECT sum(len * uses)::bigint AS total, sum(len)::bigint AS stored, sum(uses)::bigint AS refs, count(*) AS blobs FROM e")
def cas_dedup_ratio(spark, sf_dir):
    return cas.dedup_ratio(_chunks(spark, sf_dir).drop("data"))


_MANIFEST = "m AS (SELECT node % 5 AS share, node // 3 AS ino, 1 AS gen, node % 3 AS content_version, off, len, hash, node * 1000000 + off AS seq FROM chunk)"


def _manifest(spark, sf_dir):
    c = F.col
    return _chunks(spark, sf_dir).select((c("node") % 5).alias("share"), F.floor(c("node") / 3).alias("ino"), F.lit(1).alias("gen"), (c("node") % 3).alias("content_version"), "off", "len", "hash", (c("node") * 1000000 + c("off")).alias("seq"))


@query(f"""WITH {_CHUNKS}, {_MANIFEST}, v AS (SELECT share, ino, gen, arg_max(content_version, seq) AS content_version FROM m GROUP BY ALL)
SELECT m.share, m.ino, m.gen, m.content_version, m.off, arg_max(m.len, m.seq) AS len, arg_max(m.hash, m.seq) AS hash FROM m JOIN v USING (share, ino, gen, content_version) GROUP BY ALL""")
def cas_manifest(spark, sf_dir):
    return cas.merge_manifests(_manifest(spark, sf_dir))


@query(f"WITH {_CHUNKS}, {_MANIFEST} SELECT ino, CASE WHEN content_version = 1 AND ino % 2 = 0 THEN 9 ELSE content_version END AS content_version, count(*) AS chunks FROM m WHERE ino % 7 <> 0 GROUP BY ALL")
def cas_rebind(spark, sf_dir):
    """Version 1 of even nodes becomes 9; every seventh node is dropped."""
    m = _manifest(spark, sf_dir)
    moves = m.where("ino % 2 = 0").select("ino").distinct().select("ino", F.lit(1).alias("from_version"), F.lit(9).alias("to_version"))
    left = cas.drop_nodes(m, m.where("ino % 7 = 0").select("ino"))
    return cas.rebind(left, moves).groupBy("ino", "content_version").agg(F.count("*").alias("chunks"))


@query(f"WITH {_CHUNKS}, s AS (SELECT hash, min(node) AS node FROM chunk GROUP BY hash) SELECT count(*) AS checked, count(*) FILTER (WHERE node % 10 = 1) AS corrupt, count(*) FILTER (WHERE node % 10 = 2) AS missing FROM s")
def cas_scrub(spark, sf_dir):
    """Blobs first seen in every tenth node are damaged, those of the next are lost."""
    s = _chunks(spark, sf_dir).groupBy("hash").agg(F.min("node").alias("node"), F.min_by("data", "node").alias("data"))
    return cas.scrub(s.select("hash", F.when(F.col("node") % 10 == 1, F.concat(F.col("data"), F.lit(b"x"))).when(F.col("node") % 10 != 2, F.col("data")).alias("data")))


_ROWS = "r AS (SELECT hash, max(len) AS len, 1700000000 + max(node) * 10 AS last FROM chunk GROUP BY hash), t AS (SELECT sum(len) AS total, max(last) + 300 AS now, sum(len) // 2 AS cap FROM r)"


@query(f"""WITH {_CHUNKS}, {_ROWS},
a AS (SELECT r.*, t.*, last <= now - 600 AS free, floor(cap * 0.9) AS target FROM r, t),
b AS (SELECT *, coalesce(sum(CASE WHEN free THEN len END) OVER (ORDER BY last, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p1 FROM a),
c AS (SELECT *, free AND total - p1 > target AS x1 FROM b),
d AS (SELECT *, coalesce(sum(CASE WHEN x1 THEN len END) OVER (), 0) AS freed, coalesce(sum(CASE WHEN NOT x1 THEN len END) OVER (ORDER BY last, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p2 FROM c)
SELECT hash, len, last, CASE WHEN x1 THEN 1 ELSE 2 END AS pass FROM d WHERE x1 OR (total - freed > cap AND total - freed - p2 > target)""")
def cas_evict(spark, sf_dir):
    """Down to 0.9 of half of all bytes."""
    rows = _chunks(spark, sf_dir).groupBy("hash").agg(F.max("len").alias("len"), (1700000000 + F.max("node") * 10).alias("last"))
    t = rows.agg(F.sum("len").alias("total"), F.max("last").alias("last")).first()
    return cas.evict(rows, (t["last"] or 0) + 300, (t["total"] or 0) // 2)


@query(f"""WITH {_CHUNKS} SELECT node, greatest(0, least(octet_length(data), 700 + 500) - 700)::bigint AS n, 700 + 500 >= octet_length(data) AS eof, sha256(data[701:1200]) AS hash FROM blob""")
def cas_read_range(spark, sf_dir):
    b = fixtures.blobs(spark, sf_dir).withColumns({"off": F.lit(700), "len": F.lit(500)})
    return cas.read_range(b).select("node", F.col("n").cast("bigint").alias("n"), "eof", F.sha2("bytes", 256).alias("hash"))


@query(f"""WITH {_CHUNKS}, held AS (SELECT * FROM chunk WHERE NOT (node % 4 = 1 AND off = 2048)),
w AS (SELECT node AS req, node, unnest(range(0, 6)) AS i FROM blob), q AS (SELECT req, w.node, i, len FROM w LEFT JOIN held h ON h.node = w.node AND h.off = i * 1024),
p AS (SELECT req, i, CASE WHEN len IS NULL THEN 0 ELSE greatest(0, least(500 + 5000, i * 1024 + len) - greatest(500, i * 1024)) END AS part, least(500 + 5000, (i + 1) * 1024) - greatest(500, i * 1024) AS full_ FROM q),
z AS (SELECT *, coalesce(max((part < full_)::int) OVER (PARTITION BY req ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM p)
SELECT req, sum(part)::bigint AS n FROM z WHERE gap = 0 GROUP BY req""")
def cas_assemble_read(spark, sf_dir):
    """5000 bytes from 500 of each blob, where some third chunks are missing."""
    held = _chunks(spark, sf_dir).drop("data").where("NOT (node % 4 = 1 AND off = 2048)")
    asked = fixtures.blobs(spark, sf_dir).select(F.col("node").alias("req"), "node", F.lit(500).cast("bigint").alias("off"), F.lit(5000).cast("bigint").alias("len"))
    return cas.assemble_read(asked, held, SIZE)


@query(f"""WITH {_CHUNKS}, s AS (SELECT node, octet_length(data) AS size FROM blob), o AS (SELECT node, off FROM chunk WHERE node % 2 = 0 AND off % 3072 = 0),
b AS (SELECT node, off, 0 AS p FROM o UNION ALL SELECT node, off + 1024, 1 FROM o)
SELECT b.node, off, min(p) = 1 AS prefetch FROM b JOIN s ON s.node = b.node WHERE off < size GROUP BY b.node, off""")
def cas_fetch_plan(spark, sf_dir):
    misses = _chunks(spark, sf_dir).where("node % 2 = 0 AND off % 3072 = 0").select("node", (F.col("off") + 5).alias("off"))
    sizes = fixtures.blobs(spark, sf_dir).select("node", F.octet_length("data").cast("bigint").alias("size"))
    return cas.fetch_plan(misses, sizes, SIZE)


@query(f"WITH {_CHUNKS}, {_ROWS} SELECT hash, greatest(last, 1700003605) AS recent, CASE WHEN 1700003605 - last >= 3600 THEN greatest(last, 1700003605) ELSE last END AS last_access FROM r")
def cas_touch(spark, sf_dir):
    rows = _chunks(spark, sf_dir).groupBy("hash").agg((1700000000 + F.max("node") * 10).alias("last_access"))
    return cas.touch(rows, F.lit(1700003605)).select("hash", "recent", "last_access")


@query(f"""WITH {_CHUNKS}, hit AS (SELECT c.*, row_number() OVER (PARTITION BY hash ORDER BY node, off) > 1 AS known FROM chunk c)
SELECT count(*) FILTER (WHERE known) AS hits, count(*) FILTER (WHERE NOT known) AS misses, sum(len) FILTER (WHERE NOT known)::bigint AS bytes FROM hit""")
def cas_stats(spark, sf_dir):
    """Hits and misses when all blobs are read in order through an empty store, by counts alone."""
    each = _chunks(spark, sf_dir).groupBy("hash").agg(F.max("len").alias("len"), F.count("*").alias("n"))
    return each.agg(F.sum(F.col("n") - 1).alias("hits"), F.count("*").alias("misses"), F.sum("len").alias("bytes"))


@query("SELECT event_id, CASE WHEN event_id % 13 < 5 THEN 'source' ELSE 'cache' END AS route FROM events")
def cas_route(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "events").select("event_id", cas.route(F.col("event_id") % 13).alias("route"))


_RANGES = "rg AS (SELECT l_orderkey AS file, l_linenumber * 10 AS off, l_quantity::bigint AS len FROM lineitem)"


def _ranges(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 10).cast("bigint").alias("off"), F.col("l_quantity").cast("bigint").alias("len"))


_ISLANDS = f"""WITH {_RANGES}, a AS (SELECT *, off + len AS e FROM rg WHERE len > 0),
b AS (SELECT *, off > coalesce(max(e) OVER (PARTITION BY file ORDER BY off, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM a),
c AS (SELECT *, sum(fresh::int) OVER (PARTITION BY file ORDER BY off, e ROWS UNBOUNDED PRECEDING) AS isl FROM b),
i AS (SELECT file, min(off) AS s, max(e) AS e FROM c GROUP BY file, isl)"""


@query(f"{_ISLANDS} SELECT file, s::bigint AS start, e::bigint AS \"end\" FROM i")
def write_islands(spark, sf_dir):
    return cas.islands(_ranges(spark, sf_dir))


@query(f"{_ISLANDS}, z AS (SELECT file, max(off + len) AS size FROM rg GROUP BY file), u AS (SELECT i.*, z.size, unnest(range((s // 16)::bigint, ((e - 1) // 16 + 1)::bigint)) AS c FROM i JOIN z USING (file)) SELECT file, (c * 16)::bigint AS off FROM u WHERE c * 16 >= s AND c * 16 < size AND least(c * 16 + 16, size) <= e")
def write_coverage(spark, sf_dir):
    r = _ranges(spark, sf_dir)
    return cas.covered_chunks(r, r.groupBy("file").agg(F.max(F.col("off") + F.col("len")).alias("size")), 16)


@query(f"""WITH {_RANGES}, b AS (SELECT file, off AS batch, off AS b_off, max(len) AS b_len FROM rg GROUP BY file, off), c AS (SELECT DISTINCT file, file % 40 AS commit, file % 40 AS c_off, file % 40 + 25 AS c_end FROM rg)
SELECT c.file, commit, batch::bigint AS batch FROM c JOIN b ON b.file = c.file AND b_off < c_end AND b_off + b_len > c_off""")
def commit_overlap(spark, sf_dir):
    r = _ranges(spark, sf_dir)
    batches = r.groupBy("file", "off").agg(F.max("len").alias("b_len")).select("file", F.col("off").alias("batch"), F.col("off").alias("b_off"), "b_len")
    f = F.col("file") % 40
    commits = r.select("file", f.alias("commit"), f.alias("c_off"), (f + 25).alias("c_end")).distinct()
    return cas.commit_waits(commits, batches, 16)


_WRITES = f"""{LINES_SQL}, w AS (
  SELECT l_suppkey AS file, l_orderkey * 1024 + ordinal AS arrival, (l_linenumber * 10 + l_orderkey % 97)::bigint AS off, l_quantity::bigint AS len, epoch_us(l_shipdate::timestamp) AS us FROM lines)"""


def _writes(spark, sf_dir):
    line = fixtures.lines(spark, sf_dir)
    arrival = (F.col("l_orderkey") * 1024 + F.col("ordinal")).cast("bigint")
    rows = line.select(F.col("l_suppkey").cast("bigint").alias("file"), arrival.alias("arrival"), (F.col("l_linenumber") * 10 + F.col("l_orderkey") % 97).cast("bigint").alias("off"), F.col("l_quantity").cast("bigint").alias("len"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"))
    return rows.withColumn("data", F.repeat(F.md5(F.col("arrival").cast("string").cast("binary")), 2))


@query(f"""WITH {_WRITES},
edge AS (SELECT DISTINCT file, unnest([off, off + len]) AS pos FROM w WHERE len > 0), seg AS (SELECT file, pos AS s, lead(pos) OVER (PARTITION BY file ORDER BY pos) AS e FROM edge),
top AS (SELECT seg.file, s, e, max(arrival) AS arrival FROM seg JOIN w ON w.file = seg.file AND w.off <= s AND w.off + w.len >= e GROUP BY ALL),
cut AS (SELECT *, sum(fresh::int) OVER (PARTITION BY file, arrival ORDER BY s ROWS UNBOUNDED PRECEDING) AS piece FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY file, arrival ORDER BY s) <> s, true) AS fresh FROM top)),
told AS (SELECT file, arrival, min(s) AS s, max(e) AS e FROM cut GROUP BY file, arrival, piece)
SELECT told.file, s AS start, e AS "end", told.arrival, substring(repeat(md5(told.arrival::varchar), 2), (s - off + 1)::int, (e - s)::int) AS bytes FROM told JOIN w ON w.file = told.file AND w.arrival = told.arrival""")
def write_overlay(spark, sf_dir):
    """The bytes of each file after all its writes in their order of arrival: the newest write wins."""
    w = _writes(spark, sf_dir)
    return cas.overlay_bytes(cas.write_overlay(w), w)


@query(f"""WITH {_WRITES}, z AS (SELECT s_suppkey AS file, abs(floor(s_acctbal))::bigint % 120 AS size, 900000000000000000::bigint AS mtime_ns FROM supplier WHERE s_suppkey % 5 <> 0),
r AS (SELECT w.*, size AS size0, greatest(us * 1000, mtime_ns) AS base, row_number() OVER (PARTITION BY file ORDER BY arrival) AS rn FROM w JOIN z USING (file))
SELECT file, arrival, greatest(size0, max(off + len) OVER p) AS size, max(base - rn) OVER p + rn + 1 AS mtime_ns FROM r WINDOW p AS (PARTITION BY file ORDER BY arrival ROWS UNBOUNDED PRECEDING)""")
def write_unstable(spark, sf_dir):
    """What each unstable write is answered with; files that aren't there have no answer."""
    z = fixtures.read(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").cast("bigint").alias("file"), (F.abs(F.floor("s_acctbal")).cast("bigint") % 120).alias("size"), F.lit(900000000000000000).alias("mtime_ns"))
    return cas.unstable_writes(_writes(spark, sf_dir), z)


def _damaged(spark, sf_dir):
    """Stored blobs; of those first seen in every tenth node the last byte is wrong, those of the next are lost."""
    s = _chunks(spark, sf_dir).groupBy("hash").agg(F.min("node").alias("node"), F.min_by("data", "node").alias("data"), F.max("len").alias("len"))
    data = F.when(F.col("node") % 10 == 1, F.concat(F.expr("substring(data, 1, octet_length(data) - 1)"), F.lit(b"\x00"))).when(F.col("node") % 10 != 2, F.col("data"))
    return s.select("hash", data.alias("data"), "len")


_STATES = "st AS (SELECT hash, max(len) AS len, CASE min(node) % 10 WHEN 1 THEN 'corrupt' WHEN 2 THEN 'missing' ELSE 'ok' END AS state FROM chunk GROUP BY hash)"


@query(f"""WITH {_CHUNKS}, {_STATES}
SELECT state, count(*) AS blobs, sum(len)::bigint AS bytes, state = 'ok' AS kept FROM st GROUP BY state""")
def cas_scrub_drop(spark, sf_dir):
    """A scrub of all blobs, and what is left of them."""
    stored = _damaged(spark, sf_dir)
    looked = cas.scrub_and_drop(stored)
    left = cas.kept(stored, looked).select("hash", F.lit(True).alias("kept"))
    return looked.join(left, "hash", "left").groupBy("state", F.coalesce("kept", F.lit(False)).alias("kept")).agg(F.count("*").alias("blobs"), F.sum("len").alias("bytes"))


@query(f"""WITH {_CHUNKS}, {_STATES}, q AS (SELECT node, off, hash, (node * 37 % 900)::bigint AS lo FROM chunk)
SELECT node, q.off, state, CASE WHEN state = 'ok' THEN greatest(0, least(c.len, lo + 100) - lo) END::bigint AS n, CASE WHEN state = 'ok' THEN sha256(c.data[q.off + lo + 1 : q.off + least(c.len, lo + 100)]) END AS bytes_sha256
FROM q JOIN st USING (hash) JOIN (SELECT chunk.node, chunk.off, chunk.len, blob.data FROM chunk JOIN blob ON blob.node = chunk.node) c USING (node, off)""")
def cas_verified_reads(spark, sf_dir):
    """A hundred bytes of each chunk of each manifest, out of blobs that are hashed before they are read."""
    asked = _chunks(spark, sf_dir).select(F.struct("node", "off").alias("req"), "hash", (F.col("node") * 37 % 900).cast("bigint").alias("off"), F.lit(100).cast("bigint").alias("len"))
    got = cas.verified_read(asked, _damaged(spark, sf_dir))
    return got.select("req.node", "req.off", "state", "n", F.sha2("bytes", 256).alias("bytes_sha256"))


@query(f"""WITH {_CHUNKS}, k AS (SELECT hash, max(len) AS len, 1700000000 + max(node) * 10 AS last FROM chunk WHERE node % 3 = 0 GROUP BY hash), f AS (SELECT hash, max(len) AS len FROM chunk WHERE node % 3 <> 0 GROUP BY hash),
r AS (SELECT hash, coalesce(k.len, f.len) AS len, CASE WHEN f.hash IS NOT NULL THEN 1800000000 ELSE last END AS last, k.hash IS NULL AS fresh FROM k FULL JOIN f USING (hash)),
a AS (SELECT *, last <= 1800000000 - 600 AS free, sum(len) OVER () AS total, (SELECT sum(len) * 9 // 10 FROM r) AS cap FROM r),
b AS (SELECT *, coalesce(sum(CASE WHEN free THEN len END) OVER (ORDER BY last, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p1, floor(cap * 0.9) AS target FROM a),
c AS (SELECT *, free AND total - p1 > target AS x1 FROM b),
d AS (SELECT *, coalesce(sum(CASE WHEN x1 THEN len END) OVER (), 0) AS freed, coalesce(sum(CASE WHEN NOT x1 THEN len END) OVER (ORDER BY last, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p2 FROM c)
SELECT hash, len::bigint AS len, last::bigint AS last, fresh FROM d WHERE NOT (x1 OR (total - freed > cap AND total - freed - p2 > target))""")
def cas_ingest_chain(spark, sf_dir):
    """The store after two thirds of the nodes have come to that of the others, with room for nine tenths of both."""
    c = _chunks(spark, sf_dir).select("node", "hash", "len")
    known = c.where("node % 3 = 0").groupBy("hash").agg(F.max("len").alias("len"), (1700000000 + F.max("node") * 10).alias("last"))
    room = c.groupBy("hash").agg(F.max("len").alias("len")).agg(F.floor(F.sum("len") * 9 / 10)).first()[0] or 0
    return cas.ingest(c.where("node % 3 <> 0"), known, 1800000000, room)


@query("""SELECT doc_id, coalesce(lang, '') <> 'fr' AS ok, CASE WHEN ok THEN octet_length(encode(coalesce(text, ''))) END AS size, CASE WHEN ok THEN least(octet_length(encode(coalesce(text, ''))), 4096) END AS returned,
  CASE WHEN ok THEN octet_length(encode(coalesce(text, ''))) > 4096 END AS truncated, CASE WHEN ok THEN md5(base64(encode(coalesce(text, ''))[1:4096])) END AS data_md5, CASE WHEN NOT ok THEN 'not a regular file' END AS error FROM documents""")
def cat_files(spark, sf_dir):
    """Each document as a file, those in one language as something else; 4096 bytes at most."""
    d = fixtures.read(spark, sf_dir, "documents")
    files = d.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.when(F.col("lang") == "fr", "fifo").otherwise("file").alias("kind"))
    return command.cat(files, 4096).select("doc_id", "ok", "size", "returned", "truncated", F.md5(F.col("data_b64").cast("binary")).alias("data_md5"), "error")
