"""Queries of the client surface: attributes, overlay, leases, discovery, mutations, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.functions import scalars
from driftwood.operators import access, conflict, histogram, lease, mutate, overlay, report, tree
from driftwood.sources import discovery, fixtures
from driftwood.sources.fixtures import JOURNAL_SQL, LEVEL, OPENS_SQL, SNAPSHOT_SQL

from .registry import query

_ATTR = "a AS (SELECT event_id AS ino, CASE event_id % 3 WHEN 0 THEN 'dir' WHEN 1 THEN 'file' ELSE 'symlink' END AS kind, (event_id * 37 % 512)::int AS mode, (event_id % 64)::int AS requested, event_id % 5 = 0 AS writable, floor(value)::bigint AS size, (event_id * 8589934597) % 4611686018427387904 AS rdev, event_id * 9999991 AS sec FROM events)"


def _attrs(spark, sf_dir):
    c, i = F.col, F.col("event_id")
    return fixtures.read(spark, sf_dir, "events").select(i.alias("ino"), F.when(i % 3 == 0, "dir").when(i % 3 == 1, "file").otherwise("symlink").alias("kind"), (i * 37 % 512).cast("int").alias("mode"), (i % 64).cast("int").alias("requested"), (i % 5 == 0).alias("writable"), F.floor(c("value")).cast("bigint").alias("size"), (i * 8589934597 % 4611686018427387904).alias("rdev"), (i * 9999991).alias("sec"))


@query(f"""WITH {_ATTR} SELECT ino, (CASE WHEN mode & 256 <> 0 THEN 1 ELSE 0 END + CASE WHEN kind = 'dir' THEN 2 ELSE 0 END + CASE WHEN mode & 64 <> 0 AND kind <> 'dir' THEN 32 ELSE 0 END + CASE WHEN writable THEN 28 ELSE 0 END) & requested AS granted FROM a""")
def access_bits(spark, sf_dir):
    c = F.col
    return _attrs(spark, sf_dir).select("ino", access.access_bits(c("kind"), c("mode"), c("requested"), c("writable")).alias("granted"))


@query(f"""WITH {_ATTR} SELECT ino, CASE kind WHEN 'file' THEN 1 WHEN 'dir' THEN 2 ELSE 5 END AS type, mode, size, (size // 512) * 512 AS used, rdev >> 32 AS rdev_major, rdev & 4294967295 AS rdev_minor, sec & 4294967295 AS atime, sec & 4294967295 AS mtime, (sec + 1) & 4294967295 AS ctime FROM a""")
def fattr_projection(spark, sf_dir):
    a = _attrs(spark, sf_dir).withColumns({"blocks": F.floor(F.col("size") / 512), "mtime_sec": F.col("sec"), "ctime_sec": F.col("sec") + 1})
    return access.wire_attrs(a)


@query(f"""WITH {_ATTR} SELECT ino, CASE kind WHEN 'dir' THEN 'd' WHEN 'file' THEN '-' ELSE 'l' END || (mode >> 6)::varchar || ((mode >> 3) & 7)::varchar || (mode & 7)::varchar AS text FROM a""")
def mode_string(spark, sf_dir):
    return _attrs(spark, sf_dir).select("ino", scalars.mode_string(F.col("kind"), F.col("mode")).alias("text"))


@query(f"""WITH {_ATTR}, b AS (SELECT ino, (ino * 7919 % 1048576) & 718847 AS w FROM a) SELECT ino, array_to_string(list_filter(range(0, 63), lambda i: (w >> i::bigint) & 1 = 1), ',') AS attrs FROM b""")
def attr_bitmap(spark, sf_dir):
    """718847 stands for what is supported."""
    return _attrs(spark, sf_dir).select("ino", F.array_join(access.requested_attrs(F.col("ino") * 7919 % 1048576, 718847).cast("array<string>"), ",").alias("attrs"))


@query(f"""WITH {_ATTR} SELECT ino, CASE WHEN ino % 4 = 0 THEN 448 ELSE mode END AS mode, CASE WHEN ino % 4 = 0 AND ino % 3 = 0 THEN 0 ELSE size END AS size, 501 AS uid, 20 AS gid FROM a""")
def partial_update(spark, sf_dir):
    a = _attrs(spark, sf_dir).select("ino", "mode", "size")
    changes = a.where("ino % 4 = 0").select("ino", F.lit(448).alias("mode"), F.when(F.col("ino") % 3 == 0, 0).cast("bigint").alias("size"))
    return access.squash(access.update(a, changes, ("mode", "size")), 501, 20)


_CMD = f"""cmds AS (SELECT o_orderkey AS seq, CASE o_orderkey % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'remove' WHEN 2 THEN 'rmdir' WHEN 3 THEN 'rename' WHEN 4 THEN 'setattr' ELSE 'write' END AS cmd,
  {3 * LEVEL} + o_custkey AS parent_ino, CASE WHEN o_orderkey % 11 = 0 THEN '..' WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderkey::varchar END AS name FROM orders)"""


@query(f"""WITH {SNAPSHOT_SQL}, {_CMD}, r AS (SELECT c.*, row_number() OVER (PARTITION BY c.parent_ino, c.name, cmd ORDER BY c.seq) AS rank, t.ino, t.kind AS k FROM cmds c LEFT JOIN tree t ON t.parent_ino = c.parent_ino AND t.name = c.name),
s AS (SELECT *, CASE WHEN name = '..' THEN 'inval' WHEN cmd = 'create' AND (ino IS NOT NULL OR rank > 1) THEN 'exist' WHEN cmd <> 'create' AND ino IS NULL THEN 'noent' WHEN cmd = 'remove' AND k = 'dir' THEN 'isdir' WHEN cmd = 'rmdir' AND k <> 'dir' THEN 'notdir'
  WHEN cmd = 'rmdir' AND ino IN (SELECT parent_ino FROM tree) THEN 'notempty' WHEN cmd = 'write' AND k = 'dir' THEN 'isdir' ELSE 'ok' END AS status FROM r)
SELECT seq, status, CASE WHEN status = 'ok' THEN CASE cmd WHEN 'create' THEN 'created' WHEN 'remove' THEN 'removed' WHEN 'rmdir' THEN 'removed' WHEN 'rename' THEN 'renamed' WHEN 'setattr' THEN 'attr' ELSE 'content' END END AS op FROM s""")
def mutation_plan(spark, sf_dir):
    t = tree.assemble(fixtures.snapshot(spark, sf_dir))
    k = F.col("o_orderkey")
    asked = fixtures.read(spark, sf_dir, "orders").select(k.alias("seq"), F.element_at(F.lit(["create", "remove", "rmdir", "rename", "setattr", "write"]), (k % 6 + 1).cast("int")).alias("cmd"), (3 * LEVEL + F.col("o_custkey")).alias("parent_ino"), F.when(k % 11 == 0, "..").when(k % 7 == 0, "new").otherwise(k.cast("string")).alias("name"))
    return mutate.plan(t.select("parent_ino", "name", "ino", "kind"), asked).select("seq", "status", "op")


_SIDE = """rl AS (SELECT c_nationkey AS parent, c_name AS name, c_custkey AS ino, 'file' AS kind FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT c_nationkey, '._' || c_name, c_custkey + 1000000, 'file' FROM customer WHERE c_custkey % 15 = 0 UNION ALL SELECT NULL, n_name, n_nationkey, 'dir' FROM nation WHERE n_nationkey % 8 <> 0),
sd AS (SELECT c_nationkey % 4 AS share, c_nationkey AS parent, '._' || c_name AS name, c_custkey + 2000000 AS ino, 'file' AS kind, 1700000000 + c_custkey AS mtime_sec, (c_custkey * 997 % 4096)::bigint AS len FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_nationkey % 4, c_nationkey, 'plain' || c_custkey, c_custkey + 3000000, 'file', 1700000000 + c_custkey, 5 FROM customer WHERE c_custkey % 50 = 0)"""


def _overlay(spark, sf_dir):
    c, k = fixtures.read(spark, sf_dir, "customer"), F.col("c_custkey")
    n = fixtures.read(spark, sf_dir, "nation").where("n_nationkey % 8 <> 0").select(F.lit(None).cast("bigint").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("ino"), F.lit("dir").alias("kind"))
    parent = F.col("c_nationkey").cast("bigint").alias("parent")
    real = c.where("c_custkey % 9 <> 0").select(parent, F.col("c_name").alias("name"), k.alias("ino"), F.lit("file").alias("kind")).unionByName(c.where("c_custkey % 15 = 0").select(parent, F.concat(F.lit("._"), "c_name").alias("name"), (k + 1000000).alias("ino"), F.lit("file").alias("kind"))).unionByName(n)
    row = lambda name, off, length: [(F.col("c_nationkey") % 4).alias("share"), parent, name.alias("name"), (k + off).alias("ino"), F.lit("file").alias("kind"), (k + 1700000000).alias("mtime_sec"), length.cast("bigint").alias("len")]
    side = c.where("c_custkey % 3 = 0").select(*row(F.concat(F.lit("._"), "c_name"), 2000000, k * 997 % 4096)).unionByName(c.where("c_custkey % 50 = 0").select(*row(F.concat(F.lit("plain"), k), 3000000, F.lit(5))))
    return real, side


@query(f"WITH {_SIDE} SELECT parent, name, 'real' AS origin FROM rl UNION ALL SELECT parent, name, 'side' FROM sd s WHERE starts_with(name, '._') AND NOT EXISTS (SELECT 1 FROM rl WHERE rl.parent = s.parent AND rl.name = s.name)")
def overlay_visible(spark, sf_dir):
    return overlay.visible(*_overlay(spark, sf_dir))


@query(f"""WITH {_SIDE}, d AS (SELECT *, NOT EXISTS (SELECT 1 FROM rl WHERE kind = 'dir' AND rl.ino = sd.parent) AS lost, starts_with(name, '._') AND NOT EXISTS (SELECT 1 FROM rl WHERE rl.parent = sd.parent AND '._' || rl.name = sd.name) AND 1700000100 - mtime_sec > 60 AS alone FROM sd)
SELECT parent, name, CASE WHEN lost THEN 'parent' ELSE 'anchor' END AS reason FROM d WHERE lost OR alone""")
def overlay_gc(spark, sf_dir):
    real, side = _overlay(spark, sf_dir)
    return overlay.orphans(real, side, 1700000100)


@query(f"""WITH {_SIDE}, t AS (SELECT *, sum(len) OVER (PARTITION BY share) - coalesce(sum(len) OVER (PARTITION BY share ORDER BY mtime_sec, parent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM sd) SELECT share, parent, name, len FROM t WHERE lft > 10000""")
def overlay_evict(spark, sf_dir):
    return overlay.evict(_overlay(spark, sf_dir)[1], 10000)


@query(f"""WITH {_SIDE}, q AS (SELECT c_nationkey AS parent, CASE WHEN c_custkey % 2 = 0 THEN '._' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'symlink' ELSE 'file' END AS kind, c_custkey AS seq FROM customer)
SELECT q.parent, q.name, seq, CASE WHEN q.kind NOT IN ('file', 'dir') OR NOT starts_with(q.name, '._') THEN 'access' WHEN sd.name IS NOT NULL THEN 'exist' ELSE 'ok' END AS status FROM q LEFT JOIN sd ON sd.parent = q.parent AND sd.name = q.name""")
def overlay_create(spark, sf_dir):
    k = F.col("c_custkey")
    asked = fixtures.read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("parent"), F.when(k % 2 == 0, F.concat(F.lit("._"), "c_name")).otherwise(F.col("c_name")).alias("name"), F.when(k % 7 == 0, "symlink").otherwise("file").alias("kind"), k.alias("seq"))
    return overlay.create(_overlay(spark, sf_dir)[1], asked)


@query(f"WITH {_SIDE} SELECT parent, name FROM sd WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 12 = 0 AND c_nationkey = sd.parent AND (sd.name = c_name OR sd.name = '._' || c_name))")
def overlay_remove(spark, sf_dir):
    asked = fixtures.read(spark, sf_dir, "customer").where("c_custkey % 12 = 0").select(F.col("c_nationkey").cast("bigint").alias("parent"), F.col("c_name").alias("name"))
    return overlay.remove(_overlay(spark, sf_dir)[1], asked).select("parent", "name")


_LIFE = f"""WITH {OPENS_SQL}, s AS (SELECT *, epoch_us(ts) AS us, coalesce(sum((kind = 'return')::int) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM leases),
h AS (SELECT *, coalesce(max((kind = 'open')::int) OVER p, 0) = 1 AS held FROM s WINDOW p AS (PARTITION BY node, span ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, min(CASE WHEN kind = 'inval' AND held THEN us END) OVER (PARTITION BY node, span ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rc FROM h),
life AS (SELECT node, seq, us, CASE WHEN kind = 'open' AND NOT held THEN 'granted' WHEN kind = 'inval' AND held AND rc IS NULL THEN 'recalled' WHEN kind = 'return' AND held THEN 'returned' ELSE 'none' END AS effect, CASE WHEN kind = 'return' AND held THEN us - rc END AS latency_us FROM r)"""


def _life(spark, sf_dir):
    return lease.lifecycle(fixtures.opens(spark, sf_dir).withColumn("us", conflict.micros()))


@query(f"{_LIFE} SELECT node, seq, effect, latency_us FROM life")
def lease_lifecycle(spark, sf_dir):
    return _life(spark, sf_dir).select("node", "seq", "effect", "latency_us")


@query(f"{_LIFE} SELECT count(*) FILTER (WHERE effect = 'granted') AS granted, count(*) FILTER (WHERE effect = 'recalled') AS recalls, count(*) FILTER (WHERE effect = 'returned') AS returned, count(*) FILTER (WHERE effect = 'granted') - count(*) FILTER (WHERE effect = 'returned') AS held FROM life")
def lease_report(spark, sf_dir):
    return lease.report(_life(spark, sf_dir))


_CAP = 40
_LEASE_EVENTS = f"""{OPENS_SQL}, ev AS (SELECT node, seq, epoch_us(ts) AS us, kind, seq % 5 <> 0 AND seq % 7 <> 0 AS may, seq % 4 <> 0 AS bound, row_number() OVER (ORDER BY seq) AS n FROM leases)"""


@query(f"""WITH RECURSIVE {_LEASE_EVENTS},
w AS (
  SELECT 0::bigint AS n, NULL::bigint AS node, NULL::bigint AS seq, 'none' AS effect, []::bigint[] AS held, []::bigint[] AS asked
  UNION ALL
  SELECT n, node, seq, effect,
    CASE effect WHEN 'granted' THEN list_append(held, node) WHEN 'returned' THEN list_filter(held, lambda x: x <> node) WHEN 'revoked' THEN list_filter(held, lambda x: x <> node) ELSE held END,
    CASE effect WHEN 'recalled' THEN list_append(asked, node) WHEN 'returned' THEN list_filter(asked, lambda x: x <> node) ELSE asked END
  FROM (SELECT ev.n, ev.node, ev.seq, held, asked, CASE
      WHEN kind = 'open' THEN CASE WHEN NOT may OR list_contains(held, ev.node) THEN 'none' WHEN len(held) < {_CAP} THEN 'granted' ELSE 'refused' END
      WHEN NOT list_contains(held, ev.node) THEN 'none' WHEN kind = 'return' THEN 'returned' WHEN list_contains(asked, ev.node) THEN 'none' WHEN bound THEN 'recalled' ELSE 'revoked' END AS effect
    FROM w JOIN ev ON ev.n = w.n + 1))
SELECT node, seq, effect FROM w WHERE n > 0""")
def lease_admission(spark, sf_dir):
    """Leases under a cap of 40, with revocation."""
    seq = F.col("seq")
    events = fixtures.opens(spark, sf_dir).select("node", "seq", conflict.micros().alias("us"), "kind", ((seq % 5 != 0) & (seq % 7 != 0)).alias("may"), (seq % 4 != 0).alias("bound"))
    return lease.admission(events, cap=_CAP, block=2000).select("node", "seq", "effect")


@query(f"""{_LIFE}, k AS (SELECT node % 4 AS share, latency_us, row_number() OVER (PARTITION BY node % 4 ORDER BY latency_us) - 1 AS rn, count(*) OVER (PARTITION BY node % 4) AS n FROM life WHERE latency_us IS NOT NULL)
SELECT share, max(n) AS n_samples, max(latency_us) FILTER (WHERE rn = floor((n - 1) * 0.5 + 0.5)) AS p50, max(latency_us) FILTER (WHERE rn = floor((n - 1) * 0.99 + 0.5)) AS p99, max(latency_us) AS max FROM k GROUP BY share""")
def recall_percentiles(spark, sf_dir):
    return lease.exact_percentiles(_life(spark, sf_dir).withColumn("share", F.col("node") % 4), "latency_us", "share", {"p50": 0.5, "p99": 0.99, "max": 1.0})


_POINTS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@query(f"""WITH v AS (SELECT user_id % 4 AS share, floor(value * 1000)::bigint AS v FROM events WHERE value >= 0),
b AS (SELECT share, v, greatest(0, length(ltrim(bin(v), '0')) - 11) AS sh FROM v),
h AS (SELECT share, (v >> sh) << sh AS low, ((v >> sh) << sh) + (1::bigint << sh) - 1 AS top, count(*) AS n FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY share ORDER BY low) AS upto, sum(n) OVER (PARTITION BY share) AS total FROM h)
SELECT share, max(total)::bigint AS n_values, {", ".join(f"min(top) FILTER (WHERE upto >= greatest(1, floor(total * {p}::double + 0.5))) AS {name}" for name, p in _POINTS.items())}, max(top) AS max FROM c GROUP BY share""")
def histogram_quantiles(spark, sf_dir):
    """Quantiles of the events' values in thousandths, from two histograms that are merged."""
    e = fixtures.read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("share"), F.floor(F.col("value") * 1000).cast("bigint").alias("v"))
    parts = (histogram.histogram(e.where(F.col("event_id") % 2 == i), "share", "v") for i in range(2))
    return histogram.quantiles(histogram.merge("share", *parts), "share", _POINTS)


@query("""WITH RECURSIVE c AS (SELECT user_id AS slot, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 3 <> 0 AS cached, event_id FROM events),
d AS (SELECT slot, n, cached, CASE WHEN event_id % 4 = 0 THEN greatest(1, n // 2) ELSE n - n // 4 END AS seqid FROM c),
w AS (SELECT slot, 0::bigint AS n, 0::bigint AS s, NULL::boolean AS k, NULL::varchar AS status FROM (SELECT DISTINCT slot FROM d)
  UNION ALL SELECT d.slot, d.n, CASE WHEN d.seqid = w.s + 1 THEN d.seqid ELSE w.s END, CASE WHEN d.seqid = w.s + 1 THEN d.cached ELSE w.k END,
    CASE WHEN d.seqid = w.s + 1 THEN 'execute' WHEN d.seqid <> w.s OR w.k IS NULL THEN 'misordered' WHEN w.k THEN 'replay' ELSE 'retry_uncached' END FROM w JOIN d ON d.slot = w.slot AND d.n = w.n + 1)
SELECT slot, n, status FROM w WHERE n > 0""")
def slot_replay(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    c = fixtures.read(spark, sf_dir, "events").select(F.col("user_id").alias("slot"), n.alias("n"), (F.col("event_id") % 3 != 0).alias("cached"), "event_id")
    return lease.slot_replay(c.withColumn("seqid", F.when(F.col("event_id") % 4 == 0, F.greatest(F.lit(1), F.floor(F.col("n") / 2))).otherwise(F.col("n") - F.floor(F.col("n") / 4))))


@query("""WITH c AS (SELECT user_id AS owner, event_id AS n, event_id // 300 % 3 AS verifier FROM events), f AS (SELECT *, coalesce(lag(verifier) OVER w <> verifier, false) AS dropped, coalesce(lag(verifier) OVER w <> verifier, true) AS fresh FROM c WINDOW w AS (PARTITION BY owner ORDER BY n))
SELECT owner, n, dropped, sum(fresh::int) OVER (PARTITION BY owner ORDER BY n ROWS UNBOUNDED PRECEDING)::bigint AS client FROM f""")
def client_table(spark, sf_dir):
    c = fixtures.read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("n"), (F.floor(F.col("event_id") / 300) % 3).alias("verifier"))
    return lease.clients(c).select("owner", "n", "dropped", "client")


@query("""WITH o AS (SELECT user_id, event_id, floor(value / 40)::bigint AS v, epoch_us(ts) AS us FROM events), c AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM o),
g AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM c WHERE was IS NULL OR was <> v) SELECT user_id, median(gap) AS median_gap, count(*) AS changes FROM g WHERE gap IS NOT NULL GROUP BY user_id""")
def freshness_median(spark, sf_dir):
    o = fixtures.read(spark, sf_dir, "events").select("user_id", F.floor(F.col("value") / 40).alias("v"), conflict.micros().alias("us"))
    return report.freshness(o, "user_id", "us", "v")


_LINE = """CASE event_id % 9 WHEN 0 THEN 'not ok 1 - tried ''-u 65534 chmod f 0644'', expected 0' WHEN 1 THEN 'not ok 2 - tried ''chown f 0 0'', got EPERM' WHEN 2 THEN 'not ok 3 - tried ''lchown f 1 1''' WHEN 3 THEN 'not ok 4 - tried ''link a b''' WHEN 4 THEN 'not ok 5 - tried ''open f'', got EOPNOTSUPP'
  WHEN 5 THEN 'not ok 6 - tried ''open x'', expected ENAMETOOLONG' WHEN 6 THEN 'not ok 7 - tried ''mkfifo f 0644''' WHEN 7 THEN 'not ok 8 - tried ''rename a b'', got EXDEV' ELSE 'not ok 9 - tried ''chown -u 1'' -g 2' END"""


@query(f"""WITH l AS (SELECT user_id % 3 AS area, {_LINE} AS line FROM events),
b AS (SELECT area, CASE WHEN regexp_matches(line, 'tried ''.*-[ug] ') THEN 'perm' WHEN regexp_matches(line, 'tried ''l?chown') THEN 'chown' WHEN regexp_matches(line, 'tried ''(link|mkfifo|mknod|bind)|got (EOPNOTSUPP|ENOTSUP)') THEN 'notsupp' WHEN contains(line, 'expected ENAMETOOLONG') THEN 'ntl' ELSE 'other' END AS bucket FROM l)
SELECT area, bucket, count(*) AS n FROM b GROUP BY ALL""")
def failure_buckets(spark, sf_dir):
    lines = fixtures.read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("area"), F.expr(_LINE.replace("''", "\\'")).alias("line"))
    return lines.groupBy("area", report.failure_bucket(F.col("line")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {JOURNAL_SQL}, s AS (SELECT share % 2 AS vm, share, count(DISTINCT node_ino) AS nodes FROM journal GROUP BY share) SELECT vm, string_agg(share || ':live:' || nodes, ',' ORDER BY share) AS shares, sum(nodes)::bigint AS nodes FROM s GROUP BY vm""")
def status_report(spark, sf_dir):
    j = fixtures.journal(spark, sf_dir).groupBy("share").agg(F.countDistinct("node_ino").alias("nodes")).select((F.col("share") % 2).alias("vm"), "share", F.lit("live").alias("state"), "nodes")
    return report.status(j).withColumn("shares", F.array_join(F.transform("shares", lambda x: F.concat_ws(":", x["share"], x["state"], x["nodes"])), ","))


@query("""WITH c AS (SELECT CASE WHEN value > 190 THEN 'fail' WHEN value > 150 THEN 'warn' ELSE 'ok' END AS r FROM events) SELECT count(*) FILTER (WHERE r = 'ok') AS ok, count(*) FILTER (WHERE r = 'warn') AS warn, count(*) FILTER (WHERE r = 'fail') AS fail, CASE WHEN bool_or(r = 'fail') THEN 2 WHEN bool_or(r = 'warn') THEN 1 ELSE 0 END AS exit_code FROM c""")
def doctor_report(spark, sf_dir):
    c = fixtures.read(spark, sf_dir, "events").select(F.when(F.col("value") > 190, "fail").when(F.col("value") > 150, "warn").otherwise("ok").alias("result"))
    return report.doctor(c)


@query("SELECT user_id, bit_and(event_id | 5) AS features FROM events GROUP BY user_id")
def feature_negotiation(spark, sf_dir):
    e = fixtures.read(spark, sf_dir, "events").select("user_id", F.col("event_id").bitwiseOR(5).alias("f"))
    return report.negotiate(e, "user_id", "f")


@query("""WITH u AS (SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'zz' || md5(event_id::varchar) WHEN event_id % 4 = 2 THEN upper(md5(event_id::varchar)) ELSE substr(md5(event_id::varchar), 1, 8) || '-' || substr(md5(event_id::varchar), 9) END AS s FROM events)
SELECT event_id, CASE WHEN regexp_full_match(replace(s, '-', ''), '[0-9A-Fa-f]{32}') THEN lower(replace(s, '-', '')) END AS uuid FROM u""")
def uuid_parse(spark, sf_dir):
    m = F.md5(F.col("event_id").cast("string").cast("binary"))
    k = F.col("event_id") % 4
    s = F.when(k == 3, F.concat(F.lit("zz"), m)).when(k == 2, F.upper(m)).otherwise(F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 40)))
    return fixtures.read(spark, sf_dir, "events").select("event_id", scalars.uuid_parse(s).alias("uuid"))


_IPS = "ips AS (SELECT DISTINCT (167772160 + event_id * 65793 % 16777216 + CASE WHEN event_id % 3 = 0 THEN 3064988672 - 167772160 ELSE 0 END)::bigint AS n FROM events), nets AS (SELECT 167772160 + n_nationkey * 65536 AS net, 16 AS bits, n_name AS name FROM nation UNION ALL SELECT 167772160, 8, 'ten')"


@query(f"""WITH {_IPS} SELECT (n >> 24)::varchar || '.' || ((n >> 16) & 255)::varchar || '.' || ((n >> 8) & 255)::varchar || '.' || (n & 255)::varchar AS ip, name, bits FROM ips JOIN nets ON n >> (32 - bits)::bigint = net >> (32 - bits)::bigint""")
def cidr_candidates(spark, sf_dir):
    i = F.col("event_id")
    ips = fixtures.read(spark, sf_dir, "events").select((167772160 + i * 65793 % 16777216 + F.when(i % 3 == 0, 3064988672 - 167772160).otherwise(0)).alias("n")).distinct().withColumn("ip", scalars.int_to_ipv4(F.col("n")))
    n = fixtures.read(spark, sf_dir, "nation").select((167772160 + F.col("n_nationkey").cast("bigint") * 65536).alias("net"), F.lit(16).alias("bits"), F.col("n_name").alias("name"))
    nets = n.unionByName(spark.createDataFrame([(167772160, 8, "ten")], "net bigint, bits int, name string"))
    return discovery.in_network(ips, nets).select("ip", "name", "bits")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 5 = 0 THEN false ELSE event_id % 7 = event_id % 11 END AS ok FROM events""")
def identity_match(spark, sf_dir):
    i = F.col("event_id")
    return fixtures.read(spark, sf_dir, "events").select("event_id", discovery.identity_ok(F.when(i % 5 != 0, i % 7), F.when(i % 3 != 0, i % 11)).alias("ok"))


@query("""WITH u AS (SELECT o_custkey % 97 AS ip, 0 AS source, o_orderkey AS no FROM orders UNION ALL SELECT s_suppkey % 120, 1, s_suppkey FROM supplier), b AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY source, no) AS rn FROM u) SELECT ip, source, no FROM b WHERE rn = 1""")
def candidate_union(spark, sf_dir):
    """Candidates of all orders."""
    o = fixtures.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("ip"), F.col("o_orderkey").alias("no"))
    s = fixtures.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 120).alias("ip"), F.col("s_suppkey").alias("no"))
    return discovery.candidates([o, s])
