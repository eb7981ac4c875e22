"""Queries over the change journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.functions import scalars
from driftwood.operators import conflict, feed, journal
from driftwood.sources import fixtures
from driftwood.sources.fixtures import JOURNAL_SQL

from .registry import query


@query(f"""WITH {JOURNAL_SQL} SELECT share, node_ino,
  arg_max(mode, seq) FILTER (WHERE op IN ('created', 'attr')) AS mode, arg_max(size, seq) FILTER (WHERE op IN ('created', 'attr', 'content')) AS size,
  arg_max(ts, seq) FILTER (WHERE op IN ('created', 'attr', 'content')) AS mtime, count(*) FILTER (WHERE op = 'content') AS content_version, arg_max(op, seq) AS last_op, max(seq) AS last_seq
FROM journal GROUP BY share, node_ino""")
def journal_latest_state(spark, sf_dir):
    return journal.latest_state(fixtures.journal(spark, sf_dir))


@query(f"WITH {JOURNAL_SQL} SELECT seq, share, node_ino, row_number() OVER (PARTITION BY share, node_ino ORDER BY seq) AS version FROM journal WHERE op = 'content'")
def journal_version_counter(spark, sf_dir):
    return journal.version_counter(fixtures.journal(spark, sf_dir)).select("seq", "share", "node_ino", "version")


@query(f"""WITH {JOURNAL_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY share ORDER BY seq) AS q FROM journal),
k AS (SELECT share, q, lag(q + 1) OVER (PARTITION BY share ORDER BY q) AS expected FROM s WHERE (seq - 1) % 97 <> 0)
SELECT share, expected, q AS got, q - expected AS missing FROM k WHERE expected <> q""")
def journal_gap_report(spark, sf_dir):
    """Every 97th event is lost on the way."""
    kept = journal.share_seq(fixtures.journal(spark, sf_dir)).where("(seq - 1) % 97 <> 0")
    return journal.gaps(kept.select("share", F.col("share_seq").alias("first_seq"), F.lit(1).alias("n")))


_SIZE = "CASE op WHEN 'created' THEN 48 + octet_length(encode(name)) WHEN 'removed' THEN 24 + octet_length(encode(name)) WHEN 'attr' THEN 64 WHEN 'content' THEN 40 ELSE 8 END"


#: A size that batches of 512 of these records reach now and then, so that both rules end batches.
_FULL = 22_900


@query(f"""WITH RECURSIVE {JOURNAL_SQL}, s AS (SELECT share, row_number() OVER (PARTITION BY share ORDER BY seq) AS q, ({_SIZE})::bigint AS size FROM journal),
p AS (SELECT *, sum(size) OVER (PARTITION BY share ORDER BY q) - size AS before FROM s),
e AS MATERIALIZED (SELECT share, q, least(512, count(*) OVER (PARTITION BY share ORDER BY before RANGE BETWEEN CURRENT ROW AND {_FULL - 1} FOLLOWING)) AS n FROM p),
b AS (SELECT share, 0::bigint AS batch, q, n FROM e WHERE q = 1 UNION ALL SELECT e.share, batch + 1, e.q, e.n FROM b JOIN e ON e.share = b.share AND e.q = b.q + b.n)
SELECT b.share, batch, b.q AS first_seq, n, sum(size)::bigint AS bytes FROM b JOIN s ON s.share = b.share AND s.q >= b.q AND s.q < b.q + b.n GROUP BY ALL""")
def journal_microbatch(spark, sf_dir):
    return journal.micro_batches(fixtures.journal(spark, sf_dir), max_bytes=_FULL)


@query(f"WITH {JOURNAL_SQL} SELECT (seq - 1) // 512 AS batch, share, node_ino, min(seq) AS seq FROM journal WHERE in_progress GROUP BY ALL")
def journal_coalesce_modify(spark, sf_dir):
    return journal.coalesce_modify(fixtures.journal(spark, sf_dir))


_MASK = "(1 << (event_id % 11)) | (1 << ((event_id // 11) % 11)) | CASE WHEN event_id % 23 = 0 THEN 268435456 ELSE 0 END"


@query(f"""WITH m AS (SELECT event_id, ({_MASK})::bigint AS mask FROM events)
SELECT event_id, mask, CASE WHEN mask & 268435456 <> 0 THEN 'renamed' WHEN mask & 256 <> 0 THEN 'created' WHEN mask & 576 <> 0 THEN 'removed' WHEN mask & 128 <> 0 THEN 'created'
  WHEN mask & 1024 <> 0 THEN 'self_removed' WHEN mask & 8 <> 0 THEN 'content' WHEN mask & 4 <> 0 THEN 'attr' WHEN mask & 2 <> 0 THEN 'modify' END AS op FROM m""")
def rec_synthesis(spark, sf_dir):
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.cast("int"))
    mask = bit(F.col("event_id") % 11).bitwiseOR(bit(F.floor(F.col("event_id") / 11) % 11)).bitwiseOR(F.when(F.col("event_id") % 23 == 0, journal.FAN_RENAME).otherwise(0).cast("bigint"))
    return fixtures.read(spark, sf_dir, "events").select("event_id", mask.alias("mask")).withColumn("op", journal.synthesize(F.col("mask")))


@query("""WITH p AS (SELECT event_id, '/t/u' || (user_id % 12) || '/f' || event_id AS f, CASE WHEN event_id % 7 = 0 THEN '/t/u1' ELSE '/t/u' || (event_id % 12) || '/g' END AS t FROM events),
q AS (SELECT event_id, f = '/t/u1' OR starts_with(f, '/t/u1/') AS fi, t = '/t/u1' OR starts_with(t, '/t/u1/') AS ti FROM p)
SELECT event_id, CASE WHEN fi AND ti THEN 'renamed' WHEN fi THEN 'removed' ELSE 'created' END AS op FROM q WHERE fi OR ti""")
def rename_boundary(spark, sf_dir):
    """Renames as seen from the subtree /t/u1, which /t/u10 and /t/u11 are no part of."""
    e = fixtures.read(spark, sf_dir, "events").select("event_id", F.expr("'/t/u' || (user_id % 12) || '/f' || event_id").alias("f"), F.expr("CASE WHEN event_id % 7 = 0 THEN '/t/u1' ELSE '/t/u' || (event_id % 12) || '/g' END").alias("t"))
    return e.select("event_id", journal.cross_boundary(journal.contains("/t/u1", F.col("f")), journal.contains("/t/u1", F.col("t"))).alias("op")).where("op IS NOT NULL")


@query("""WITH n AS (SELECT page_id, unnest(string_split(url, '/')) AS name FROM pages UNION ALL SELECT page_id, repeat('é', (page_id % 140)::int) FROM pages UNION ALL SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.' WHEN 1 THEN '..' WHEN 2 THEN url ELSE NULL END FROM pages),
r AS (SELECT CASE WHEN name IS NULL OR octet_length(encode(name)) = 0 THEN 'empty' WHEN octet_length(encode(name)) > 255 THEN 'long' WHEN contains(name, '/') THEN 'slash' WHEN name IN ('.', '..') THEN 'dots' ELSE 'ok' END AS reason FROM n),
a AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'symlink' ELSE 'file' END AS kind, CASE WHEN page_id % 2 = 0 THEN repeat('t', (page_id * 97 % 5000)::int) END AS target FROM pages),
b AS (SELECT CASE WHEN kind = 'symlink' AND target IS NULL THEN 'no target' WHEN kind <> 'symlink' AND target IS NOT NULL THEN 'target' WHEN kind = 'symlink' AND length(target) NOT BETWEEN 1 AND 4096 THEN 'target length' ELSE 'ok' END AS reason FROM a),
c AS (SELECT CASE event_id % 7 WHEN 0 THEN 'batch' WHEN 1 THEN 'snap' WHEN 2 THEN 'stat' WHEN 3 THEN 'read' WHEN 4 THEN 'shares' WHEN 5 THEN 'string' ELSE 'endpoints' END AS kind, CASE WHEN event_id % 7 = 3 THEN event_id * 7919 ELSE event_id * 13 % 5000 END AS n FROM events),
d AS (SELECT CASE WHEN kind = 'batch' AND n NOT BETWEEN 1 AND 512 OR kind = 'snap' AND n > 2048 OR kind = 'stat' AND n > 4096 OR kind = 'read' AND n NOT BETWEEN 1 AND 4194304 OR kind = 'shares' AND n > 64 OR kind = 'string' AND n > 128 OR kind = 'endpoints' AND n > 8 THEN kind ELSE 'ok' END AS reason FROM c)
SELECT 'name' AS field, reason, count(*) AS n FROM r GROUP BY reason UNION ALL SELECT 'attr', reason, count(*) FROM b GROUP BY reason UNION ALL SELECT 'cap', reason, count(*) FROM d GROUP BY reason""")
def record_validation(spark, sf_dir):
    pages, events = fixtures.read(spark, sf_dir, "pages"), fixtures.read(spark, sf_dir, "events")
    names = pages.select(F.explode(F.split("url", "/")).alias("name")).unionByName(pages.select(F.expr("repeat('é', cast(page_id % 140 AS int))").alias("name"))).unionByName(pages.select(F.expr("CASE page_id % 4 WHEN 0 THEN '.' WHEN 1 THEN '..' WHEN 2 THEN url END").alias("name")))
    attrs = pages.select(F.when(F.col("page_id") % 3 == 0, "symlink").otherwise("file").alias("kind"), F.expr("CASE WHEN page_id % 2 = 0 THEN repeat('t', cast(page_id * 97 % 5000 AS int)) END").alias("target"))
    caps = events.select(F.element_at(F.lit(["batch", "snap", "stat", "read", "shares", "string", "endpoints"]), (F.col("event_id") % 7 + 1).cast("int")).alias("kind"), F.expr("CASE WHEN event_id % 7 = 3 THEN event_id * 7919 ELSE event_id * 13 % 5000 END").alias("n"))
    told = names.select(F.lit("name").alias("field"), journal.name_reason(F.col("name")).alias("r")).unionByName(attrs.select(F.lit("attr").alias("field"), journal.attr_reason(F.col("kind"), F.col("target")).alias("r"))).unionByName(caps.select(F.lit("cap").alias("field"), journal.cap_reason(F.col("kind"), F.col("n")).alias("r")))
    return told.groupBy("field", F.coalesce("r", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


_OPS = "ops AS (SELECT user_id % 7 AS dir, 'n' || (user_id % 5) AS name, event_id AS seq, CASE WHEN event_type = 'error' THEN 'del' ELSE 'set' END AS op, user_id % 3 AS node FROM events)"


def _ops(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("dir"), F.concat(F.lit("n"), F.col("user_id") % 5).alias("name"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "del").otherwise("set").alias("op"), (F.col("user_id") % 3).alias("node"))


_EFFECT = f"""WITH {_OPS}, b AS (SELECT *, lag(CASE WHEN op = 'set' THEN node END) OVER (PARTITION BY dir, name ORDER BY seq) AS before FROM ops),
e AS (SELECT *, CASE WHEN op = 'set' THEN (before IS NULL OR before <> node)::int ELSE (before IS NOT NULL)::int END AS effect FROM b)"""


@query(f"{_EFFECT} SELECT dir, name, seq, 2 + sum((op = 'set' AND effect = 1)::int) OVER (PARTITION BY dir ORDER BY seq ROWS UNBOUNDED PRECEDING)::bigint AS cookie FROM e QUALIFY op = 'set' AND effect = 1")
def dir_cookies(spark, sf_dir):
    return journal.dir_generation(_ops(spark, sf_dir)).where("insert").select("dir", "name", "seq", "cookie")


@query(f"{_EFFECT} SELECT dir, seq, sum(effect) OVER (PARTITION BY dir ORDER BY seq ROWS UNBOUNDED PRECEDING)::bigint AS dirgen FROM e")
def dir_generation(spark, sf_dir):
    return journal.dir_generation(_ops(spark, sf_dir)).select("dir", "seq", "dirgen")


@query("""WITH r AS (SELECT user_id, event_id, floor(value)::bigint AS base, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT user_id, event_id, max(base - rn) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + rn + 1 AS stamp FROM r""")
def monotonic_clock(spark, sf_dir):
    e = fixtures.read(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("bigint").alias("base"))
    return journal.unique_clock(e, "user_id", "base", "event_id").select("user_id", "event_id", "stamp")


@query(f"""WITH {JOURNAL_SQL} SELECT seq, max(size) OVER w AS clamped_size, max(ts) OVER w AS clamped_mtime FROM journal WHERE op = 'content' WINDOW w AS (PARTITION BY node_ino ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def attr_clamp(spark, sf_dir):
    return journal.clamp_attrs(fixtures.journal(spark, sf_dir).where("op = 'content'")).select("seq", "clamped_size", "clamped_mtime")


@query("""SELECT event_id, CASE WHEN n >= 999999999 THEN s + 1 ELSE s END AS sec, CASE WHEN n >= 999999999 THEN 0 ELSE n + 1 END AS nsec
FROM (SELECT event_id, event_id AS s, CASE WHEN event_id % 3 = 0 THEN 999999999 ELSE event_id END AS n FROM events)""")
def dir_bump(spark, sf_dir):
    e = fixtures.read(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("s"), F.when(F.col("event_id") % 3 == 0, 999999999).otherwise(F.col("event_id")).alias("n"))
    sec, nsec = journal.bump(F.col("s"), F.col("n"))
    return e.select("event_id", sec.alias("sec"), nsec.cast("bigint").alias("nsec"))


_TOUCH = "touch AS (SELECT user_id % 4 AS share, user_id AS node, CASE WHEN event_id % 2 = 0 THEN 'guest' ELSE 'host' END AS side, epoch_us(ts) AS us, event_id AS seq FROM events)"


def _touches(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("share"), F.col("user_id").alias("node"), F.when(F.col("event_id") % 2 == 0, "guest").otherwise("host").alias("side"), conflict.micros().alias("us"), F.col("event_id").alias("seq"))


_OTHER = f"""WITH {_TOUCH}, o AS (SELECT *, last_value(CASE WHEN side = 'guest' THEN us END IGNORE NULLS) OVER w AS g, last_value(CASE WHEN side = 'host' THEN us END IGNORE NULLS) OVER w AS h
  FROM touch WINDOW w AS (PARTITION BY share, node ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN side = 'guest' THEN h ELSE g END AS other_us, CASE WHEN side = 'guest' THEN 'guest-over-host' ELSE 'host-over-guest' END AS kind FROM o)"""


@query(f"{_OTHER} SELECT share, node, seq, us, other_us, kind FROM c WHERE us - other_us < 28800 * 1000000::bigint")
def conflicts(spark, sf_dir):
    """A window of eight hours: the default of five seconds finds nothing in these events."""
    return conflict.conflicts(_touches(spark, sf_dir), 28800).select("share", "node", "seq", "us", "other_us", "kind")


@query(f"{_OTHER} SELECT share, node, seq FROM c WHERE NOT coalesce(side = 'guest' AND us - h < 3600 * 1000000::bigint, false)")
def echo_fence(spark, sf_dir):
    return conflict.echo_fence(_touches(spark, sf_dir), 3600).select("share", "node", "seq")


@query(f"""{_OTHER}, r AS (SELECT *, count(*) OVER (PARTITION BY share) AS total, row_number() OVER (PARTITION BY share ORDER BY us DESC, seq DESC) AS rank FROM c WHERE us - other_us < 28800 * 1000000::bigint)
SELECT share, node, seq, kind, total, rank FROM r WHERE rank <= 100""")
def conflict_report(spark, sf_dir):
    return conflict.report(conflict.conflicts(_touches(spark, sf_dir), 28800), 100).select("share", "node", "seq", "kind", "total", "rank")


@query(f"""WITH {JOURNAL_SQL} SELECT seq, CASE WHEN op = 'content' THEN '{{"op":"content","share":"s' || share || '","path":"/' || name || '","size":' || size || '}}'
  ELSE '{{"op":"' || op || '","share":"s' || share || '","path":"/' || name || '"}}' END AS line FROM journal""")
def feed_json(spark, sf_dir):
    return feed.feed_lines(fixtures.journal(spark, sf_dir).withColumn("path", F.concat(F.lit("/"), F.col("name"))).withColumn("share", F.concat(F.lit("s"), F.col("share")))).select("seq", "line")


@query(f"WITH {JOURNAL_SQL} SELECT seq FROM journal WHERE starts_with('/' || name, '/u1')")
def feed_prefix(spark, sf_dir):
    j = fixtures.journal(spark, sf_dir).withColumn("path", F.concat(F.lit("/"), F.col("name")))
    return j.where(feed.feed_match("/u1", "path")).select("seq")


def _xor(a, b):
    return f"xor({a}, {b})"


def _fnv_sql(*words: str) -> str:
    h = "14695981039346656037::uhugeint"
    for w in words:
        h = f"((xor({h}, ({w})::uhugeint) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
    return f"({h})::ubigint"


def _signed(u: str) -> str:
    return f"CASE WHEN {u} >= 9223372036854775808 THEN ({u}::hugeint - 18446744073709551616)::bigint ELSE {u}::bigint END"


@query(f"""WITH {JOURNAL_SQL}, f AS (SELECT seq, {_fnv_sql("epoch_us(ts) // 1000000", "(node_ino * 1000) % 1000000000", "size", "mode")} AS u FROM journal) SELECT seq, {_signed("u")} AS fingerprint FROM f""")
def fingerprint(spark, sf_dir):
    j = fixtures.journal(spark, sf_dir)
    sec = F.floor(conflict.micros() / 1000000).cast("bigint")
    return j.select("seq", scalars.content_fingerprint(sec, F.col("node_ino") * 1000 % 1000000000, F.col("size"), F.col("mode")).alias("fingerprint"))


@query(f"""WITH {JOURNAL_SQL}, f AS (SELECT seq, {_fnv_sql("seq", "mode", "node_ino", "mode + 1", "size")} AS u FROM journal) SELECT seq, {_signed("u")} AS change FROM f""")
def change_attr(spark, sf_dir):
    c = F.col
    return fixtures.journal(spark, sf_dir).select("seq", scalars.change_attr(c("seq"), c("mode"), c("node_ino"), c("mode") + 1, c("size")).alias("change"))
