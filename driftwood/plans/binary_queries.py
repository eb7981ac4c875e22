"""Queries over binary events, frames and handles that are built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwood.sources import binary
from driftwood.sources.binary import little
from driftwood.sources.fixtures import read

from .registry import query


def _info(kind: int, ino: Column, gen: Column, name: Column | None = None) -> Column:
    handle = F.concat(F.unhex(F.lit("00" * binary.FSID)), little(F.lit(8), 4), little(F.lit(1), 4), little(ino, 4), little(gen, 4))
    if name is not None:
        pad = 4 - F.octet_length(name) % 4
        handle = F.concat(handle, name.cast("binary"), F.unhex(F.repeat(F.lit("00"), pad)))
    return F.concat(little(F.lit(kind), 1), F.unhex(F.lit("00")), little(F.octet_length(handle) + binary.INFO_HEADER, 2), handle)


def _event(mask: Column, pid: Column, *parts: Column) -> Column:
    body = F.concat(*parts) if parts else F.unhex(F.lit(""))
    return F.concat(little(F.octet_length(body) + binary.METADATA, 4), F.unhex(F.lit("0300")), little(F.lit(binary.METADATA), 2), little(mask, 8), little(F.lit(-1), 4), little(pid, 4), body)


@query("""WITH e AS (SELECT event_id, user_id, (1::bigint << (event_id % 29)) AS mask, event_id % 5 - 2 AS pid, 'u' || user_id AS name, event_id % 23 = 0 AS moved FROM events)
SELECT event_id, 0::bigint AS place, mask, pid, CASE WHEN NOT moved THEN event_id END AS fid_ino, CASE WHEN NOT moved THEN user_id END AS dir_ino, CASE WHEN NOT moved THEN 7 END AS dir_gen, CASE WHEN NOT moved THEN name END AS name,
  CASE WHEN moved THEN user_id END AS old_ino, CASE WHEN moved THEN name END AS old_name, CASE WHEN moved THEN user_id + 1 END AS new_ino, CASE WHEN moved THEN name || 'x' END AS new_name FROM e WHERE event_id % 17 <> 0 OR event_id % 3 = 0
UNION ALL SELECT event_id, 1, mask, pid, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM e WHERE event_id % 3 = 0 AND event_id % 17 <> 0""")
def event_parse(spark, sf_dir):
    """Events as bytes, some two in one buffer and some cut short by a byte, and back."""
    i, u = F.col("event_id"), F.col("user_id")
    mask, pid, name = F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % 29).cast("int")), i % 5 - 2, F.concat(F.lit("u"), u)
    changed = _event(mask, pid, _info(binary.DFID_NAME, u, F.lit(7), name), _info(binary.FID, i, F.lit(1)))
    moved = _event(mask, pid, _info(binary.OLD_NAME, u, F.lit(7), name), _info(binary.NEW_NAME, u + 1, F.lit(7), F.concat(name, F.lit("x"))))
    data = F.concat(F.when(i % 23 == 0, moved).otherwise(changed), F.when(i % 3 == 0, _event(mask, pid)).otherwise(F.unhex(F.lit(""))))
    rows = read(spark, sf_dir, "events").select("event_id", data.alias("data"))
    got = binary.parse_events(rows.withColumn("data", F.expr("substring(data, 1, octet_length(data) - CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END)")))
    text = lambda c: F.col(c).cast("string").alias(c)
    return got.select("event_id", "place", "mask", "pid", "fid_ino", "dir_ino", "dir_gen", text("name"), "old_ino", text("old_name"), "new_ino", text("new_name"))


@query("""WITH f AS (SELECT event_id, event_id * 37 % 70000 AS len, event_id % 6 AS kind, event_id // 6 % 5 AS flags, -event_id AS seq, event_id % 19 = 0 AS reserved, event_id % 29 = 0 AS short FROM events),
p AS (SELECT *, CASE WHEN short THEN NULL WHEN kind = 5 THEN 'kind' WHEN flags = 4 THEN 'flags' WHEN reserved THEN 'reserved' WHEN len > 65536 THEN 'length' END AS problem FROM f)
SELECT event_id, CASE WHEN problem IS NULL AND NOT short THEN len END AS len, CASE WHEN problem IS NULL AND NOT short THEN ['ctl', 'req', 'resp', 'event', 'bulk'][kind + 1] END AS kind,
  CASE WHEN problem IS NULL AND NOT short THEN flags END AS flags, CASE WHEN problem IS NULL AND NOT short THEN seq END AS seq, problem FROM p""")
def frame_headers(spark, sf_dir):
    """Frame headers as bytes and back, with the first reason to refuse one; short ones are null."""
    i = F.col("event_id")
    data = binary.encode_frame(i * 37 % 70000, i % 6, F.floor(i / 6) % 5, -i)
    data = F.when(i % 19 == 0, F.concat(F.substring(data, 1, 7), F.unhex(F.lit("01")), F.substring(data, 9, 8))).otherwise(data)
    data = F.when(i % 29 == 0, F.substring(data, 1, 15)).otherwise(data)
    rows = read(spark, sf_dir, "events").select("event_id", data.alias("data")).select("event_id", binary.frame_header(F.col("data"), 65536).alias("h"))
    return rows.select("event_id", "h.len", "h.kind", "h.flags", "h.seq", "h.problem")


_KEY = bytes(range(32))


@query("""SELECT o_orderkey, CASE WHEN fine THEN o_custkey % 65536 END AS share, CASE WHEN fine THEN CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END END AS ino, CASE WHEN fine THEN 4294967295 - o_orderkey % 1000 END AS gen
FROM (SELECT *, o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS fine FROM orders)""")
def handle_codec(spark, sf_dir):
    """Node handles and back; those with a changed byte, a byte too many or another's key are refused."""
    k = F.col("o_orderkey")
    ino, share, gen = F.when(k % 7 == 0, -k).otherwise(k), F.col("o_custkey") % 65536, F.lit(4294967295) - k % 1000
    good, other = (binary.encode_handle(share, ino, gen, key) for key in (_KEY, _KEY[::-1]))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 13 == 0, other).otherwise(good).alias("data"))
    swapped = F.concat(F.substring("data", 1, 15), F.unhex(F.lpad(F.hex(255 - F.conv(F.hex(F.substring("data", 16, 1)), 16, 10).cast("bigint")), 2, "0")), F.substring("data", 17, 12))
    data = F.when(k % 5 == 0, swapped).when(k % 11 == 0, F.concat("data", F.unhex(F.lit("00")))).otherwise(F.col("data"))
    rows = rows.select("o_orderkey", data.alias("data")).select("o_orderkey", binary.decode_handle(F.col("data"), _KEY).alias("h"))
    return rows.select("o_orderkey", "h.share", "h.ino", "h.gen")
