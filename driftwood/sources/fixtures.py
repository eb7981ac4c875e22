"""The engine's inputs derived from the driver's tables, for Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids of a level are its number times LEVEL plus the table's key; lines add their order's place.
LEVEL, LINES = 1 << 40, 1024
ROOT = 1
OPS = {"signup": "created", "view": "attr", "click": "content", "purchase": "content", "error": "removed"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records, one for each event."""
    e = read(spark, sf_dir, "events")
    op = F.lit(None).cast("string")
    for k, v in OPS.items():
        op = F.when(F.col("event_type") == k, v).otherwise(op)
    return e.select(
        (F.col("user_id") % 4).alias("share"), (F.col("event_id") + 1).alias("seq"), "ts", op.alias("op"), F.lit(ROOT).cast("bigint").alias("parent_ino"),
        F.concat(F.lit("u"), F.col("user_id")).alias("name"), F.col("user_id").alias("node_ino"), F.floor("value").cast("bigint").alias("size"),
        F.get_json_object("props", "$.k").cast("bigint").alias("mode"), (F.col("event_type") == "click").alias("in_progress"),
    )


JOURNAL_SQL = """journal AS (
  SELECT user_id % 4 AS share, event_id + 1 AS seq, ts,
    CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'attr' WHEN 'click' THEN 'content' WHEN 'purchase' THEN 'content' WHEN 'error' THEN 'removed' END AS op,
    1::bigint AS parent_ino, 'u' || user_id AS name, user_id AS node_ino, floor(value)::bigint AS size,
    (props::json->>'$.k')::bigint AS mode, event_type = 'click' AS in_progress
  FROM events)"""

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a place inside its order, by all columns."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    return read(spark, sf_dir, "lineitem").withColumn("ordinal", rank)


def snapshot(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    """Snapshot entries (parent_ino, name, ino, kind, size, mode, mtime_sec, seq), repeats and all; of the ``lines``
    ``placed`` if the caller has them."""
    col, lit = F.col, F.lit
    row = lambda parent, name, ino, kind, size=lit(0), sec=lit(0), seq=lit(0): [parent.cast("bigint").alias("parent_ino"), name.cast("string").alias("name"), ino.cast("bigint").alias("ino"), lit(kind).alias("kind"), size.cast("bigint").alias("size"), lit(0o755 if kind == "dir" else 0o644).alias("mode"), sec.cast("bigint").alias("mtime_sec"), seq.cast("bigint").alias("seq")]
    region = read(spark, sf_dir, "region").select(*row(lit(ROOT), col("r_name"), LEVEL + col("r_regionkey"), "dir"))
    nation = read(spark, sf_dir, "nation").select(*row(LEVEL + col("n_regionkey"), col("n_name"), 2 * LEVEL + col("n_nationkey"), "dir"))
    customer = read(spark, sf_dir, "customer").select(*row(2 * LEVEL + col("c_nationkey"), col("c_name"), 3 * LEVEL + col("c_custkey"), "dir"))
    supplier = read(spark, sf_dir, "supplier").select(*row(2 * LEVEL + col("s_nationkey"), col("s_name"), 6 * LEVEL + col("s_suppkey"), "file", F.abs(F.floor("s_acctbal"))))
    order = read(spark, sf_dir, "orders").select(*row(3 * LEVEL + col("o_custkey"), col("o_orderkey"), 4 * LEVEL + col("o_orderkey"), "dir"))
    line = (placed or lines(spark, sf_dir)).select(*row(4 * LEVEL + col("l_orderkey"), col("l_linenumber"), 5 * LEVEL + col("l_orderkey") * LINES + col("ordinal"), "file", F.floor("l_quantity"), F.unix_date(col("l_shipdate").cast("date")) * 86400, col("ordinal")))
    out = region
    for x in (nation, customer, supplier, order, line):
        out = out.unionByName(x)
    return out


LINES_SQL = f"""lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}) AS ordinal FROM lineitem)"""

SNAPSHOT_SQL = f"""{LINES_SQL},
snapshot AS (
  SELECT {ROOT}::bigint AS parent_ino, r_name AS name, {LEVEL} + r_regionkey AS ino, 'dir' AS kind, 0::bigint AS size, 493 AS mode, 0::bigint AS mtime_sec, 0::bigint AS seq FROM region
  UNION ALL SELECT {LEVEL} + n_regionkey, n_name, {2 * LEVEL} + n_nationkey, 'dir', 0, 493, 0, 0 FROM nation
  UNION ALL SELECT {2 * LEVEL} + c_nationkey, c_name, {3 * LEVEL} + c_custkey, 'dir', 0, 493, 0, 0 FROM customer
  UNION ALL SELECT {2 * LEVEL} + s_nationkey, s_name, {6 * LEVEL} + s_suppkey, 'file', abs(floor(s_acctbal))::bigint, 420, 0, 0 FROM supplier
  UNION ALL SELECT {3 * LEVEL} + o_custkey, o_orderkey::varchar, {4 * LEVEL} + o_orderkey, 'dir', 0, 493, 0, 0 FROM orders
  UNION ALL SELECT {4 * LEVEL} + l_orderkey, l_linenumber::varchar, {5 * LEVEL} + l_orderkey * {LINES} + ordinal, 'file', floor(l_quantity)::bigint, 420, epoch(l_shipdate::date)::bigint, ordinal FROM lines),
tree AS (
  SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY parent_ino, name ORDER BY seq DESC, ino DESC) AS rank FROM snapshot) WHERE rank = 1)"""

PATHS_SQL = f"""WITH RECURSIVE {SNAPSHOT_SQL},
paths AS (
  SELECT {ROOT}::bigint AS ino, '/' AS path, 0 AS depth, 'dir' AS kind, 0::bigint AS size, NULL::bigint AS parent_ino
  UNION ALL
  SELECT t.ino, CASE WHEN p.path = '/' THEN '/' || t.name ELSE p.path || '/' || t.name END, p.depth + 1, t.kind, t.size, t.parent_ino
  FROM tree t JOIN paths p ON t.parent_ino = p.ino)"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One blob for each document: node, bytes."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lease events: a view opens, a purchase invalidates, a click returns; others touch nothing."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "purchase", "inval").when(F.col("event_type") == "click", "return")
    return e.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), "value").where(F.col("kind").isNotNull())


OPENS_SQL = """leases AS (
  SELECT user_id AS node, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'open' WHEN 'purchase' THEN 'inval' WHEN 'click' THEN 'return' END AS kind, value
  FROM events WHERE event_type IN ('view', 'purchase', 'click'))"""
