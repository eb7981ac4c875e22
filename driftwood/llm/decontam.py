"""Benchmark items inside documents.

Method: size-partitioned MinHash containment search.  Items are put into partitions by the number
of their shingles (powers of two).  An item whose shingles lie in a document to a share of at least
``threshold`` misses at most ``(1 - threshold) * size`` of them, so among its ``m`` least hashes,
``m = floor((1 - threshold) * largest size of the partition) + 1``, one at least is there.  Those m
hashes are the item's MinHash signature: searching the documents for signature hashes loses no
item, and how many hashes an item needs depends on its partition alone, not on the length of the
documents.  Candidates are verified by exact containment of the shingles themselves.

An item of fewer words than a shingle is its whole sequence, which by the query's SQL only a document
of just these words has.  With ``short_anywhere`` documents have shingles of the lengths of such items
too, so these are found wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import durable, small, table
from .shingle_sql import shingle_hashes, shingle_strings, words

THRESHOLD = 0.75
#: Sides of up to so many rows (of two numbers each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def signatures(items: DataFrame, threshold: float = THRESHOLD, *, item_id: str = "item_id", text: str = "text", k: int = 5) -> DataFrame:
    """(item_id, part, hash): the MinHash signature of each item that has words."""
    s = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.array_sort(F.array_distinct(shingle_hashes(words(F.col(text)), k))).alias("h")).where(F.size("h") > 0)
    s = s.withColumn("part", F.ceil(F.log2(F.size("h"))).cast("int"))
    m = F.floor(F.round((1 - threshold) * F.pow(F.lit(2.0), "part"), 6)).cast("int") + 1
    return s.select("item_id", "part", F.explode(F.slice("h", 1, m)).alias("hash"))


def _short_lengths(items: DataFrame, item_id: str, text: str, k: int) -> list[int]:
    """The numbers of words below k that items have."""
    n = items.where(F.col(item_id).isNotNull()).select(F.size(words(F.col(text))).alias("n"))
    return sorted(r["n"] for r in n.where((F.col("n") > 0) & (F.col("n") < k)).distinct().collect())


def _also(make: Callable[[Column, int], Column], text: Column, k: int, short: list[int]) -> Column:
    """The k-word shingles that ``make`` finds in a text and those of the lengths ``short``."""
    return F.array_distinct(F.concat(*(make(words(text), n) for n in [k, *short]))) if short else make(words(text), k)


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = 5, short_anywhere: bool = False) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of the pairs at or over the threshold.

    Containment is the share of the item's distinct k-word shingles that the document has; an item of
    fewer than k words has one, its whole sequence, which is found in longer documents only with
    ``short_anywhere``.  Rows
    without id, and texts without words, are in no pair; of rows with the same pair of ids the one
    with the largest containment counts.  No items or no documents: no rows.
    """
    keyed = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sign = durable(signatures(items, threshold, item_id=item_id, text=text, k=k))
    short = _short_lengths(items, item_id, text, k) if short_anywhere else []
    found = keyed.select("doc_id", F.explode(_also(shingle_hashes, F.col("text"), k, short)).alias("hash")).join(_hint(sign.select("hash", "item_id").distinct()), "hash")
    pairs = durable(found.select("doc_id", "item_id").distinct())
    # Only candidates' texts are read again.
    item_sets = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), shingle_strings(words(F.col(text)), k).alias("s"))
    own = keyed.join(_hint(pairs.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", _also(shingle_strings, F.col("text"), k, short).alias("d"))
    both = own.join(_hint(pairs), "doc_id").join(_hint(item_sets) if small(items, 20_000) else item_sets, "item_id")
    shared = F.size(F.array_intersect("s", "d"))
    out = both.select("doc_id", "item_id", F.size("s").cast("bigint").alias("n_item"), shared.cast("bigint").alias("n_shared"))
    out = out.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item"))
    best = out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_item", "n_shared"), F.col("n_shared") / F.col("n_item")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_item", "x.n_shared", (F.col("x.n_shared") / F.col("x.n_item")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, *, doc_id: str = "doc_id", short_anywhere: bool = False) -> DataFrame:
    """``docs`` without those that hold an item; rows without id stay."""
    bad = contained(docs, items, threshold, doc_id=doc_id, short_anywhere=short_anywhere).select(F.col("doc_id").alias("__bad")).distinct()
    bad = durable(bad)
    return docs.join(_hint(bad), F.col(doc_id) == F.col("__bad"), "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = r"""
{name}_w AS (
  SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS i, len(l) AS n
  FROM (SELECT id, list_filter(string_split_regex({lower}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
        FROM (SELECT {id} AS id, text FROM {table}))
),
{name}_l AS (
  SELECT id, i, n, w, lead(w, 1) OVER q AS w1, lead(w, 2) OVER q AS w2, lead(w, 3) OVER q AS w3, lead(w, 4) OVER q AS w4
  FROM {name}_w WINDOW q AS (PARTITION BY id ORDER BY i)
),
{name} AS (
  SELECT DISTINCT id, concat_ws(' ', w, w1, w2, w3, w4) AS s FROM {name}_l WHERE i <= greatest(n - 4, 1)
)"""


def shingles_sql(name: str, source: str, key: str, lower: str = "lower(text)") -> str:
    """Common table expressions in DuckDB's dialect: {name}(id, s), distinct 5-word shingles."""
    return _SHINGLES.format(name=name, table=source, id=key, lower=lower)


ORACLE_SQL = f"""
WITH {shingles_sql("d", "documents", "doc_id")}, {shingles_sql("b", "benchmark", "item_id")},
size AS (SELECT id, count(*) AS n_item FROM b GROUP BY id),
hit AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b ON d.s = b.s GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM hit JOIN size ON size.id = hit.item_id WHERE n_shared >= 0.75 * n_item
"""
