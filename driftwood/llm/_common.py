"""What the operators of this subpackage share: tables, durable cuts of lineage, checks of size."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The characters that end a word: blank and tab to carriage return.
SPACES = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder.

    The folder is the one in ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) a temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="driftwood-"))
    cut = df.checkpoint(eager=True)
    # A checkpointed frame keeps the size that was estimated for its plan.  Over a chain of joins the
    # estimates multiply to numbers of millions of digits, so the rows get a plan without one.
    jdf = cut._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def copied(df: DataFrame) -> DataFrame:
    """``durable`` as Parquet in the same folder.  A checkpoint computes its last stage twice, once to count and once
    to write; this computes it once, takes less disk, and many small parts are read by few tasks."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="driftwood-"))
    folder = f"{sc.getCheckpointDir()}/copy-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that no live frame needs; else they stay until the driver's
    JVM happens to collect garbage.  Those of the last query can stay until the next one has run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch at most: texts of some kilobytes then take some megabytes on either side.
ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold ``ARROW_ROWS`` rows at most; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, max_rows: int) -> bool:
    """True if df has at most max_rows rows; reads no more than that many and one."""
    return df.limit(max_rows + 1).count() <= max_rows
