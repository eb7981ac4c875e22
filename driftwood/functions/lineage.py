"""Cutting long lineages through the reliable checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; where that is unset, as in
    tests on one machine, a temporary one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="driftwood-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A copy in the shared folder, without the lineage of ``df``.

    Shuffle files that only earlier copies needed are let go first: they stay until the driver's JVM
    collects garbage, which by itself can be after the query.
    """
    spark = df.sparkSession
    shared_folder(spark)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    cut = df.checkpoint(eager=True)
    # A checkpointed frame keeps the size that was estimated for its plan.  Over a chain of joins the
    # estimates multiply to numbers of millions of digits, so the rows get a plan without one.
    jdf = cut._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def durable_files(df: DataFrame) -> DataFrame:
    """``durable`` as Parquet: a third of a checkpoint's size, of which only the columns asked for are read.
    It can be removed by ``forget``."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/copy-{uuid.uuid4()}"
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget(*copies: DataFrame) -> None:
    """Remove copies made by ``durable_files`` that no frame reads any more, and the shuffle files behind them."""
    for df in copies:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("copy-"):
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        sc._jvm.System.gc()
