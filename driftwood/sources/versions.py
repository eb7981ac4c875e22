"""Versioned tables: each commit is a folder of its own and a row of a log, and readers follow the log.

A version's rows are written first; then its log row appears, by the rename that ends Spark's write of one
file.  So readers see a version whole or not at all, a write that broke off leaves a folder that nothing
names, and a batch that is replayed finds its number in the log and changes nothing.  One writer at a
time, as ``foreachBatch`` has it.

A volatile commit is seen by readers at once but survives a restart only if ``persist`` came after it:
one log row that covers all volatile commits before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "kind string, batch bigint, version bigint, folder string"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        """The log's rows; none before the first commit."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.path}/_log")
        except Exception as e:  # the one thing that tells a table without commits
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def _tell(self, kind: str, batch: int | None, version: int, folder: str | None) -> None:
        self.spark.createDataFrame([(kind, batch, version, folder)], LOG).coalesce(1).write.mode("append").json(f"{self.path}/_log")

    def last_version(self) -> int:
        return self.log().agg(F.max("version")).first()[0] or 0

    def commit(self, rows: DataFrame, batch: int, durable: bool = True) -> bool:
        """Make ``rows`` the table's next version, unless ``batch`` has been committed; whether it was made.

        ``rows`` may be read from the version before.  A folder that a broken write has left is replaced.
        """
        if not self.log().where(F.col("batch") == batch).isEmpty():
            return False
        version = self.last_version() + 1
        folder = f"{self.path}/version-{version}-batch-{batch}"
        rows.write.mode("overwrite").parquet(folder)
        self._tell("durable" if durable else "volatile", batch, version, folder)
        return True

    def persist(self) -> None:
        """Let all volatile commits so far survive a restart."""
        self._tell("persist", None, self.last_version() + 1, None)

    def _latest(self, survived: bool) -> str | None:
        log = self.log()
        if survived:
            upto = log.where("kind IN ('durable', 'persist')").agg(F.max("version")).first()[0] or 0
            log = log.where(F.col("version") <= upto)
        found = log.where("folder IS NOT NULL").agg(F.max_by("folder", "version")).first()[0]
        return found

    def read(self, survived: bool = False) -> DataFrame | None:
        """The latest version, of those that survive a restart if asked; None if there is none."""
        folder = self._latest(survived)
        return None if folder is None else self.spark.read.parquet(folder)

    def keep(self, stream: DataFrame, checkpoint: str, every: str | None = "500 milliseconds", durable: bool = True):
        """A query that makes each batch with rows of a stream (in complete form) the next version, at most
        one in ``every``; None: what is there now and then an end."""
        when = {"availableNow": True} if every is None else {"processingTime": every}
        flush = lambda rows, batch: None if rows.isEmpty() else self.commit(rows, batch, durable)
        return stream.writeStream.outputMode("complete").foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**when).start()
