"""Host mutations as journal records: checked against the tree, then folded like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .journal import name_reason


def plan(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (seq, cmd in create, remove, rmdir, rename, setattr, write; parent_ino, name) with its
    status and the record it becomes.

    Creations that meet a name, real or asked for earlier, are exist; the others need the entry.
    """
    e = tree.select("parent_ino", "name", F.col("ino"), F.col("kind").alias("k"))
    full = tree.select(F.col("parent_ino").alias("ino")).distinct().withColumn("full", F.lit(True))
    rank = F.row_number().over(Window.partitionBy("parent_ino", "name", "cmd").orderBy("seq"))
    rows = asked.withColumn("rank", rank).join(e, ["parent_ino", "name"], "left").join(full, "ino", "left")
    create = F.col("cmd") == "create"
    status = (
        F.when(name_reason(F.col("name")).isNotNull(), "inval")
        .when(create & (F.col("ino").isNotNull() | (F.col("rank") > 1)), "exist")
        .when(~create & F.col("ino").isNull(), "noent")
        .when((F.col("cmd") == "remove") & (F.col("k") == "dir"), "isdir")
        .when((F.col("cmd") == "rmdir") & (F.col("k") != "dir"), "notdir")
        .when((F.col("cmd") == "rmdir") & F.coalesce("full", F.lit(False)), "notempty")
        .when((F.col("cmd") == "write") & (F.col("k") == "dir"), "isdir")
        .otherwise("ok")
    )
    op = F.when(create, "created").when(F.col("cmd").isin("remove", "rmdir"), "removed").when(F.col("cmd") == "rename", "renamed").when(F.col("cmd") == "setattr", "attr").otherwise("content")
    return rows.withColumn("status", status).withColumn("op", F.when(F.col("status") == "ok", op)).drop("rank", "k", "full")
