"""Stages of the corpus pipeline.  Each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``documents``.  A null or letterless text is rejected by the
first stage; a text that line removal empties is a repeat of earlier lines and goes with them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard_join, langid, lines
from ._common import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing ``lang`` is filled in."""
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.predict(docs.select(*COLUMNS), model, keep_text=True).where(F.col("lang_pred") != langid.UNDETERMINED)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those that have no word left go."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    changed = F.size("removed_lines") > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    found = jaccard_join.near_duplicates(docs)
    drop = durable(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct())
    return docs.join(jaccard_join._side(drop), F.col("doc_id") == F.col("__id"), "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), short_anywhere=True).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to its bytes."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = docs.select(*COLUMNS).withColumn("sha", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    out = bpe.encode(own, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='driftwood-')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(stages[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return stages[-1][1](spark, docs, sf_dir)
