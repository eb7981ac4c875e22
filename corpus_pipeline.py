"""The corpus pipeline: stages that each read what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwood.llm import stages

#: (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = stages.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's rows are written in the shared folder and read again."""
    return stages.run(spark, sf_dir, STAGES)
