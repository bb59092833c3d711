"""Scoring of results against validators, rolled up by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(passed: Column, total: Column) -> Column:
    """3 for all, 2 for all but one, 1 for half (rounded down), else 0; 0 without validators."""
    return F.when(total == 0, 0).when(passed == total, 3).when(passed >= total - 1, 2).when(passed >= F.floor(total / 2), 1).otherwise(0)


def outcomes(questions: DataFrame, checks: DataFrame) -> DataFrame:
    """``id, category, passed, total, score`` of every question; one without checks scores 0.

    ``checks`` has ``id`` and ``ok``; a null counts as failed.
    """
    tallied = checks.groupBy("id").agg(F.count_if(F.col("ok")).alias("passed"), F.count(F.lit(1)).alias("total"))
    both = questions.join(tallied, "id", "left").fillna(0, ["passed", "total"])
    return both.withColumn("score", score(F.col("passed"), F.col("total")))


def report(scored: DataFrame) -> DataFrame:
    """Points and accuracy by category, and of all under ``TOTAL``."""
    rolled = scored.withColumn("category", F.coalesce("category", F.lit("none"))).rollup("category").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("score").alias("points"), F.grouping("category").alias("_all")
    )
    return rolled.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "questions", "points", F.round(F.col("points") / (F.col("questions") * 3) * 100, 1).alias("accuracy"))
