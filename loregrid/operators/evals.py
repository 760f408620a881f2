"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def recall_report(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Recall at k and mean reciprocal rank of ``ranked(query, id, rank)`` against ``expected(query, id)``; misses count 0."""
    first = ranked.join(expected, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("r"))
    hit = expected.select("query").distinct().join(first, "query", "left")
    good = F.coalesce(F.col("r") <= k, F.lit(False))
    return hit.agg(F.count("*").alias("n"), F.round(F.avg(F.when(good, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}"), F.round(F.avg(F.when(good, 1.0 / F.col("r")).otherwise(0.0)), 6).alias("mrr"))


def precision(ranked: DataFrame, negatives: DataFrame, k: int) -> DataFrame:
    """Share of shown rows that belong to real queries; ``negatives(query)`` should show nothing."""
    shown = ranked.where(F.col("rank") <= k)
    false = shown.join(negatives, "query", "left_semi").agg(F.count("*").alias("f"))
    return shown.agg(F.count("*").alias("n")).crossJoin(false).select(F.when(F.col("n") > 0, 1 - F.col("f") / F.col("n")).otherwise(1.0).alias("precision"))


def judge_accuracy(pairs: DataFrame) -> DataFrame:
    """Share of ``pairs(answer, found)`` whose found text contains the answer, without regard to case."""
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.contains(F.lower("found"), F.lower("answer")), 1.0).otherwise(0.0)), 6).alias("accuracy"))
