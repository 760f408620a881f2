"""Rank fusion, normalisation and the absolute admission gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fusion constant and the weights of the lexical and the vector leg.
RRF_K, LEXICAL_WEIGHT, VECTOR_WEIGHT = 60.0, 1.0, 0.7


def rrf(legs: Sequence[tuple[DataFrame, list[Column], float]], per: str | None = None, k: float = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of legs ``(rows with id, order, weight)``: ``(id, score)``, with the key ``per`` if given."""
    keys = [per, "id"] if per else ["id"]
    union = None
    for rows, order, weight in legs:
        rank = F.row_number().over((W.partitionBy(per) if per else W.partitionBy(F.lit(1))).orderBy(*order))
        leg = rows.select(*keys, (F.lit(weight) / (k + rank)).alias("s"))
        union = leg if union is None else union.unionByName(leg)
    return union.groupBy(*keys).agg(F.sum("s").alias("score"))


def normalize(df: DataFrame, score: str, per: list[str]) -> DataFrame:
    """Scores divided by the largest of their query, where that is positive."""
    top = F.max(score).over(W.partitionBy(*per))
    return df.withColumn(score, F.when(top > 0, F.col(score) / top).otherwise(F.col(score)))


def lost_in_middle(rank: Column) -> Column:
    """Sort key for ranks from 1: odd ranks first in order, even ones last in reverse."""
    return F.when(rank % 2 == 1, rank).otherwise(F.lit(10**9) - rank)


def admits(strong_lexical: Column, distance: Column, bound: float) -> Column:
    return strong_lexical | F.coalesce(distance <= bound, F.lit(False))
