"""Memory entries: confidence, recency, disputes, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Durable types, authority of sources, and the terms of the confidence formula.
DURABLE = ("topic", "problem", "decision")
AUTHORITY = {"official_docs": 1.0, "user_statement": 0.85, "auto_extracted": 0.70, "inference": 0.65}
REFUTATION_WEIGHT, DECAY_DAYS, FLOOR = 3.0, 90.0, 0.05
RELEVANCE_WEIGHT, CONFIDENCE_WEIGHT = 0.7, 0.3
DAY = 86_400


def belief() -> Column:
    return (1.0 + F.col("confirmations")) / (2.0 + F.col("confirmations") + REFUTATION_WEIGHT * F.col("corrections"))


def confidence(now: Column) -> Column:
    """Belief times decay times authority, at least 0.05. Durable entries don't decay; others do from their last confirmation."""
    days = F.greatest((now - F.coalesce("last_confirmed_at", "created_at")) / float(DAY), F.lit(0.0))
    decay = F.when(F.col("entry_type").isin(*DURABLE), 1.0).otherwise(F.exp(-days / (DECAY_DAYS * (1.0 + F.log(1.0 + F.col("access_count"))))))
    authority = F.lit(AUTHORITY["inference"])
    for source, weight in AUTHORITY.items():
        authority = F.when(F.col("source_type") == source, weight).otherwise(authority)
    return F.greatest(belief() * decay * authority, F.lit(FLOOR))


def access_recency(now: Column, half_life: int) -> Column:
    """ln(1 + accesses), halved with every half-life since the last one; 0 if never accessed."""
    age = F.greatest(now - F.col("last_accessed"), F.lit(0))
    return F.when((F.col("access_count") > 0) & F.col("last_accessed").isNotNull() & F.lit(half_life > 0), F.log(1.0 + F.col("access_count")) * F.pow(F.lit(0.5), age / F.lit(float(max(half_life, 1))))).otherwise(0.0)


def disputed() -> Column:
    """Refuted later than confirmed; a tie is the confirmation's."""
    return F.col("last_refuted_at").isNotNull() & (F.col("corrections") > 0) & (F.col("last_confirmed_at").isNull() | (F.col("last_refuted_at") > F.col("last_confirmed_at")))


def final_score(relevance: Column, conf: Column) -> Column:
    return relevance * RELEVANCE_WEIGHT + conf * CONFIDENCE_WEIGHT


def reconcile(files: DataFrame, rows: DataFrame, bulk_cap: int = 10) -> DataFrame:
    """``(id, action)``: what to do with each entry, from ``files(id, file_hash)`` and ``rows(id, row_hash, projected_hash, status)``.

    project: the row changed; adopt: the file did; conflict: both did; import and revive: a file without a
    live row; archive: a projected row without file, held back if more than ``bulk_cap`` would go at once.
    """
    both = files.join(rows, "id", "full")
    f, r, p = F.col("file_hash"), F.col("row_hash"), F.col("projected_hash")
    action = (
        F.when(r.isNull(), "import").when(f.isNotNull() & (F.col("status") == "archived"), "revive").when(f.isNull() & p.isNull(), "project").when(f.isNull() & (F.col("status") == "archived"), "none").when(f.isNull(), "archive")
        .when(f == r, "none").when(f.eqNullSafe(p), "project").when(r.eqNullSafe(p), "adopt").otherwise("conflict")
    )
    acted = both.select("id", action.alias("action"))
    going = acted.agg(F.count_if(F.col("action") == "archive").alias("going"))
    return acted.crossJoin(F.broadcast(going)).select("id", F.when((F.col("action") == "archive") & (F.col("going") > bulk_cap), "held").otherwise(F.col("action")).alias("action"))
