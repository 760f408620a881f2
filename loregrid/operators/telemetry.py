"""Ledgers, hook statistics and experiment statistics."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Upper bounds and names of the cosine bands, and the labels that a report needs.
BANDS = [(0.40, "<0.40"), (0.45, "0.40-0.45"), (0.50, "0.45-0.50"), (0.55, "0.50-0.55"), (0.60, "0.55-0.60"), (0.65, "0.60-0.65")]
TOP_BAND, LEXICAL_BAND, MIN_LABELLED = "0.65+", "fts", 30


def band(cosine: Column) -> Column:
    c = F.round(cosine, 4)
    out = F.when(c.isNull(), LEXICAL_BAND)
    for bound, name in BANDS:
        out = out.when(c < bound, name)
    return out.otherwise(TOP_BAND)


def band_counts(candidates: DataFrame) -> DataFrame:
    o, i = F.coalesce("outcome", F.lit("")), F.col("injected")
    return candidates.groupBy(band(F.col("cosine")).alias("band"), "entry_type", "holdout").agg(
        F.count("*").alias("offered"), F.count_if(i).alias("injected"), F.count_if(F.col("outcome").isNotNull()).alias("labelled"),
        F.count_if(i & o.isin("used", "confirmed")).alias("positive"), F.count_if(i & o.isin("refuted", "corrected")).alias("negative"), F.count_if(~i & (o == "missed")).alias("missed"),
    )


def recall_report(candidates: DataFrame, least: int = MIN_LABELLED) -> DataFrame:
    """Band counts with the precision of judged rows, null while fewer than ``least`` rows outside the holdout are labelled."""
    counts = band_counts(candidates)
    enough = counts.agg(F.coalesce(F.sum(F.when(~F.col("holdout"), F.col("labelled"))), F.lit(0)).alias("n"))
    judged = F.col("positive") + F.col("negative")
    return counts.crossJoin(F.broadcast(enough)).withColumn("precision", F.when((F.col("n") >= least) & (judged > 0), F.col("positive") / judged)).drop("n")


def hook_event_stats(events: DataFrame, blocks: dict[str, str], mining: str = "mining") -> DataFrame:
    """Per event: invocations, fired, converted, whole-number mean, p95 (ceiling index), deadline hits and sums of payload blocks."""
    rows = events.where(F.col("event") != mining)
    o = F.coalesce("outcome", F.lit("skipped"))
    n = F.count("*")
    out = rows.groupBy("event").agg(
        n.alias("invocations"), F.count_if((o == "fired") | (F.col("payload_bytes") > 0)).alias("fired"), F.count_if(o == "invoked").alias("converted"),
        F.floor(F.sum("elapsed_ms") / n).alias("avg_ms"), F.count_if(o == "deadline").alias("deadline_hits"), F.sum("payload_bytes").alias("payload_bytes"), *[F.sum(c).alias(name) for name, c in blocks.items()],
    )
    return out.join(ceil_percentile(rows, ["event"], "elapsed_ms", 0.95, "p95_ms"), "event")


def ceil_percentile(rows: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """Per key the sorted value at position ceil(n * p), from counts by value, so that no group is gathered."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys)
    run = counts.select(*keys, value, F.sum("c").over(w.orderBy(value)).alias("hi"), F.sum("c").over(w).alias("n"))
    return run.where(F.col("hi") >= F.ceil(F.col("n") * p)).groupBy(*keys).agg(F.min(value).alias(name))


def variant_stats(results: DataFrame) -> DataFrame:
    keys = ["experiment_id", "variant"]
    n = F.count("*")
    out = results.groupBy(*keys).agg(n.alias("n"), F.avg("score").alias("mean_score"), F.avg("latency_ms").alias("mean_latency"), (F.count_if(F.col("result_count") == 0) / n).alias("zero_rate"), F.var_pop("score").alias("variance"))
    return out.join(ceil_percentile(results, keys, "latency_ms", 0.95, "p95"), keys)


def erf(x: Column) -> Column:
    """Error function by the polynomial of Abramowitz and Stegun, 7.1.26."""
    k = 1 / (1 + 0.3275911 * F.abs(x))
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / sqrt(2))) / 2


def significance(stats: DataFrame, level: float = 0.05) -> DataFrame:
    """Two-sided test of the two variants' mean scores of each experiment: z, p, effect size and winner."""
    a, b = (stats.where(F.col("variant") == v).select("experiment_id", *[F.col(c).alias(f"{c}_{v}") for c in ("n", "mean_score", "variance")]) for v in "AB")
    d = F.col("mean_score_A") - F.col("mean_score_B")
    z = d / F.sqrt(F.col("variance_A") / F.col("n_A") + F.col("variance_B") / F.col("n_B"))
    out = a.join(b, "experiment_id").withColumn("z", z).withColumn("p", 2 * (1 - normal_cdf(F.abs("z")))).withColumn("effect", d / F.sqrt((F.col("variance_A") + F.col("variance_B")) / 2))
    return out.withColumn("winner", F.when(F.col("p") < level, F.when(d > 0, "A").otherwise("B")))
