"""Mixing sources to target weights: iterative proportional fitting (raking), then sampling by calibrated probabilities."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import fresh, read, release, small, stored

#: Margins in the order in which they are raked, and the power of a category's share of tokens that is its default target.
MARGINS = {"source": 0.7, "lang": 0.5, "topic": 0.7}
#: Rounds of raking at least; as many again follow, up to a limit, while a margin is further from its target than the tolerance (relative).
ROUNDS, MOST_ROUNDS, TOLERANCE = 8, 24, 0.01
#: Token budget: the share of all tokens that the sample is to hold in expectation.
TOKEN_SHARE = 0.25
#: Cells up to which they are raked in one task and their probabilities broadcast.
MOST_CATEGORIES = 100_000
#: Digits of the hash that is compared with a probability.
_HEX = 13


def n_tokens(text: Column) -> Column:
    """Words between whitespace; null and blank texts have none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A topic for tables without one, from a text's form: table, brief, article or long."""
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(pipes * 10 >= F.greatest(tokens, F.lit(1)), "table").when(tokens < 100, "brief").when(tokens < 1000, "article").otherwise("long")


def categorised(docs: DataFrame) -> DataFrame:
    """``(row, key, _source, _lang, _topic, _tokens)``: each row of ``docs`` as a struct, so that no column of its own clashes, what it is drawn by (its doc_id, or its text if that is null) and its categories.

    Null categories are the category ''. A column ``topic`` is used if there is one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    of = lambda c: F.col(f"row.`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string")
    out = docs.select(row).select("row", n_tokens(F.col("row.text")).alias("_tokens"))
    topic = of("topic") if "topic" in docs.columns else topic_of(F.coalesce("row.text", F.lit("")), F.col("_tokens"))
    name = lambda c: F.coalesce(c, F.lit(""))
    return out.select("row", F.coalesce(of("doc_id"), F.col("row.text"), F.lit("")).alias("key"), name(of("source")).alias("_source"), name(of("lang")).alias("_lang"), name(topic).alias("_topic"), "_tokens")


def default_targets(cells: DataFrame) -> DataFrame:
    """``(margin, category, target)``: each category's share of tokens to the power in ``MARGINS``, scaled to sum 1 in each margin."""
    each = None
    for m, power in MARGINS.items():
        part = cells.groupBy(F.lit(m).alias("margin"), F.col(f"_{m}").alias("category")).agg(F.sum("n").cast("double").alias("n")).where("n > 0").withColumn("t", F.pow("n", F.lit(power)))
        each = part if each is None else each.union(part)
    total = each.groupBy("margin").agg(F.sum("t").alias("total"))
    return each.join(total, "margin").select("margin", "category", (F.col("t") / F.col("total")).alias("target"))


def rake(cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS, most: int = MOST_ROUNDS) -> DataFrame:
    """Stored factors ``(margin, category, factor)`` that fit ``cells(_source, _lang, _topic, n)`` to ``targets``.

    A cell's fitted weight is n times the product of its three factors. Each step sets one margin's factors
    to target / (sum of n times the other factors), so the last margin is met exactly. After ``rounds`` rounds
    the others are measured, and rounds go on until they are within ``TOLERANCE``; if ``most`` rounds don't get
    there (no weights may meet all targets, as where each source has one language), the last factors stand and a
    warning tells the distance. Categories without tokens or without target get no factor and no weight.
    """
    held = _raked(cells, targets, rounds, most)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(f"_{m}").alias("category"), F.col(f"f_{m}").alias("factor")) for m in MARGINS])).alias("x")
    return held.select(each).select("x.*").distinct()


def _raked(cells: DataFrame, targets: DataFrame, rounds: int, most: int) -> DataFrame:
    """Stored ``(_source, _lang, _topic, n, f_source, f_lang, f_topic, w)``: cells with the factors of ``rake`` and w, the weight of one token.

    Each step is a sum by category over the cells themselves, which a bounded number of cells does within one task.
    """
    held = cells
    for m in MARGINS:
        t = targets.where(F.col("margin") == m).select(F.col("category").alias(f"_{m}"), F.col("target").alias(f"t_{m}"))
        held = held.join(t, f"_{m}").withColumn(f"f_{m}", F.lit(1.0))
    held = stored(held, "raked")
    if held.count() <= MOST_CATEGORIES:
        held = held.coalesce(1)
    names, done = list(MARGINS), 0
    while True:
        for _ in range(rounds):
            for m in names:
                product = F.col("n")
                for other in names:
                    if other != m:
                        product = product * F.col(f"f_{other}")
                total = F.sum(product).over(W.partitionBy(f"_{m}"))
                held = held.withColumn("s", total).withColumn(f"f_{m}", F.when(F.col("s") > 0, F.col(f"t_{m}") / F.col("s")).otherwise(0.0)).drop("s")
        held, done = stored(held, "raked"), done + rounds
        weighted = held.where("n > 0").withColumn("w", F.lit(1.0) * F.col("f_source") * F.col("f_lang") * F.col("f_topic"))
        far = _distance(weighted, targets)
        if far <= TOLERANCE or done >= most:
            break
        held = held.coalesce(1) if held.count() <= MOST_CATEGORIES else held
    if far > TOLERANCE:
        warnings.warn(f"the margins can't all be met: {done} rounds of raking left one {far:.2g} from its target", stacklevel=3)
    release(cells.sparkSession)
    return weighted


def _shares(weighted: DataFrame, tokens: Column, name: str) -> DataFrame:
    """``(margin, category, name)``: each category's share of ``tokens``."""
    at = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(f"_{m}").alias("category")) for m in MARGINS])).alias("x")
    sums = weighted.select(at, tokens.alias("v")).groupBy("x.margin", "x.category").agg(F.sum("v").alias("v"))
    total = sums.groupBy("margin").agg(F.sum("v").alias("t"))
    return sums.join(total, "margin").select("margin", "category", F.when(F.col("t") > 0, F.col("v") / F.col("t")).otherwise(0.0).alias(name))


def _distance(weighted: DataFrame, targets: DataFrame) -> float:
    """The largest relative distance of a fitted margin from its target, among categories that have tokens."""
    met = _shares(weighted, F.col("n") * F.col("w"), "share").join(targets, ["margin", "category"]).where("target > 0")
    return met.agg(F.max(F.abs(F.col("share") / F.col("target") - 1))).first()[0] or 0.0


def _scale(weighted: DataFrame, share: float) -> float:
    """The c for which the probabilities min(1, c * w) make the sample hold ``share`` of all tokens in expectation.

    Cells that reach probability 1 are set aside and the rest is scaled anew, until no further cell does: a cell
    of large weight and few tokens thus costs the others nothing, however much data comes in.
    """
    c, full = 0.0, -1
    while True:
        sure = F.col("w") * F.lit(c) >= 1
        x = weighted.agg(F.sum("n").alias("n"), F.count_if(sure).alias("k"), F.sum(F.when(sure, F.col("n"))).alias("full"), F.sum(F.when(~sure, F.col("n") * F.col("w"))).alias("rest")).first()
        if not x.n or not x.rest:
            return float("inf")
        if x.k == full:
            return c
        c, full = (share * x.n - (x.full or 0)) / x.rest, x.k


def mixed(docs: DataFrame, targets: DataFrame | None = None, rounds: int = ROUNDS, share: float = TOKEN_SHARE) -> DataFrame:
    """``categorised(docs)`` with ``probability`` and ``sampled``.

    A document's probability is the calibrated weight of one of its tokens, raked over all documents' tokens, times a
    factor for which the sample holds ``share`` of all tokens in expectation; 1 at most. The same rows are sampled
    in every run (hash of doc_id, of the text where doc_id is null). Documents without tokens, or of a category without target, have probability 0.
    Repeated doc_ids of one category share their fate, as do equal texts without doc_id.
    """
    held = categorised(docs)
    cells = stored(held.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("n")), "cells")
    targets = targets if targets is not None else stored(default_targets(cells), "targets")
    weighted = stored(_raked(cells, targets, rounds, MOST_ROUNDS).select("_source", "_lang", "_topic", "n", "w"), "weights")
    c = _scale(weighted, share)
    p = weighted.select("_source", "_lang", "_topic", F.when(F.col("w") > 0, F.least(F.lit(1.0), F.col("w") * F.lit(c))).otherwise(0.0).alias("p"))
    u = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, _HEX), 16, 10).cast("double") / F.lit(float(16**_HEX))
    out = held.join(small(p, weighted.count(), MOST_CATEGORIES), ["_source", "_lang", "_topic"], "left")
    out = out.withColumn("probability", F.when(F.col("_tokens") > 0, F.round(F.coalesce("p", F.lit(0.0)), 9)).otherwise(0.0)).drop("p")
    return out.withColumn("sampled", u < F.col("probability"))


def sample(docs: DataFrame, targets: DataFrame | None = None, share: float = TOKEN_SHARE) -> DataFrame:
    """The sampled documents with all their columns and ``weight``, the probability (``_weight`` if there is a weight already)."""
    return mixed(docs, targets, share=share).where("sampled").select("row.*", F.col("probability").alias(fresh(docs, "weight")))


def margins(docs: DataFrame, targets: DataFrame | None = None, share: float = TOKEN_SHARE) -> DataFrame:
    """``(margin, category, target, expected, realised)``: shares of tokens that were aimed at, are expected by the probabilities, and that the sample holds."""
    if targets is None:
        cells = stored(categorised(docs).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("n")), "cells")
        targets = stored(default_targets(cells), "targets")
    m = mixed(docs, targets, share=share)
    sums = stored(m.groupBy("_source", "_lang", "_topic").agg(F.sum(F.col("_tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("sampled"), F.col("_tokens")).otherwise(0)).alias("s")), "realised")
    out = targets.select("margin", "category", "target")
    return out.join(_shares(sums, F.col("e"), "expected"), ["margin", "category"], "left").join(_shares(sums, F.col("s"), "realised"), ["margin", "category"], "left").fillna(0.0)


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens, probability, sampled."""
    keep = [c for c in ("doc_id", "text", "source", "lang", "topic") if c in docs.columns]
    return mixed(docs.select(keep)).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), "sampled",
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix_report`` of all documents; nulls, repeats and documents without words as in ``mixed``."""
    return mix_report(read(spark, sf_dir, "documents"))


def _sql(rounds: int = ROUNDS) -> str:
    ctes = [
        "d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents)",
        "t AS (SELECT doc_id, source, lang, CASE WHEN (length(text) - length(replace(text, '|', ''))) * 10 >= greatest(n_tokens, 1) THEN 'table' WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic, n_tokens, CASE WHEN doc_id IS NULL THEN text END AS own FROM d)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM t GROUP BY ALL)",
    ]
    for m, power in MARGINS.items():
        ctes.append(f"tg_{m} AS MATERIALIZED (SELECT {m}, pow(n, {power}) / sum(pow(n, {power})) OVER () AS target FROM (SELECT {m}, sum(n) AS n FROM cells GROUP BY 1 HAVING sum(n) > 0))")
        ctes.append(f"f_{m}_0 AS (SELECT {m}, 1.0::DOUBLE AS f FROM tg_{m})")
    at = dict.fromkeys(MARGINS, 0)
    for k in range(1, rounds + 1):
        for m in MARGINS:
            others = [o for o in MARGINS if o != m]
            joins = " ".join(f"JOIN f_{o}_{at[o]} USING ({o})" for o in others)
            product = " * ".join(f"f_{o}_{at[o]}.f" for o in others)
            ctes.append(f"f_{m}_{k} AS MATERIALIZED (SELECT {m}, CASE WHEN s > 0 THEN target / s ELSE 0 END AS f FROM tg_{m} JOIN (SELECT {m}, sum(n * {product}) AS s FROM cells {joins} GROUP BY 1) USING ({m}))")
            at[m] = k
    joins = " ".join(f"JOIN f_{m}_{rounds} USING ({m})" for m in MARGINS)
    product = " * ".join(f"f_{m}_{rounds}.f" for m in MARGINS)
    ctes.append(f"w AS MATERIALIZED (SELECT source, lang, topic, n, {product} AS w FROM cells {joins} WHERE n > 0)")
    # the first k cells by weight are sure; the first k that leaves the next one below 1 is the solution
    budget = f"{TOKEN_SHARE} * (SELECT sum(n) FROM w)"
    by_weight = "ORDER BY w DESC, source, lang, topic"
    ctes.append(
        f"k AS MATERIALIZED (SELECT 0 AS k, {budget} / sum(n * w) AS c, max(w) AS nxt FROM w UNION ALL SELECT row_number() OVER ({by_weight}), "
        f"({budget} - sum(n) OVER ({by_weight} ROWS UNBOUNDED PRECEDING)) / sum(n * w) OVER ({by_weight} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), lead(w) OVER ({by_weight}) FROM w)"
    )
    ctes.append("s AS MATERIALIZED (SELECT coalesce(arg_min(c, k), 1e300) AS c FROM k WHERE c * nxt < 1)")
    ctes.append("p AS (SELECT t.*, CASE WHEN n_tokens > 0 THEN round(coalesce(least(1, w * (SELECT c FROM s)), 0), 9) ELSE 0 END AS p FROM t LEFT JOIN w USING (source, lang, topic))")
    return f"WITH {', '.join(ctes)} SELECT doc_id, source, lang, topic, n_tokens, round(p, 6)::DOUBLE AS probability, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, own)), 1, {_HEX}))::BIGINT / {float(16**_HEX)!r}::DOUBLE < p AS sampled FROM p"


SQL = _sql()
