"""BM25 in one pass over texts that have no stored index (``storage.postings`` keeps one)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_tokens
from .bounds import MOST_ROWS

# BM25 constants and what a superseded document loses.
K1, B, SUPERSEDED_PENALTY = 1.2, 0.75, 0.5


def bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, tuple[Column, float]], require_all: bool = False) -> DataFrame:
    """``(query, id, score)`` for ``queries(query, terms)``, terms distinct.

    Only postings of query terms are kept: the terms are broadcast before anything is shuffled, up to
    ``MOST_ROWS`` of them, counted, and joined by a shuffle beyond. Lengths and document counts cover all documents.
    """
    toks = {f: content_tokens(c) for f, (c, _) in fields.items()}
    asked = queries.select("query", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))
    wanted = asked.select("term").distinct()
    # the terms asked for bound both their distinct words and the words' document counts
    few = F.broadcast if (queries.agg(F.sum(F.size("terms"))).first()[0] or 0) <= MOST_ROWS else lambda df: df
    sized = docs.select("id", *[t.alias(f"w_{f}") for f, t in toks.items()])
    stats = sized.agg(F.count("*").alias("n_docs"), *[F.avg(F.size(f"w_{f}")).alias(f"avg_{f}") for f in toks])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(f"w_{f}").alias("len"), F.col(f"w_{f}").alias("ws")) for f in toks]))
    hits = sized.select("id", each.alias("x")).select("id", "x.field", "x.len", F.explode("x.ws").alias("term")).join(few(wanted), "term", "left_semi")
    hits = hits.groupBy("id", "field", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = hits.groupBy("term").agg(F.countDistinct("id").alias("df"))
    weight, avg = F.lit(0.0), F.lit(1.0)
    for f, (_, w) in fields.items():
        weight, avg = F.when(F.col("field") == f, w).otherwise(weight), F.when(F.col("field") == f, F.col(f"avg_{f}")).otherwise(avg)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg))
    scored = hits.join(few(df), "term").crossJoin(F.broadcast(stats)).select("id", "term", part.alias("s"))
    out = scored.join(few(asked), "term").groupBy("query", "id", "n_terms").agg(F.sum("s").alias("score"), F.countDistinct("term").alias("matched"))
    return (out.where("matched = n_terms") if require_all else out).select("query", "id", "score")
