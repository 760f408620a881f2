"""Source mixing: the sample against its targets and its token budget."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from loregrid.llm import mixing

SF = "/root/testdata"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_scale_meets_the_budget(spark):
    """Against bisection, with a cell so rare and heavy that it alone would set the scale."""
    cells = [("a", "x", "t", 1000, 1.0), ("b", "x", "t", 500, 2.0), ("c", "y", "u", 3, 5000.0), ("d", "y", "u", 200, 0.1)]
    df = spark.createDataFrame(cells, "_source string, _lang string, _topic string, n long, w double")
    for share in (0.05, 0.25, 0.6, 0.95):
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * min(1, mid * w) for *_, n, w in cells) < share * 1703 else (lo, mid)
        assert mixing._scale(df, share) == pytest.approx(hi, rel=1e-6)
    assert mixing._scale(df, 1.0) * 0.1 >= 1 - 1e-9
    assert mixing._scale(df.limit(0), 0.5) == float("inf")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sample_is_near_targets_and_grows_with_its_input(spark):
    for sf in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"{SF}/{sf}/documents.parquet")
        held = mixing.mixed(docs)
        t, p = F.col("_tokens"), F.col("probability")
        n, mean, var = held.agg(F.sum(t), F.sum(t * p), F.sum(t * t * p * (1 - p))).first()
        sd = var**0.5 / mean  # of the sample's size, relative
        kept = mixing.sample(docs).agg(F.sum(mixing.n_tokens(F.col("text")))).first()[0] / n
        assert mean / n == pytest.approx(mixing.TOKEN_SHARE, rel=1e-6)
        assert sd < (0.1 if sf == "sf0.01" else 0.03) and abs(kept / mixing.TOKEN_SHARE - 1) <= 4 * sd
        for r in mixing.margins(docs).collect():
            assert abs(r.expected - r.target) <= 0.01, r
            assert abs(r.realised - r.target) <= 0.01 + 4 * sd * r.target**0.5, r


def test_impossible_targets_are_told(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "_source string, _lang string, _topic string, n long")
    targets = spark.createDataFrame([("source", "a", 0.9), ("source", "b", 0.1), ("lang", "x", 0.1), ("lang", "y", 0.9), ("topic", "t", 1.0)], "margin string, category string, target double")
    with pytest.warns(UserWarning, match="can't all be met"):
        assert mixing.rake(cells, targets, 2, 3).count() == 5


def test_odd_rows_and_clashing_columns(spark):
    names = ["w", "p", "_w", "_source", "_tokens", "row", "key", "weight", "probability", "sampled", "f_source"]
    rows = [(i % 9 if i % 10 else None, None if i % 11 == 0 else "" if i % 13 == 0 else "word " * i, "en", f"s{i % 3}", i, *["own"] * len(names)) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS + "".join(f", {n} string" for n in names))
    out = mixing.sample(df, share=0.9)
    assert out.columns == [*df.columns, "_weight"] and 0 < out.count() < 60
    assert out.where("text is null or text = '' or weight <> 'own'").count() == 0
    assert mixing.sample(df.limit(0)).count() == 0


def test_documents_without_id_are_drawn_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"text number {k} of some words", "en", "a", 10) for k in range(300)] + [(None, "the same text", "en", "a", 3)] * 2, DOCS)
    for share in (0.25, 0.9):
        kept = mixing.sample(docs, share=share).groupBy("text").count().collect()
        assert abs(len(kept) / 301 - share) < 0.1
        assert {r["count"] for r in kept if r.text == "the same text"} <= {2}
