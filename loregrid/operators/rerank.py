"""Reranking with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def rerank(pool: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], least: float) -> DataFrame:
    """``pool`` with ``score`` from ``scorer``, which sees a batch at a time, without rows below ``least``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.assign(score=scorer(pdf).astype(float))
            yield out[out["score"] >= least]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema.fields)
    return pool.mapInPandas(run, f"{schema}, score double")
