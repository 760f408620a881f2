"""Unified diffs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, functions as F


def unified_diff(old: Column, new: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), "old", "new", lineterm="", n=3)) for x, y in zip(a, b, strict=True)])

    return run(old, new)
