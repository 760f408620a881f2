"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filters, graphs, lifecycle, relational, scalars, search  # noqa: F401  they register themselves
from .catalog import QUERIES, SQL, query  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["RET05"](spark, sf_dir)
