"""Rows as CSV fields and Markdown table rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def csv_field(value: Column, always: bool = False) -> Column:
    """A CSV field, quoted if it has to be or ``always``."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if always else F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def markdown_row(*columns: str) -> Column:
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
