"""Wiki links in Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def wiki_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line, target, display)`` of ``[[target|display]]`` outside fenced blocks and inline code; lines from 1.

    Fences are counted within the row's own array of lines, so a document never leaves its row.
    """
    lines = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("ls"))
    fences = F.transform("ls", lambda x: x.rlike(r"^\s*(```|~~~)").cast("int"))
    lines = lines.withColumn("fences", fences)
    open_before = lambda i: F.aggregate(F.slice("fences", F.lit(1), i), F.lit(0), lambda a, x: a + x) % 2
    has = F.exists("ls", lambda x: F.contains(x, F.lit("[[")))
    some = F.filter(F.transform("ls", lambda x, i: F.struct((i + 1).cast("int").alias("line"), F.when((open_before(i) == 0) & ~x.rlike(r"^\s*(```|~~~)"), F.regexp_replace(x, "`[^`]*`", "")).otherwise(F.lit("")).alias("s"))), lambda y: F.contains(y["s"], F.lit("[[")))
    found = lines.where(has).select(key, F.explode(some).alias("x")).select(key, "x.line", F.explode(F.regexp_extract_all("x.s", F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))).alias("l"))
    return found.select(key, "line", F.trim(F.regexp_extract("l", r"^([^|]*)", 1)).alias("target"), F.nullif(F.trim(F.regexp_extract("l", r"\|(.*)$", 1)), F.lit("")).alias("display"))
