"""A stored trigram index over names: substring search by the rarest postings of a pattern, verified on the names."""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.bounds import small
from . import commits

#: Names of a block, and the rarest trigrams of a pattern whose postings are intersected.
BLOCK, RAREST = 4_096, 3


def grams(text: str | Column) -> Column:
    """Distinct runs of three characters; none of shorter texts."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


class TrigramIndex:
    """Names by id under ``root``: ``names/<id>`` and postings ``grams/<id>/bucket=<b>``, one row for a trigram in a block of names."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def add(self, names: DataFrame, batch: str) -> TrigramIndex:
        """Appends ``names(id, name)``, ids new; a batch that is there already changes nothing."""
        version, content = commits.latest(self.spark, self.root)
        if batch in content:
            return self
        folder = uuid.uuid4().hex
        names.select("id", "name").write.parquet(f"{self.root}/names/{folder}")
        held = self.spark.read.parquet(f"{self.root}/names/{folder}")
        blocks = max(1, ceil(held.count() / BLOCK))
        each = held.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(grams("name")).alias("gram"))
        rows = each.groupBy("gram", "block").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))  # a block's names at most
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int"))
        rows.repartition("bucket", F.floor(F.col("block") / 1_024)).sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{self.root}/grams/{folder}")
        commits.publish(self.spark, self.root, version + 1, content | {batch: folder})
        return self

    def names(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/names/{f}" for f in commits.latest(self.spark, self.root)[1].values()])

    def postings(self) -> DataFrame:
        """``(gram, block, n, ids, bucket)``."""
        out = None
        for f in commits.latest(self.spark, self.root)[1].values():
            rows = self.spark.read.parquet(f"{self.root}/grams/{f}").withColumn("block", F.concat(F.lit(f"{f}/"), F.col("block").cast("string")))
            out = rows if out is None else out.unionByName(rows)
        return out

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """``(query, id)``: names that hold the ``RAREST`` rarest trigrams of ``patterns(query, text)``, patterns of 3 characters or more.

        Counts come first, without the lists; then only the chosen trigrams' lists are read, from their buckets, and
        met block by block. A trigram that no name has leaves no candidate.
        """
        asked = patterns.where(F.length("text") >= 3).select("query", F.explode(grams("text")).alias("gram"))
        asked = commits.kept(asked.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int")), "grams")
        at = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most the number of buckets
        held = self.postings().where(F.col("bucket").isin(at))
        counts = held.join(small(asked.select("bucket", "gram").distinct()), ["bucket", "gram"], "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
        rare = W.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "gram")
        chosen = asked.join(counts, "gram", "left").withColumn("r", F.row_number().over(rare)).where(F.col("r") <= RAREST)
        chosen = commits.kept(chosen.withColumn("needed", F.count("*").over(W.partitionBy("query"))).select("query", "bucket", "gram", "needed"), "chosen")
        lists = held.join(small(chosen), ["bucket", "gram"]).groupBy("query", "block", "needed").agg(F.collect_list("ids").alias("lists")).where("size(lists) = needed")
        both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        return lists.select("query", F.explode(both).alias("id"))

    def search(self, patterns: DataFrame) -> DataFrame:
        """``(query, id)``: names that contain the pattern, exactly. Patterns under 3 characters, which no trigram stands for, read all names."""
        names = self.names()
        long = self.candidates(patterns).join(small(patterns), "query").join(names, "id").where(F.contains("name", F.col("text"))).select("query", "id")
        short = small(patterns.where((F.length("text") < 3) & (F.length("text") > 0)))
        return long.unionByName(names.join(short, F.contains("name", F.col("text"))).select("query", "id"))
