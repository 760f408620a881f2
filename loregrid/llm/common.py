"""Helpers that the corpus operators share: words, scratch tables, components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of the word contract: every ASCII character but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def words(col: Column) -> Column:
    """Array of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text in ASCII lower case."""
    return F.array_remove(F.split(ascii_lower(col), NOT_WORD), "")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or a local one in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/loregrid/{name}-{uuid.uuid4().hex}"


#: Has Spark drop a query's shuffle files as the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again.

    It cuts the lineage: what is read afterwards survives the loss of any executor. The shuffle files
    that the write needed go with it, so that they don't pile up over an operator's steps.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stored rows that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/loregrid/" in file:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets go of what the plans of a loop held on the driver: Spark drops broadcasts and compiled plans only as the JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within the bound, else as it is."""
    return F.broadcast(df) if rows <= most else df


#: Bytes of rows that are broadcast at most.
MOST_BYTES = 64 << 20


def bounded(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` of about ``width`` bytes are within ``MOST_BYTES``, else as it is."""
    return F.broadcast(df) if rows * (width + 16) <= MOST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters: ``name`` with as many underscores before it as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components: ``(node, root)`` of every node in ``edges``, root the smallest node reachable.

    Distributed union-find by alternating large-star and small-star steps. Each step groups by node
    with partial aggregation and is written to the shared folder, so lineage stays short.
    No links: no rows. Repeated links, loops and links in both directions do no harm; null ends are ignored.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(links)
    if not before[0]:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large")
        discard(links)
        # small star: a > b holds for every link; each smaller neighbour and the node itself go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        smaller = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        links = stored(smaller.where("a <> b").distinct(), "small")
        discard(large)
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
