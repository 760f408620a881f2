"""Structured Streaming over append-only logs and file changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import commits

# Fixed value: order in which kinds of changes of one path prevail.
KIND_RANK = {"removed": 3, "created": 2, "modified": 1}


def events_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream; ``per_trigger`` files at a time are the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)


def collapsed_changes(batch: DataFrame) -> DataFrame:
    """One change for each path of a batch ``(path, kind, at_s)``: the strongest kind, the latest time; access is ignored."""
    rank = F.lit(0)
    for kind, n in KIND_RANK.items():
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    return batch.withColumn("rank", rank).where("rank > 0").groupBy("path").agg(F.max_by("kind", F.struct("rank", "at_s")).alias("kind"), F.max("at_s").alias("at_s"))


def routes(path: str = "path"):
    """Where a changed path goes: memory, doc, code, reconcile or none."""
    p = F.col(path)
    return F.when(p.rlike(r"(^|/)memory/[^/]+\.md$"), "memory").when(p.rlike(r"\.mdx?$|\.txt$"), "doc").when(p.rlike(r"\.(rs|py|go|ts|js|java|c|h|cpp)$"), "code").when(p.rlike(r"(^|/)(\.gitignore|config\.toml)$"), "reconcile").otherwise("none")


def table_stream(spark: SparkSession, folder: str, table: str, per_trigger: int = 16) -> DataFrame:
    """``<folder>/<table>.parquet``, a file or a folder of files, as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    fs, path = commits._fs(spark, f"{folder}/{table}.parquet")
    if fs.getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/{table}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now, each micro-batch given to ``sink`` with its number; a batch that failed comes again."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now; its result, written to the shared folder: the last one, or in append mode all of them.

    Each micro-batch writes a folder of its own number, so one that comes again replaces itself.
    """
    spark, root = stream.sparkSession, commits.fresh_dir(stream.sparkSession, f"stream-{name}")
    run(stream, lambda df, batch: df.write.mode("overwrite").parquet(f"{root}/out/batch={batch:09d}"), f"{root}/checkpoint", mode)
    batches = commits.listed(spark, f"{root}/out")
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{root}/out/{b}" for b in (batches[-1:] if mode == "complete" else batches)])


def session_gaps(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of each user's events, closed after ``gap`` without one; works on streams and on tables."""
    return events.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))


def running_counts(calls: DataFrame) -> DataFrame:
    """Running totals by session and tool."""
    return calls.groupBy("session_id", "tool").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def first_per_session(injections: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (cluster, session) once; a stream forgets pairs that are older than ``late``."""
    if injections.isStreaming:
        return injections.withWatermark("at", late).dropDuplicatesWithinWatermark(["cluster_id", "session"])
    return injections.dropDuplicates(["cluster_id", "session"])
