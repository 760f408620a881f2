"""Line-oriented sources: session transcripts, hook logs, commit logs, Markdown collections and memory files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..storage import commits

RECORD = "type string, timestamp string, sessionId string, gitBranch string, message struct<content: string>"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, type, at, session, text)`` of user and assistant records of JSONL transcripts; broken and other records are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return parse_records(lines.select("file", F.lit(None).cast("int").alias("line"), "value"))


def parse_records(lines: DataFrame) -> DataFrame:
    """``lines(file, line, value)`` as typed records; content may be a text or a list of blocks, whose texts are joined."""
    r = lines.withColumn("r", F.from_json("value", RECORD, {"mode": "PERMISSIVE"})).where(F.col("r.type").isin("user", "assistant"))
    blocks = F.from_json(F.col("r.message.content"), "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.when(F.col("r.message.content").rlike(r"^\s*\[\s*\{"), joined).otherwise(F.col("r.message.content"))
    return r.select("file", "line", F.col("r.type").alias("type"), F.unix_timestamp(F.try_to_timestamp("r.timestamp")).alias("at_s"), F.col("r.sessionId").alias("session"), text.alias("text")).where("text is not null")


def read_hook_log(spark: SparkSession, path: str, since: int) -> DataFrame:
    """Hook events at or after ``since``, from JSONL; lines that aren't JSON objects are left out."""
    schema = "ts string, event string, outcome string, elapsed_ms bigint, payload_bytes bigint, payload_blocks map<string, bigint>, reason string"
    return spark.read.schema(schema).json(path).withColumn("at_s", F.unix_timestamp(F.try_to_timestamp("ts"))).where(F.col("event").isNotNull() & (F.col("at_s") >= since))


def parse_commit_log(lines: DataFrame, mark: str = "commit ") -> DataFrame:
    """``(log, commit, path)`` from ``lines(log, n, value)`` of a name-only log; a line belongs to the last commit line above it.

    Lines are sorted in ranges over all logs, so a long log is many ranges; a range's first lines take the last commit of the ranges before it.
    """
    own = F.when(F.col("value").startswith(mark), F.substring("value", F.lit(len(mark) + 1), F.lit(64)))
    held = lines.select("log", "n", "value").repartitionByRange("log", "n").sortWithinPartitions("log", "n").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    ranges = commits.kept(held.select("log", "value", "_part", "_at"), "ranges")
    marks = ranges.groupBy("_part", "log").agg(F.max(F.when(own.isNotNull(), F.col("_at"))).alias("_mark"))  # a row for each log in each range
    last = commits.kept(marks.join(ranges.where(own.isNotNull()).select(F.col("_at").alias("_mark"), own.alias("_last")), "_mark", "left").select("_part", "log", "_last"), "marks")
    before = last.select("_part", "log", F.last("_last", ignorenulls=True).over(W.partitionBy("log").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    w = W.partitionBy("_part", "log").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    told = ranges.withColumn("commit", F.last(own, ignorenulls=True).over(w)).where(~F.col("value").startswith(mark) & (F.trim("value") != "")).join(before, ["_part", "log"])
    return told.withColumn("commit", F.coalesce("commit", "_before")).where("commit IS NOT NULL").select("log", "commit", F.col("value").alias("path"))


def owned(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files(path)`` with the ``collection`` of the most specific of ``roots(collection, root)``; files outside all go.

    A file meets the roots by an equi-join on the folders above it.
    """
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    hit = files.select("path", F.explode(above).alias("root")).join(roots, "root")
    return hit.groupBy("path").agg(F.max_by("collection", F.struct(F.length("root"), "root")).alias("collection"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)`` from ``(path, hash)`` before and after: added, removed, updated or unchanged."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full")
    return both.select("path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "updated").otherwise("unchanged").alias("change"))


def to_markdown() -> Column:
    """A memory entry as a Markdown file: header with sorted fields, then the content."""
    q = lambda c: F.to_json(F.array(c))
    head = F.concat(F.lit("---\nid: "), "id", F.lit("\nstatus: "), "status", F.lit("\ntags: ["), F.replace("tags", F.lit(","), F.lit(", ")), F.lit("]\ntitle: "), F.regexp_replace(q(F.col("title")), r"^\[|\]$", ""), F.lit("\ntype: "), "entry_type", F.lit("\n---\n"))
    return F.concat(head, "content")


def from_markdown(text: Column) -> Column:
    """The entry of a Markdown file as a struct; ``error`` says why a file is quarantined."""
    field = lambda k: F.regexp_extract(text, rf"(?m)^{k}: (.*)$", 1)
    body = F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")
    error = F.when(text.rlike(r"(?m)^<{7} "), "conflict markers").when(~text.rlike(r"(?s)^---\n.*?\n---\n"), "no header").when(field("id") == "", "no id")
    title = F.coalesce(F.get_json_object(F.concat(F.lit('{"t":'), field("title"), F.lit("}")), "$.t"), field("title"))
    return F.struct(field("id").alias("id"), title.alias("title"), field("type").alias("entry_type"), field("status").alias("status"), body.alias("content"), error.alias("error"))


def parse_journal(docs: DataFrame) -> DataFrame:
    """``docs(id, text)``: journal bullets as ``(id, date, section, n, bullet)``; headings and dates apply to the lines below them."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    w = W.partitionBy("id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    date = F.nullif(F.regexp_extract("l", r"^#+\s.*?(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    section = F.nullif(F.regexp_extract("l", r"^##+\s+(.+?)\s*$", 1), F.lit(""))
    marked = lines.withColumn("date", F.last(date, ignorenulls=True).over(w)).withColumn("section", F.last(section, ignorenulls=True).over(w))
    return marked.where(F.col("l").rlike(r"^\s*[-*]\s+\S")).select("id", "date", "section", "n", F.regexp_replace("l", r"^\s*[-*]\s+", "").alias("bullet"))
