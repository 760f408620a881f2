"""Source trees: a distributed listing, ignore rules as rows, and the files that they leave."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.bounds import small
from ..storage import commits

# Name of the files that hold rules, and bytes up to which a file is read.
RULES_FILE, MOST_BYTES = ".gitignore", 1 << 20
_RULE = "n int, regex string, negated boolean, dirs_only boolean"


def rule(line: str) -> tuple[str, bool, bool] | None:
    """A line of an ignore file as (regex for paths relative to the file's folder, negated, for folders only); None if it is no rule.

    A slash at the start or inside anchors a pattern; without one it may stand at any depth. ``**`` stands for any
    number of folders, ``*`` and ``?`` stay within a name, trailing blanks count only after a backslash.
    """
    line = re.sub(r"(?<!\\)((?:\\\\)*)[ \t\r]+$", r"\1", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    dirs_only = line.endswith("/")
    line = line.rstrip("/") if dirs_only else line
    if not line:
        return None
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
            while line[i : i + 1] == "*":
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2 + (line[i + 1 : i + 2] in ("!", "^")))) > 0:
            inside = line[i + 1 : end]
            no = inside[:1] in ("!", "^")
            out += "(?!/)[" + "^" * no + re.sub(r"([\\\[\]&~|^])", r"\\\1", inside[no:]) + "]"
            i = end + 1
        else:
            if c == "\\" and i + 1 < len(line):
                i += 1
                c = line[i]
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, dirs_only


def _parsed(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rule(x or "") or (None, None, None) for x in lines], columns=["regex", "negated", "dirs_only"])


def rules_of(files: DataFrame) -> DataFrame:
    """``(folder, rules)`` from the ignore files among ``files(path, content)``: each folder's rules in order, '' being the root."""
    held = files.where(F.col("path").rlike(rf"(^|/){re.escape(RULES_FILE)}$")).select(F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("n", "line"))
    parsed = held.select("folder", "n", F.pandas_udf(_parsed, "regex string, negated boolean, dirs_only boolean")("line").alias("r")).where("r.regex IS NOT NULL").select("folder", F.struct("n", "r.regex", "r.negated", "r.dirs_only").alias("r"))
    return parsed.groupBy("folder").agg(F.sort_array(F.collect_list("r")).alias("rules"))


def _folders(path: str):
    """Array of the folders above a path, the root's '' first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``(path)``: those of ``paths(path)`` that ``rules(folder, rules)`` leave out.

    The rules of every folder above a path are met with it; of the deepest folder that has a match the last one
    decides. What lies in an ignored folder is ignored, whatever is negated below. Folders are judged once each.
    """
    files = paths.select("path").distinct()
    up = files.select("path", F.explode(_folders("path")).alias("folder")).where("folder <> ''")
    nodes = files.select("path", F.lit(False).alias("is_dir")).union(up.select("folder", F.lit(True)).distinct())
    met = nodes.select("path", "is_dir", F.explode(_folders("path")).alias("folder")).join(small(rules), "folder")
    inside = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substring("path", F.length("folder") + 2, F.length("path")))
    hits = met.select("path", "is_dir", "folder", "rules", inside.alias("inside"))
    hits = hits.selectExpr("path", "is_dir", "folder", "try_element_at(filter(rules, r -> (NOT r.dirs_only OR is_dir) AND inside RLIKE r.regex), -1) AS hit")
    judged = hits.where("hit IS NOT NULL").groupBy("path", "is_dir").agg(F.max_by("hit", F.length("folder")).alias("hit")).where("NOT hit.negated")
    out = judged.where("NOT is_dir").select("path").union(up.join(judged.where("is_dir").select(F.col("path").alias("folder")), "folder", "left_semi").select("path"))
    return out.distinct()


def visible(files: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``files(path, content, ...)`` without what their own ignore files, or the ``extra`` patterns at the root, leave out.

    Extra patterns only exclude: no ignore file brings back what they name. Null paths are left out.
    """
    files = files.where("path IS NOT NULL")
    rules = commits.kept(rules_of(files), "rules")
    out = files.join(ignored(files, rules), "path", "left_anti")
    if extra:
        own = [r for r in map(rule, extra) if r]
        more = files.sparkSession.createDataFrame([("", [(n, *r) for n, r in enumerate(own)])], f"folder string, rules array<struct<{_RULE.replace(' ', ':').replace(',:', ',')}>>")
        out = out.join(ignored(files, more), "path", "left_anti")
    return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, mtime)`` of all files under ``root`` (a URI), hidden ones too, paths relative to it.

    Folders are listed by tasks, one level after the other, so no machine walks the whole tree.
    """
    root = root.rstrip("/")

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for batch in batches:
            out = []
            for folder in batch.column(0).to_pylist():
                for x in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base)):
                    out.append((f"{folder}/{x.base_name}".lstrip("/"), x.type == pafs.FileType.Directory, x.size, x.mtime_ns))
            names = ["path", "is_dir", "size", "mtime"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=names)

    frontier, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = commits.kept(frontier.repartition("path").mapInArrow(level, "path string, is_dir boolean, size long, mtime long"), "level")
        part = found.where("NOT is_dir").select("path", "size", "mtime")
        files = part if files is None else files.unionByName(part)
        frontier = found.where("is_dir").select("path")
        if frontier.isEmpty():
            return files


def contents(files: DataFrame, root: str, most: int = MOST_BYTES) -> DataFrame:
    """``files(path, size, ...)`` with ``content``: the text of files up to ``most`` bytes that are UTF-8; null for others and for files that went meanwhile."""
    root = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for batch in batches:
            paths, sizes = batch.column("path").to_pylist(), batch.column("size").to_pylist()
            for at, (path, size) in enumerate(zip(paths, sizes, strict=True)):  # a row at a time: no batch of whole texts
                text = None
                if size is not None and size <= most:
                    try:
                        text = fs.open_input_stream(f"{base}/{path}").read().decode("utf-8")
                    except (UnicodeDecodeError, FileNotFoundError):
                        text = None
                yield pa.RecordBatch.from_arrays([*batch.slice(at, 1).columns, pa.array([text], pa.string())], names=[*batch.schema.names, "content"])

    return files.mapInArrow(run, files.withColumn("content", F.lit(None).cast("string")).schema)


def scan(spark: SparkSession, root: str, extra: Sequence[str] = (), most: int = MOST_BYTES) -> DataFrame:
    """``(path, size, mtime, content)`` of the files under ``root`` that no ignore rule leaves out; only these are read.

    Ignore files are read first, the rest after they have been applied.
    """
    files = commits.kept(listing(spark, root), "listing")
    is_rules = F.col("path").rlike(rf"(^|/){re.escape(RULES_FILE)}$")
    rules = contents(files.where(is_rules), root, most).select("path", "size", "mtime", "content")
    shown = visible(rules.unionByName(files.where(~is_rules).withColumn("content", F.lit(None).cast("string"))), extra)
    return contents(shown.drop("content"), root, most)
