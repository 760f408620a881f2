"""Folders in shared storage and versions that appear at once: numbered JSON files, each published by one rename."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer published the version first."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only where none is set in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints', spark.sparkContext.applicationId)}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again: the plan behind them ends here."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A hash that changes with the files under ``paths``: names, lengths, times of change."""
    h = hashlib.sha256()
    for path in paths:
        fs, p = _fs(spark, path)
        files = fs.listFiles(p, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        h.update(json.dumps(sorted(found)).encode())
    return h.hexdigest()[:24]


def _name(version: int) -> str:
    return f"{version:012d}.json"


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The newest version under ``root`` and its content; 0 and nothing before the first."""
    names = [n for n in listed(spark, f"{root}/commits") if n.endswith(".json") and not n.startswith((".", "_"))]
    return (int(names[-1][:12]), load(spark, root, int(names[-1][:12]))) if names else (0, {})


def load(spark: SparkSession, root: str, version: int) -> dict:
    fs, p = _fs(spark, f"{root}/commits/{_name(version)}")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Makes ``content`` the given version: written aside, then renamed, which fails if the version is there already.

    Readers see the whole version or none of it, whenever the writer dies.
    """
    fs, aside = _fs(spark, f"{root}/commits/_{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    jvm, final = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits/{_name(version)}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(final), never)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(final):
            raise Conflict(f"version {version} of {root} is taken") from e
        raise
