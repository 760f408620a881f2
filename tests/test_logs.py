"""Commit logs: a log of any length is many ranges."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loregrid.sources.logs import parse_commit_log


def test_a_long_log_is_parsed_in_ranges(spark):
    rnd = random.Random(4)
    lines, want = [], []
    for log in ("long", "short", "bare"):
        at = None
        for n in range({"long": 3_000, "short": 5, "bare": 4}[log]):
            if log != "bare" and rnd.random() < (0.002 if log == "long" else 0.5) and n > 1:
                at = f"c{n}"
                lines.append((log, n, f"commit {at}"))
            else:
                lines.append((log, n, rnd.choice(["a.rs", "b.rs", "", "  "])))
                if at and lines[-1][2].strip():
                    want.append((log, at, lines[-1][2]))
    rnd.shuffle(lines)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = parse_commit_log(spark.createDataFrame(lines, "log string, n int, value string")).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(key)
    assert sorted((r.log, r.commit, r.path) for r in got) == sorted(want)
    assert len({r.part for r in got if r.log == "long"}) > 1
