"""Innermost spans by one sorted sweep."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Lines of a stretch of a file; a span stands in every stretch that it reaches.
STRETCH = 4_096


def innermost(points: DataFrame, spans: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``(id, span)``: for each of ``points(id, path, line)`` the shortest of ``spans(id, path, line_start, line_end)`` that holds its line.

    Ties go to the smaller id; points outside all spans, and rows with null path or lines, have none. Starts and
    points of a stretch of a file stream by in order of lines, past a heap of the spans that are open: a point
    costs the spans that ended before it, once, not all spans of its file. Long files are several stretches, so no
    file is one task.
    """
    kind = dict(points.dtypes)["id"], dict(spans.dtypes)["id"]
    s = spans.where("path IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL AND line_end >= line_start")
    s = s.select("path", F.explode(F.sequence(F.floor(F.col("line_start") / stretch), F.floor(F.col("line_end") / stretch))).alias("part"), F.col("line_start").cast("long").alias("line"), F.col("line_end").cast("long").alias("line_end"), F.col("id").alias("span"), F.lit(None).cast(kind[0]).alias("point"), F.lit(0).alias("what"))
    p = points.where("path IS NOT NULL AND line IS NOT NULL")
    p = p.select("path", F.floor(F.col("line") / stretch).alias("part"), F.col("line").cast("long").alias("line"), F.lit(None).cast("long").alias("line_end"), F.lit(None).cast(kind[1]).alias("span"), F.col("id").alias("point"), F.lit(1).alias("what"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heap = None, []
        for batch in batches:
            ids, held = [], []
            for path, part, line, end, span, point, what in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if (path, part) != at:
                    at, heap = (path, part), []
                if not what:
                    heapq.heappush(heap, (end - line, span, end))
                    continue
                while heap and heap[0][2] < line:  # it ended, and lines only grow
                    heapq.heappop(heap)
                if heap:
                    ids.append(point)
                    held.append(heap[0][1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(5).type), pa.array(held, batch.schema.field(4).type)], names=["id", "span"])

    rows = s.unionByName(p).repartition("path", "part").sortWithinPartitions("path", "part", "line", "what")
    return rows.select("path", "part", "line", "line_end", "span", "point", "what").mapInArrow(run, f"id {kind[0]}, span {kind[1]}")
