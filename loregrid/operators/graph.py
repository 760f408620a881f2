"""Document graph: reference resolution, traversal, evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import ref_forms
from .duplication import _cut


def resolve(refs: DataFrame, docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """``refs`` with ``target``: the document that ``target_ref`` names, by its forms in order, else by alias (smallest id)."""
    forms = refs.select("id", F.posexplode(ref_forms(F.col("target_ref"))).alias("p", "form"))
    paths = docs.groupBy(F.col("path").alias("form")).agg(F.min("id").alias("doc"))
    by_path = forms.join(paths, "form").groupBy("id").agg(F.min_by("doc", "p").alias("by_path"))
    by_alias = aliases.groupBy(F.col("alias").alias("target_ref")).agg(F.min("doc_id").alias("by_alias"))
    return refs.join(by_path, "id", "left").join(by_alias, "target_ref", "left").withColumn("target", F.coalesce("by_path", "by_alias")).drop("by_path", "by_alias")


def neighbors(links: DataFrame, start: int, depth: int) -> DataFrame:
    """``(entity, depth, via)``: nodes within ``depth`` undirected hops of ``start``, with the relations of the last hop in order."""
    both = links.select(F.col("src").alias("f"), F.col("dst").alias("entity"), "relation").union(links.select("dst", "src", "relation"))
    seen = frontier = links.sparkSession.range(1).select(F.lit(start).cast("long").alias("entity"), F.lit(0).alias("depth"), F.lit("").alias("via"))
    for d in range(1, depth + 1):
        step = both.join(frontier.select(F.col("entity").alias("f")), "f").join(seen.select("entity"), "entity", "left_anti")
        frontier = _cut(step.groupBy("entity").agg(F.lit(d).alias("depth"), F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("via")))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen.where("depth > 0")


def shortest_path(links: DataFrame, start: int, target: int, most: int) -> DataFrame:
    """One row ``path`` (ids joined by ``>``) of a shortest undirected path, the least in order of ids; none beyond ``most`` hops."""
    both = links.select("src", "dst").union(links.select("dst", "src")).distinct().toDF("f", "t")
    frontier = links.sparkSession.range(1).select(F.lit(start).cast("long").alias("f"), F.array(F.lit(start).cast("long")).alias("path"))
    seen = frontier.select("f")
    for _ in range(most + 1):
        hit = frontier.where(F.col("f") == target)
        if not hit.isEmpty():
            return hit.agg(F.min("path").alias("path")).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))
        step = both.join(frontier, "f").join(seen.toDF("t"), "t", "left_anti").select("t", F.concat("path", F.array("t")).alias("path"))
        frontier = _cut(step.groupBy(F.col("t").alias("f")).agg(F.min("path").alias("path")))
        seen = seen.union(frontier.select("f"))
        if frontier.isEmpty():
            break
    return links.sparkSession.createDataFrame([], "path string")


def latest_evolution(evolution: DataFrame) -> DataFrame:
    """The newest superseding or retracting evolution of each target: ``(id, status, by)``."""
    e = evolution.where("relationship IN ('supersedes', 'retracts')").groupBy(F.col("target_doc_id").alias("id")).agg(F.max_by(F.struct("relationship", "source_doc_id"), F.struct("created_at", "id")).alias("e"))
    return e.select("id", F.when(F.col("e.relationship") == "supersedes", "superseded").otherwise("retracted").alias("status"), F.col("e.source_doc_id").alias("by"))


def current_versions(evolution: DataFrame, rounds: int = 30) -> DataFrame:
    """``(id, current)``: the end of each superseded document's chain, the newest successor at every step; cycles stop at their smallest step."""
    nxt = _cut(evolution.where("relationship = 'supersedes' AND source_doc_id <> target_doc_id").groupBy(F.col("target_doc_id").alias("id")).agg(F.max_by("source_doc_id", F.struct("created_at", "id")).alias("current")))
    for _ in range(rounds):
        step = nxt.join(nxt.toDF("current", "further"), "current", "left")
        moved = _cut(step.select("id", F.when(F.col("further") == F.col("id"), F.col("current")).otherwise(F.coalesce("further", "current")).alias("current"), (F.col("further").isNotNull() & (F.col("further") != F.col("id"))).alias("moved")))
        nxt = moved.select("id", "current")
        if moved.where("moved").isEmpty():
            break
    return nxt
