"""A stored lexical index: postings bucketed by term, in blocks of documents with their maxima; top-k by block-max pruning.

Layout under the root: ``segments/<id>/bucket=<b>/*.parquet``, a segment for each batch of documents, and commits
that name the segments with their numbers of documents and lengths. A row is one term in one block of documents:
arrays of ids, of counts and lengths by field, the largest count and the least length. A search reads the buckets
of its terms only, and of these the arrays of blocks that can still reach the k-th score.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import content_tokens
from ..operators.bounds import MOST_ROWS
from ..operators.lexical import B, K1
from . import commits

#: Documents of a block, blocks from which a query's first bound comes, and terms that are pushed down to the files as a list.
BLOCK, SEED_BLOCKS, FEW_TERMS = 128, 4, 200
#: Blocks of which one task writes a bucket's rows.
SPAN = 512
#: Postings of all queries' terms up to which they are scored at once: below it, bounds cost more than they save.
AT_ONCE = 20_000_000
#: Scores are compared to this many decimals, ties by id.
DIGITS = 6


def _block_rows(fields: list[str]) -> Callable[[pa.Table], pa.Table]:
    """A function from a block's documents ``(id, block, *fields as words)`` to the rows of its terms."""

    def run(docs: pa.Table) -> pa.Table:
        docs = docs.sort_by("id").combine_chunks()
        at: dict[str, dict[int, list[int]]] = {}
        sizes = []
        for k, f in enumerate(fields):
            words = docs.column(f).to_pylist()
            sizes.append(np.array([len(w) for w in words], dtype=np.int32))
            for row, ws in enumerate(words):
                for w, n in Counter(ws).items():
                    at.setdefault(w, {}).setdefault(row, [0] * len(fields))[k] = n
        terms = sorted(at)
        rows = np.array([r for w in terms for r in sorted(at[w])], dtype=np.int64)
        tfs = np.array([at[w][r] for w in terms for r in sorted(at[w])], dtype=np.int32).reshape(-1, len(fields))
        n = np.array([len(at[w]) for w in terms], dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(n)))
        parts, names, most = [docs.column("id").combine_chunks().take(pa.array(rows))], ["id"], {}
        for k, f in enumerate(fields):
            tf, size = tfs[:, k], sizes[k][rows]
            parts += [pa.array(tf), pa.array(size)]
            names += [f"tf_{f}", f"len_{f}"]
            if len(terms):
                most[f"max_{f}"] = pa.array(np.maximum.reduceat(tf, ends[:-1]))
                least = np.minimum.reduceat(np.where(tf > 0, size, np.iinfo(np.int32).max), ends[:-1])
                most[f"min_{f}"] = pa.array(least, mask=least == np.iinfo(np.int32).max)
            else:
                most[f"max_{f}"] = most[f"min_{f}"] = pa.array([], pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(parts, names))
        block = pa.array(np.full(len(terms), docs.column("block")[0].as_py() if docs.num_rows else 0, dtype=np.int32))
        return pa.table({"term": pa.array(terms, pa.string()), "block": block, "n": pa.array(n), **most, "p": lists})

    return run


class LexicalIndex:
    """BM25 over the content words of ``fields``; ids are unique, and a batch adds new ones."""

    def __init__(self, spark: SparkSession, root: str, fields: Sequence[str], buckets: int = 32) -> None:
        self.spark, self.root, self.fields, self.buckets = spark, root.rstrip("/"), list(fields), buckets

    def batches(self) -> list[str]:
        return [s["batch"] for s in commits.latest(self.spark, self.root)[1].get("segments", [])]

    def add(self, docs: DataFrame, batch: str) -> int:
        """Appends ``docs(id, *fields)`` as one segment; a batch that is there already changes nothing. Returns the version.

        Each text is tokenised once. Documents meet in blocks, of about ``BLOCK`` of them each, that make their terms' rows: a
        term that every document holds is as many rows as there are blocks, and never a group of its own.
        """
        version, content = commits.latest(self.spark, self.root)
        if batch in [s["batch"] for s in content.get("segments", [])]:
            return version
        n_blocks = max(1, ceil(docs.count() / BLOCK))
        toks = commits.kept(docs.select("id", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), *[content_tokens(F.col(f)).alias(f) for f in self.fields]), "tokens")
        # blocks are work, not bytes: Spark's own partitions would be cut by size
        tasks = max(self.spark.sparkContext.defaultParallelism, n_blocks // 256)
        rows = toks.repartition(tasks, "block").groupBy("block").applyInArrow(_block_rows(self.fields), self._shape(dict(docs.dtypes)["id"]))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        folder = uuid.uuid4().hex
        # a bucket is a task for each span of blocks, so a task's share is the same however many documents there are
        spans = ceil(n_blocks / SPAN)
        dealt = rows.repartitionById(self.buckets * spans, (F.col("bucket") * spans + F.floor(F.col("block") / SPAN)).cast("int"))
        dealt.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/segments/{folder}")
        # lengths and ids come from the documents, for one without words has no posting
        total = toks.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.size(f)), F.lit(0)).alias(f) for f in self.fields]).first()
        segment = {"folder": folder, "batch": batch, "n": total.n, "lengths": {f: total[f] for f in self.fields}}
        while True:
            try:
                commits.publish(self.spark, self.root, version + 1, {"fields": self.fields, "buckets": self.buckets, "segments": [*content.get("segments", []), segment]})
                return version + 1
            except commits.Conflict:
                version, content = commits.latest(self.spark, self.root)
                if batch in [s["batch"] for s in content["segments"]]:
                    return version

    def _shape(self, kind: str) -> str:
        each = ", ".join(f"tf_{f}: int, len_{f}: int" for f in self.fields)
        return f"term string, block int, n long, {', '.join(f'max_{f} int, min_{f} int' for f in self.fields)}, p array<struct<id: {kind}, {each}>>"

    def _blocks(self, wanted: DataFrame, n: int) -> DataFrame:
        """Rows of the index whose term is in ``wanted(term)``, of n rows, read from the terms' buckets only."""
        content = commits.latest(self.spark, self.root)[1]
        wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        out = None
        for s in content.get("segments", []):
            rows = self.spark.read.parquet(f"{self.root}/segments/{s['folder']}").withColumn("segment", F.lit(s["folder"]))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError(f"{self.root} holds no documents")
        if n <= 4 * self.buckets:  # many terms lie in all buckets
            out = out.where(F.col("bucket").isin([r.bucket for r in wanted.select("bucket").distinct().collect()]))
        if n <= FEW_TERMS:
            out = out.where(F.col("term").isin([r.term for r in wanted.select("term").collect()]))
        return out.join(F.broadcast(wanted) if n <= MOST_ROWS else wanted, ["bucket", "term"], "left_semi").withColumn("block", F.concat_ws("/", "segment", "block")).drop("segment")

    def _impact(self, f: str, weight: float, tf: Column, length: Column, average: float) -> Column:
        return F.lit(weight) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))

    def search(self, queries: DataFrame, k: int, weights: dict[str, float], require_all: bool = False) -> DataFrame:
        """``(query, id, score, rank)``: each query's k best of ``queries(query, terms)``, terms distinct, ties by id.

        Few postings are scored at once. More take three steps, all exact: an upper bound of every block that holds a query's terms, from the maxima alone;
        the scores of the few blocks with the largest bounds, whose k-th is a lower bound of the result's; the scores
        of the other blocks that reach it. With ``require_all`` only documents with all terms count, and only
        blocks that hold all.
        """
        segments = commits.latest(self.spark, self.root)[1].get("segments", [])
        n_docs = sum(s["n"] for s in segments)
        average = {f: max(1e-9, sum(s["lengths"][f] for s in segments) / max(1, n_docs)) for f in self.fields}
        asked = commits.kept(queries.select("query", F.explode("terms").alias("term"), F.size("terms").alias("n_terms")), "asked")
        n_asked = asked.count()
        few = F.broadcast if n_asked <= MOST_ROWS else lambda df: df
        blocks = self._blocks(asked.select("term").distinct(), n_asked)
        df = commits.kept(blocks.groupBy("term").agg(F.sum("n").alias("df")), "counts")
        idf = df.select("term", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        weighed = few(asked.join(few(idf), "term"))

        def scored(pairs: DataFrame | None) -> DataFrame:
            """Scores of the documents in the given pairs of query and block, or of all."""
            score = sum((F.when(F.col(f"x.tf_{f}") > 0, self._impact(f, w, F.col(f"x.tf_{f}"), F.col(f"x.len_{f}"), average[f])).otherwise(0.0) for f, w in weights.items()), F.lit(0.0))
            met = blocks.select("term", "block", "p").join(weighed, "term")
            met = met if pairs is None else met.join(pairs, ["query", "block"])
            each = met.select("query", "n_terms", "idf", F.explode("p").alias("x")).select("query", "n_terms", F.col("x.id").alias("id"), (F.col("idf") * score).alias("s"))
            out = each.groupBy("query", "id").agg(F.round(F.sum("s"), DIGITS).alias("score"), F.count("*").alias("matched"), F.first("n_terms").alias("n_terms"))
            return (out.where("matched = n_terms") if require_all else out).select("query", "id", "score")

        placed = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        if (asked.join(few(df), "term").agg(F.sum("df")).first()[0] or 0) <= AT_ONCE:
            return placed(scored(None))
        top = sum((F.when(F.col(f"max_{f}") > 0, self._impact(f, w, F.col(f"max_{f}"), F.col(f"min_{f}"), average[f])).otherwise(0.0) for f, w in weights.items()), F.lit(0.0))
        bounds = blocks.select("term", "block", top.alias("top")).join(weighed, "term").groupBy("query", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"), F.count("*").alias("held"), F.first("n_terms").alias("n_terms"))
        bounds = commits.kept(bounds.where("held = n_terms") if require_all else bounds, "bounds")

        best = W.partitionBy("query").orderBy(F.desc("bound"), "block")
        seeds = bounds.withColumn("r", F.row_number().over(best)).where(F.col("r") <= SEED_BLOCKS).select("query", "block")
        seeds = commits.kept(seeds, "seeds")
        small = F.broadcast if seeds.count() <= MOST_ROWS else lambda df: df
        first = commits.kept(placed(scored(small(seeds))), "first")
        floor = first.where(F.col("rank") == k).select("query", (F.col("score") - 10.0**-DIGITS).alias("floor"))
        rest = bounds.join(small(floor), "query", "left").where("floor IS NULL OR bound >= floor").join(small(seeds), ["query", "block"], "left_anti").select("query", "block")
        rest = commits.kept(rest, "rest")
        second = scored(small(rest) if rest.count() <= MOST_ROWS else rest)
        return placed(first.drop("rank").unionByName(second))
