"""Approximate nearest neighbours: balanced posting lists with replicated boundary vectors, found by a graph over centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from .common import read, small, stored

#: Vectors that the centroids are fitted on, at most: those with the smallest hashes.
MOST_FITTED = 65_536
#: Distinct vectors of a posting list that are aimed at, and the vectors of the sample that a centroid needs at least:
#: with more than LIST_SIZE * MOST_FITTED / LEAST_SHARE vectors lists grow, and are searched in blocks.
LIST_SIZE, LEAST_SHARE = 128, 8
#: Cells of the matrices that the fit holds at once.
_CELLS = 4_000_000
#: A vector is put in up to REPLICAS lists whose centroids are within this ratio of the nearest one's distance.
REPLICAS, BOUNDARY = 4, 1.04
#: A query searches all lists whose centroids are within this ratio of the nearest one's distance, and in any case the
#: nearest LEAST_LISTS and the nearest SHARE of all lists: a fixed number of them would find less the more there are.
PRUNE, LEAST_LISTS, SHARE = 1.15, 24, 0.25
#: Neighbours of a centroid in the graph; links back to it, those of its SURE nearest apart; centroids that a search keeps in view.
DEGREE, BACK, SURE, NARROW = 24, 24, 2, 48
#: Vectors and queries of one unit of work.
BLOCK, QUERIES = 2_048, 256


@dataclass
class Index:
    """Centroids and the graph between them."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 11) -> Index:
        """Centroids by bisection at the median, so that each has an equal share, then Lloyd rounds that charge for size."""
        rng = np.random.default_rng(seed)
        lists = max(1, min(lists, len(sample)))
        leaves = [np.arange(len(sample))]
        while len(leaves) < lists:
            leaves.sort(key=len)
            of = leaves.pop()
            if len(of) < 2:
                leaves.append(of)
                break
            x = sample[of]
            a, b = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(4):
                near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = x[near].mean(0), x[~near].mean(0)
            order = np.argsort(x @ (a - b), kind="stable")
            leaves += [of[order[: len(of) // 2]], of[order[len(of) // 2 :]]]
        c = np.array([sample[of].mean(0) for of in leaves])
        size = np.array([len(of) for of in leaves], dtype=float)
        step = max(1, _CELLS // len(c))
        for _ in range(6):
            norm, charge, sums = (c**2).sum(1), 0.1 * (size / size.mean() - 1), np.zeros_like(c)
            size = np.zeros(len(c))
            for at in range(0, len(sample), step):
                x = sample[at : at + step]
                d = np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ c.T + norm)
                to = (d + d.mean() * charge).argmin(1)
                size += np.bincount(to, minlength=len(c))
                np.add.at(sums, to, x)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        norm = (c**2).sum(1)
        near = np.concatenate([np.argsort(norm[at : at + step, None] - 2 * c[at : at + step] @ c.T + norm, axis=1, kind="stable")[:, 1 : DEGREE + 1] for at in range(0, len(c), step)])
        links: list[set[int]] = [set(map(int, row)) for row in near]
        room = np.full(len(c), BACK)
        for j in range(near.shape[1]):  # links back, nearest first; a centroid near to many others has room for BACK of them
            for i in range(len(c)):
                if i not in links[t := int(near[i, j])] and (j < SURE or room[t] > 0):
                    links[t].add(i)
                    room[t] -= 1
        for i in range(len(c)):  # a few far links keep the graph in one piece
            links[i] |= set(map(int, rng.integers(0, len(c), 4))) | {(i + 1) % len(c)}
        width = max(map(len, links))
        graph = np.array([sorted(x) + [i] * (width - len(x)) for i, x in enumerate(links)])
        return cls(c, graph, np.unique(rng.integers(0, len(c), 16)))

    def nearest(self, x: np.ndarray, beam: int = NARROW) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids that a beam search over the graph finds, nearest first, and their distances; all rows at once.

        A step looks at the neighbours of each row's best centroid that isn't done and keeps the ``beam`` nearest. A
        row measures a centroid once, and leaves the loop when all that it keeps are done: apart from the map of the
        centroids seen, what it costs doesn't depend on their number.
        """
        n, beam = len(x), min(beam, len(self.centroids))
        start = self.entries[:beam]
        seen = np.zeros((n, len(self.centroids)), dtype=bool)
        seen[:, start] = True
        rows, held = np.arange(n), np.tile(start, (n, 1))
        d = self._measure(x, np.repeat(rows, len(start)), held.ravel()).reshape(held.shape)
        done = np.zeros(held.shape, dtype=bool)
        found, far = np.zeros((n, beam), dtype=held.dtype), np.full((n, beam), np.inf)
        while len(rows):
            open_ = np.where(done, np.inf, d)
            best = open_.argmin(1)
            live = np.isfinite(open_[np.arange(len(rows)), best])
            if not live.all():
                found[rows[~live], : held.shape[1]], far[rows[~live], : held.shape[1]] = held[~live], d[~live]
                rows, held, d, done, best = rows[live], held[live], d[live], done[live], best[live]
            each = np.arange(len(rows))
            done[each, best] = True
            more = self.graph[held[each, best]]
            i, j = np.nonzero(~seen[rows[:, None], more])
            to = more[i, j]
            seen[rows[i], to] = True
            new = np.full(more.shape, np.inf)
            new[i, j] = self._measure(x, rows[i], to)
            held, d, done = np.concatenate((held, more), 1), np.concatenate((d, new), 1), np.concatenate((done, np.isinf(new)), 1)
            if d.shape[1] > beam:
                keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                held, d, done = (np.take_along_axis(z, keep, axis=1) for z in (held, d, done))
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(found, order, axis=1), np.take_along_axis(far, order, axis=1)

    def _measure(self, x: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        diff = x[rows]
        diff -= self.centroids[to]
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids, nearest first, and their distances: cheaper than the graph once a search sees much of it."""
        d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1)))
        order = np.argsort(d, axis=1, kind="stable")
        return order, np.take_along_axis(d, order, axis=1)

    def lists(self, x: np.ndarray, ratio: float, least: int, most: int | None = None) -> list[list[int]]:
        """For each row the lists whose centroids are within ``ratio`` of the nearest one's distance, ``least`` at least; without ``most`` any number."""
        out = []
        for at in range(0, len(x), 512):
            near, d = self.nearest(x[at : at + 512], max(NARROW, most)) if most else self.ranked(x[at : at + 512])
            fits = (d <= ratio * d[:, :1]) & np.isfinite(d)
            fits[:, :least] |= np.isfinite(d[:, :least])
            if most:
                fits[:, most:] = False
            out += [near[i, fits[i]].tolist() for i in range(len(near))]
        return out


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part: not null, not zero, all components finite, and of ``length``, by default the table's usual one.

    Rows that repeat a vec_id with other vectors all take part; whole rows that repeat count once. A row without
    vec_id has no identity that an answer could name, a vector of another length no distance: both are left out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = rows.where("vec_id is not null AND v is not null AND NOT exists(v, x -> x is null OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    if length is None:
        usual = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        length = usual["n"] if usual else 0
    return sound.where(F.size("v") == length).distinct()


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _listed(df: DataFrame, index: Index, ratio: float, least: int, most: int | None = None) -> DataFrame:
    """``df(key, v, least)`` with a row for each list: ``(key, v, least, list)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = index.lists(_matrix(batch.column(1)), ratio, least, most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["key", "v", "least", "lists"])

    return df.select("key", "v", "least").mapInArrow(run, "key long, v array<double>, least long, lists array<int>").select("key", "v", "least", F.explode("lists").alias("list"))


def _blocks(listed: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of a list gathered in blocks of about ``size``: ``(list, keys, least, flat)``; no list is ever one group."""
    sizes = stored(listed.groupBy("list").agg(F.ceil(F.count("*") / size).alias("blocks")), f"{name}-sizes")
    dealt = listed.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))  # at most a row for each list
    return dealt.groupBy("list", "block").agg(F.collect_list(F.struct("key", "v", "least")).alias("x")).select("list", F.col("x.key").alias(f"{name}_keys"), F.col("x.least").alias(f"{name}_least"), F.flatten("x.v").alias(f"{name}_flat"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None) -> DataFrame:
    """Stored ``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row of ``queries(vec_id, embedding)``.

    Candidates are all rows of ``vectors`` but those with the query's own vec_id; score is the Euclidean
    distance in double precision, ties go to the smaller vec_id. Equal vectors are one entry of the index
    with their k + 1 smallest ids, more than which no answer can hold, and equal queries are searched once.
    Unusable vectors (see ``usable``) take no part, nor do queries whose length isn't the candidates'; an empty table has no neighbours. An id that several
    vectors have is a candidate at its nearest one, and as a query it asks with its least one.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    w = W.partitionBy("v").orderBy("vec_id")
    ranked = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    entries = stored(ranked.groupBy("v").agg(F.collect_list("vec_id").alias("ids")).select(F.monotonically_increasing_id().alias("key"), "v", F.array_min("ids").alias("least"), "ids"), "entries")
    # so many of the nearest entries hold k + 1 ids, the query's own among them
    enough = (k + 1) * (rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1)
    usual = rows.select(F.size("v")).first()
    asked = stored(usable(queries, usual[0] if usual else 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    total = entries.count()
    if not total or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = entries.orderBy(F.xxhash64("key", "v"), "key").limit(MOST_FITTED).select(F.col("v").cast("array<float>").alias("v")).toArrow()
    index = Index.fit(_matrix(sample.column("v").combine_chunks()), lists or max(1, min(total // LIST_SIZE, len(sample) // LEAST_SHARE)))
    posted = stored(_listed(entries, index, BOUNDARY, 1, REPLICAS), "posted")
    distinct = asked.groupBy("v").agg(F.min("vec_id").alias("key")).withColumn("least", F.col("key"))
    sought = stored(_listed(distinct, index, PRUNE, max(LEAST_LISTS, ceil(SHARE * len(index.centroids)))), "sought")
    units = _blocks(sought, QUERIES, "q").join(_blocks(posted, BLOCK, "p"), "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                qk, qf, pk, least, pf = (np.array(batch.column(c)[at].values) for c in range(5))
                q0, p0 = qf.reshape(len(qk), -1), pf.reshape(len(pk), -1)
                q, p = q0 - p0.mean(0), p0 - p0.mean(0)  # about the list's centre, where the short form below loses least
                d = (q**2).sum(1)[:, None] - 2 * q @ p.T + (p**2).sum(1)
                m = min(len(pk), enough)
                # everything up to the m-th distance and a rounding margin, measured exactly
                cut = np.partition(d, m - 1, axis=1)[:, m - 1 : m] + 1e-9 * (1 + np.abs(d).max())
                i, j = np.nonzero(d <= cut)
                exact = np.sqrt(((q0[i] - p0[j]) ** 2).sum(1))
                order = np.lexsort((least[j], exact, i))
                i, j, exact = i[order], j[order], exact[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                top = place < m
                yield pa.RecordBatch.from_arrays([pa.array(qk[i[top]]), pa.array(pk[j[top]]), pa.array(least[j[top]]), pa.array(exact[top])], names=["query", "key", "least", "score"])

    found = units.select("q_keys", "q_flat", "p_keys", "p_least", "p_flat").mapInArrow(run, "query long, key long, least long, score double").distinct()
    per_query = W.partitionBy("query").orderBy("score", "least", "key")
    found = stored(found.withColumn("n", F.row_number().over(per_query)).where(F.col("n") <= enough).select("query", "key", "score"), "found")
    pool = found.join(entries.select("key", F.explode("ids").alias("vec_id")), "key").groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    pool = pool.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    named = asked.join(distinct.select("v", F.col("key").alias("query")), "v").select("query", F.col("vec_id").alias("query_id"))
    out = pool.select("query", "vec_id", "score").join(named, "query").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return stored(out.select("query_id", "rank", "vec_id", "score"), "neighbours")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``neighbours`` of all rows whose vec_id is divisible by 100; nulls, ties and repeats as there."""
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 100 = 0"))
