"""Stored tables: snapshots under replay, failure and rivals; the lexical index against BM25 over all postings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loregrid.operators import lexical
from loregrid.storage import commits, postings
from loregrid.storage.postings import LexicalIndex
from loregrid.storage.snapshots import Snapshots

SCHEMA = "id string, revision long, title string"


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/docs", SCHEMA, ["id"], "revision", buckets=8)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, x) for x in r])


def test_two_batches_and_a_replay(spark, store, tmp_path):
    one = spark.createDataFrame([(f"d{k}", 1, f"one {k}", False) for k in range(40)], SCHEMA + ", gone boolean")
    two = spark.createDataFrame([("d1", 2, "two", False), ("d2", 2, None, True), ("d3", 0, "late", False), ("new", 1, "n", False), ("d1", 3, "three", False)], SCHEMA + ", gone boolean")
    assert store.merge(one, batch=1, deleted="gone") == 1
    before = commits.latest(spark, store.root)[1]["buckets"]
    assert store.merge(two, batch=2, deleted="gone") == 2
    after = commits.latest(spark, store.root)[1]["buckets"]
    want = sorted([(f"d{k}", 1, f"one {k}") for k in range(40) if k not in (1, 2)] + [("d1", 3, "three"), ("new", 1, "n")])
    assert rows(store.read()) == want
    assert 0 < sum(after[b] != before[b] for b in before) <= 3 < len(before)  # only the touched buckets are new
    assert store.merge(two, batch=2, deleted="gone") == 2 and store.merge(one, batch=1, deleted="gone") == 2
    assert store.merge(two, deleted="gone") == 2  # the same rows again, without a batch's number: nothing wins
    assert rows(store.read()) == want and rows(store.read(1)) == rows(one.select("id", "revision", "title"))
    # a deleted row isn't revived by an older change, and is by a newer one
    store.merge(spark.createDataFrame([("d2", 1, "old"), ("d4", 1, "same order")], SCHEMA))
    assert rows(store.read()) == want
    store.merge(spark.createDataFrame([("d2", 9, "back")], SCHEMA))
    assert ("d2", 9, "back") in rows(store.read())
    assert sorted(map(tuple, store.changes(1).collect())) == [("d1", "updated"), ("d2", "updated"), ("new", "created")]
    assert sorted(map(tuple, store.changes(1, 2).collect())) == [("d1", "updated"), ("d2", "removed"), ("new", "created")]
    held = rows(store.read())
    assert store.vacuum() > 0 and rows(store.read()) == held


def test_a_bucket_is_written_by_a_task_for_each_span_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "SPAN", 2, raising=False)
    docs = spark.createDataFrame([(k, f"common word{k % 3}") for k in range(64)], "id long, body string")
    LexicalIndex(spark, f"file://{tmp_path}/spans", ["body"], buckets=2).add(docs, "one")
    files = spark.read.parquet(f"file://{tmp_path}/spans/segments").where("term = 'common'").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n").alias("n"), F.count_distinct(F.floor(F.col("block") / 2)).alias("spans")).collect()
    assert sum(f.n for f in files) == 64 and len(files) == 8 and {f.spans for f in files} == {1}


def test_failed_batch_is_invisible_and_can_come_again(spark, store, monkeypatch):
    store.merge(spark.createDataFrame([("a", 1, "x")], SCHEMA), batch=1)
    change = spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], SCHEMA)

    def dies(*_):
        raise OSError("the driver dies before its commit")

    with monkeypatch.context() as m:
        m.setattr(commits, "publish", dies)
        with pytest.raises(OSError):
            store.merge(change, batch=2)
    assert rows(store.read()) == [("a", 1, "x")] and store.version() == 1
    assert store.merge(change, batch=2) == 2 and rows(store.read()) == [("a", 2, "y"), ("b", 1, "z")]
    assert store.vacuum() >= 2 and rows(store.read()) == [("a", 2, "y"), ("b", 1, "z")]


def test_rival_writers_lose_nothing(spark, store, monkeypatch):
    """A version that another writer publishes meanwhile is read and merged with."""
    store.merge(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    publish, once = commits.publish, []

    def late(spark_, root, version, content):
        if not once:
            once.append(1)
            monkeypatch.setattr(commits, "publish", publish)
            store.merge(spark.createDataFrame([("rival", 1, "r")], SCHEMA))
        return publish(spark_, root, version, content)

    monkeypatch.setattr(commits, "publish", late)
    assert store.merge(spark.createDataFrame([("a", 2, "mine")], SCHEMA)) == 3
    assert rows(store.read()) == [("a", 2, "mine"), ("rival", 1, "r")]
    with pytest.raises(commits.Conflict):
        commits.publish(spark, store.root, 2, {})


def test_null_keys_repeats_and_an_empty_batch(spark, store):
    assert store.merge(spark.createDataFrame([], SCHEMA)) == 0 and store.read().count() == 0
    store.merge(spark.createDataFrame([(None, 1, "null key"), (None, 2, "newer"), ("a", 1, "one"), ("a", 1, "one")], SCHEMA))
    assert rows(store.read()) == [("a", 1, "one"), (None, 2, "newer")]
    store.merge(spark.createDataFrame([(None, 3, "newest")], SCHEMA))
    assert (None, 3, "newest") in rows(store.read()) and store.read().count() == 2


def _texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]
    return [(i, " ".join(rng.choices(words[: rng.choice([20, 400])], k=rng.randrange(0, 4))), " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(400)], k=rng.choice([0, 5, 40, 300])))) for i in range(n)]


@pytest.mark.parametrize(("require_all", "at_once"), [(False, 0), (True, 0), (False, 10**9), (True, 10**9)])
def test_index_gives_the_best_of_all_postings(spark, tmp_path, monkeypatch, require_all, at_once):
    monkeypatch.setattr(postings, "AT_ONCE", at_once)
    docs = spark.createDataFrame([*_texts(3, 900), (5_000, None, None), (5_001, "word1 word1", "")], "id long, title string, body string")
    index = LexicalIndex(spark, f"file://{tmp_path}/index{require_all}", ["title", "body"], buckets=8)
    assert index.add(docs.where("id < 600"), "first") == 1 and index.add(docs.where("id >= 600"), "second") == 2
    assert index.add(docs.where("id >= 600"), "second") == 2 and index.batches() == ["first", "second"]
    rng = random.Random(4)
    asked = [(q, rng.sample([f"word{k}" for k in range(400)], n)) for q, n in enumerate([1, 2, 3, 8, 30, 60])] + [(6, ["nowhere"]), (7, ["word0", "word1"]), (8, ["word0", "nowhere"]), (9, [])]
    queries = spark.createDataFrame(asked, "query int, terms array<string>")
    want = lexical.bm25(docs, queries, {"title": (F.col("title"), 10.0), "body": (F.col("body"), 1.0)}, require_all).collect()
    best: dict = {}
    for r in want:
        best.setdefault(r.query, []).append((-round(r.score, 6), r.id))
    got: dict = {}
    for r in index.search(queries, 7, {"title": 10.0, "body": 1.0}, require_all).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((-r.score, r.id))
    assert got.keys() == best.keys()
    for q in got:
        assert [i for _, i in got[q]] == [i for _, i in sorted(best[q])[:7]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in sorted(best[q])[:7]], abs=2e-6)


def test_index_reads_only_its_terms_buckets_and_the_blocks_that_can_win(spark, tmp_path):
    docs = spark.createDataFrame([(i, "", "common filler " + ("rare " * 5 if i in (7, 1_800) else f"own{i}")) for i in range(3_000)], "id long, title string, body string")
    index = LexicalIndex(spark, f"file://{tmp_path}/index", ["title", "body"], buckets=16)
    index.add(docs, "all")
    wanted = spark.createDataFrame([("rare",)], "term string")
    blocks = index._blocks(wanted, 1)
    assert {f.split("bucket=")[1].split("/")[0] for f in [r[0] for r in blocks.select(F.input_file_name()).distinct().collect()]} <= {str(b) for b in range(16)}
    assert len({r[0] for r in blocks.select(F.input_file_name()).collect()}) == 1
    assert blocks.select(F.sum("n")).first()[0] == 2
    got = index.search(spark.createDataFrame([(0, ["rare", "common"])], "query int, terms array<string>"), 2, {"title": 1.0, "body": 1.0}).orderBy("rank").collect()
    assert [r.id for r in got] == [7, 1_800]
