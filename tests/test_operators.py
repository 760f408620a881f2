"""Operators on small literal tables, with the edge cases that a naive form gets wrong."""

from __future__ import annotations

import hashlib
import hmac
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F


def test_offset_percentile_index(spark):
    from loregrid.operators.relational import offset_percentiles

    df = spark.createDataFrame([(i,) for i in range(20)], "x int")
    assert tuple(offset_percentiles(df, "x", (50, 95, 100)).first()) == (10, 19, 19)


def test_cochange_guard_counts_before_repeats_go(spark):
    from loregrid.operators.relational import cochange

    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a")]
    df = spark.createDataFrame(rows, "commit_id int, path string")
    assert [tuple(r) for r in cochange(df, most_files=2).collect()] == [("a", "b", 1)]
    assert [tuple(r) for r in cochange(df).collect()] == [("a", "b", 2)]


def test_asof_join_takes_latest_at_or_before(spark):
    from loregrid.operators.relational import asof_join

    left = spark.createDataFrame([("k", 5), ("k", 10), ("z", 1)], "key string, t int")
    right = spark.createDataFrame([("k", 5, "a"), ("k", 9, "b"), ("k", 11, "c")], "key string, at int, v string")
    assert {(r.key, r.t): r.v for r in asof_join(left, right, "key", "t", "at", "v").collect()} == {("k", 5): "a", ("k", 10): "b", ("z", 1): None}


def test_hamming_join_is_exact(spark):
    from loregrid.operators.duplication import hamming_join

    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(8)]
    fps = {i: base[i % 8] ^ sum(1 << b for b in set(rnd.choices(range(63), k=rnd.randrange(9)))) for i in range(120)}
    got = {(r.a, r.b): r.distance for r in hamming_join(spark.createDataFrame(list(fps.items()), "id long, fp long"), 5).collect()}
    assert got == {(a, b): d for a, b in itertools.combinations(fps, 2) if (d := (fps[a] ^ fps[b]).bit_count()) <= 5}


def test_components_and_dense_groups(spark):
    from loregrid.operators.duplication import components, dense_groups

    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 7), (5, 7), (9, 8)], "a long, b long")
    comps = components(pairs)
    assert {r.node: r.root for r in comps.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 9: 8, 8: 8}
    groups = {r.node: r.grp for r in dense_groups(pairs, comps).collect()}
    assert groups[1] == groups[2] == 1 and groups[3] == 3 and groups[5] == groups[6] == groups[7] == 5


def test_cosine_pairs_blocks_equal_brute_force(spark):
    import numpy as np

    from loregrid.operators.vectors import cosine_pairs

    x = np.random.default_rng(1).normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if u[i] @ u[j] >= 0.8}
    assert {(r.a, r.b) for r in cosine_pairs(df, 0.8, block=16).collect()} == want


def test_hmac_and_glob(spark):
    from loregrid.functions.hashing import hmac_sha256
    from loregrid.plans.filters import glob_regex
    import re

    got = spark.range(1).select(hmac_sha256(b"key", F.lit("abc").cast("binary"))).first()[0]
    assert got == hmac.new(b"key", b"abc", hashlib.sha256).hexdigest()
    assert re.match(glob_regex("**/*.rs"), "src/a/b.rs") and re.match(glob_regex("**/*.rs"), "b.rs") and not re.match(glob_regex("*.rs"), "a/b.rs")
    assert re.match(glob_regex("{a,b}/x?"), "b/x1") and not re.match(glob_regex("{a,b}/x?"), "c/x1")


def test_shell_patterns():
    from loregrid.functions.commands import find_pattern

    assert find_pattern("cat x | grep -n 'foo bar' | head") == "foo bar"
    assert find_pattern("bash -c \"rg -e pat src\"") == "pat"
    assert find_pattern("ls -la") is None and find_pattern("grep 'open") is None and find_pattern(None) is None


def test_porter():
    from loregrid.functions.porter import stem_word

    assert [stem_word(w) for w in ("caresses", "ponies", "relational", "hopping", "running", "happy")] == ["caress", "poni", "relat", "hop", "run", "happi"]


def test_frontmatter():
    from loregrid.functions.frontmatter import parse

    assert parse("---\ntitle: \"a\"\ntags: [x, y]\nrefs:\n  - p\n  - q\n---\nbody") == '{"refs": ["p", "q"], "tags": ["x", "y"], "title": "a"}'
    assert parse("no header") is None and "_error" in parse("---\n- a\n---\n")


def test_stream_equals_batch(spark, tmp_path):
    from loregrid.streaming.streams import events_stream, run_once, running_counts

    rows = [(i % 3, "t" + str(i % 2), i) for i in range(30)]
    df = spark.createDataFrame(rows, "session_id int, tool string, tokens long")
    for part in range(3):
        df.where(F.col("tokens") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = running_counts(events_stream(spark, str(tmp_path / "in"), df.schema, 1))
    assert {tuple(r) for r in run_once(stream, "counts").collect()} == {tuple(r) for r in running_counts(df).collect()}


def test_majority_bits_equal_brute_force(spark):
    from loregrid.operators.duplication import fingerprinted, majority_bits

    rnd = random.Random(8)
    rows = [(n, [rnd.getrandbits(64) - (1 << 63) for _ in range(n)]) for n in (0, 1, 2, 3, 40, 70_000)]
    got = {r.n: r.fp & (2**64 - 1) for r in spark.createDataFrame(rows, "n int, h array<long>").select("n", majority_bits(F.col("h")).alias("fp")).collect()}
    assert got == {n: sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > n) for n, hs in rows}
    same = fingerprinted(spark.createDataFrame([("a b c d",), ("a  b c d",), ("",), (None,)], "t string"), "t", lambda c: F.array_remove(F.split(F.coalesce(c, F.lit("")), " "), "")).collect()
    assert same[0].fp == same[1].fp != 0 and same[2].fp == same[3].fp == 0


def test_offset_percentiles_of_skewed_values(spark):
    from loregrid.operators.relational import offset_percentiles

    rng = random.Random(3)
    values = [7.0] * 500 + [rng.paretovariate(0.6) for _ in range(900)] + [-rng.random() for _ in range(77)]
    rng.shuffle(values)
    ps = (0, 1, 37, 50, 75, 99, 100)
    got = offset_percentiles(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x", ps).first()
    values.sort()
    assert tuple(got) == tuple(values[min(len(values) * p // 100, len(values) - 1)] for p in ps)
    assert tuple(offset_percentiles(spark.createDataFrame([(None,)], "x long"), "x", (50,)).first()) == (None,)


def test_owner_is_the_most_specific_root(spark):
    from loregrid.sources.logs import owned

    paths = ["/a/b/c.md", "/a/b", "/a/bc/d", "a/b/c", "x", "/", "a/", "/a/b/c.md", None]
    roots = [("top", ""), ("a", "/a"), ("ab", "/a/b"), ("rel", "a"), ("deep", "/a/b/c.md")]
    got = owned(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(roots, "collection string, root string"))
    best = {p: max(((len(r), r, c) for c, r in roots if p.startswith(r + "/")), default=None) for p in paths if p is not None}
    assert {r.path: r.collection for r in got.collect()} == {p: b[2] for p, b in best.items() if b}


def test_bm25_beyond_the_broadcast_bound(spark, monkeypatch):
    from loregrid.operators import lexical

    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, None), (4, "")], "id long, body string")
    asked = spark.createDataFrame([(0, ["beta", "alpha"]), (1, ["gamma"]), (2, [])], "query long, terms array<string>")
    run = lambda: sorted(map(tuple, lexical.bm25(docs, asked, {"body": (F.col("body"), 1.0)}).collect()))
    near = run()
    monkeypatch.setattr(lexical, "MOST_ROWS", 0)
    assert [r[:2] for r in near] == [(0, 1), (0, 2), (1, 2)] and run() == near


def test_strong_evidence_is_told_for_every_pair(spark):
    """Weak pairs are rows too: the result was cut to the strong ones."""
    from loregrid.plans import registry

    d = "/root/testdata/sf0.001"
    got = registry.QUERIES["STR08"](spark, d)
    assert got.count() == spark.read.parquet(f"{d}/benchmark.parquet").count() * spark.read.parquet(f"{d}/documents.parquet").count()
    assert got.select("strong").distinct().count() == 2


def test_entries_are_split_once_for_lexical_recall(spark):
    """The words of a text are one array that later expressions read; they were split again for each phrase."""
    from loregrid.plans import registry

    plan = registry.QUERIES["RET08"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    tree = [x for x in plan.split("\n") if "split(lower(coalesce(" in x]
    assert tree and all("arrays_overlap" not in x for x in tree)


def test_triggers_are_matched_by_title_before_entries(spark):
    """Nothing gathers pairs of entry and session to make them distinct."""
    from loregrid.plans import registry

    plan = registry.QUERIES["JOI19"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if re.search(r"Aggregate \[(id#\d+, session_id#|session_id#\d+, id#|id#\d+, session_id#\d+, cluster_id#)", x)]


def test_chunkers_hold_few_texts_at_once(spark):
    """A Python worker held an Arrow batch of ten thousand texts with all their chunks."""
    from loregrid.operators import retrieval

    for cut in (retrieval.fixed_chunks(3, 1), retrieval.markdown_chunks(3)):
        df = spark.createDataFrame([(1, "a b\nc d\ne"), (2, None)], "id long, t string").select("id", F.explode(cut(F.col("t"))).alias("c"))
        assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.id for r in df.collect()} == {1}


def test_hamming_join_compares_few_and_expands_copies(spark):
    from loregrid.operators.duplication import hamming_join

    rnd = random.Random(5)
    fps = {i: rnd.getrandbits(64) - (1 << 63) for i in range(2_000)} | {2_000 + i: 7 for i in range(30)} | {3_000: 7 ^ 0b111000111}
    df = spark.createDataFrame(list(fps.items()), "id long, fp long")
    pairs = hamming_join(df, 6)
    copies = list(range(2_000, 2_030))
    assert {(r.a, r.b): r.distance for r in pairs.collect()} == {**dict.fromkeys(itertools.combinations(copies, 2), 0), **{(i, 3_000): 6 for i in copies}}


def test_hamming_join_meets_by_two_bands(spark):
    import loregrid.operators.duplication as D

    rnd = random.Random(5)
    df = spark.createDataFrame([(i, rnd.getrandbits(64) - (1 << 63)) for i in range(3_000)], "id long, fp long")
    # with every distance passed what is left are the candidates
    plain, D.F.bit_count = D.F.bit_count, lambda x: D.F.lit(0)
    try:
        met = D.hamming_join(df, 6).count()
    finally:
        D.F.bit_count = plain
    assert met < 3_000**2 / 2 * 28 / 65_536 * 1.5  # by one of seven bands it would be thirty times as many


def test_cochange_counts_rows_before_repeats_go(spark):
    from loregrid.operators.relational import cochange

    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (4, "a"), (4, "a"), (5, None), (5, "a"), (5, "b"), (None, "a"), (None, "b"), (6, "a"), (6, "b"), (6, "c"), (6, "d")]
    got = {(r.file_a, r.file_b): r.n for r in cochange(spark.createDataFrame(rows, "commit_id long, path string"), most_files=3).collect()}
    assert got == {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 1}


def test_cochange_deals_rows_to_tasks_by_number(spark, monkeypatch):
    from loregrid.operators import relational as R

    monkeypatch.setattr(R, "TASK_ROWS", 50, raising=False)
    rows = spark.range(2_000).selectExpr("id div 4 AS commit_id", "concat('f', id % 37) AS path")
    plan = R.cochange(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(commit_id" in plan and ", 40)" in plan and "Join" not in plan


def test_blocks_of_one_band_meet_in_many_tasks(spark):
    import numpy as np

    from loregrid.operators import vectors as V

    x = np.random.default_rng(3).normal(size=(1_200, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    keys = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        met = V._cells(df, 0.2, 4, None).groupBy(V.F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in met) > 10_000 and max(r["count"] for r in met) < sum(r["count"] for r in met) / 5


def test_many_to_many_equals_the_plain_join(spark, monkeypatch):
    from loregrid.operators import relational as R

    monkeypatch.setattr(R, "RUN", 3)
    monkeypatch.setattr(R, "TILE_RUNS", 2)
    monkeypatch.setattr(R, "TILE_ROWS", 4)
    rng = random.Random(3)
    keys = ["a"] * 30 + ["b", "c", None]
    left = spark.createDataFrame([(k % 50, rng.choice(keys)) for k in range(60)], "x long, k string")  # with repeats
    right = spark.createDataFrame([(rng.choice([*keys, "d"]), k % 40 if k % 7 else None, f"r{k % 40}") for k in range(50)], "k string, y long, z string")
    cols = ["k", "x", "y", "z"]
    for l, r in ((left, right), (left.where("k = 'e'"), right), (left, right.where("false"))):
        got, want = (sorted(map(tuple, df.select(*cols).collect()), key=str) for df in (R.many_to_many(l, r, "k"), l.join(r, "k")))
        assert got == want
    assert R.many_to_many(left, right, "k").count() > 500


@pytest.mark.parametrize("name", ["JOI07", "JOI20"])
def test_pairs_of_many_to_many_joins_are_written_in_little_space(spark, tmp_path, name):
    """Rows in the order of a table take several bytes each, and a hot key or a file was one task."""
    from loregrid.plans import registry

    part = spark.range(30_000).select(F.col("id").alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")], F.lit(1).alias("p_size"))
    part = part.withColumn("p_partkey", F.col("p_partkey") * (1_555 if name == "JOI07" else 6))  # many of one name
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    k = F.col("id")
    lines = spark.range(400).select((k * 7_919).alias("l_orderkey"), (k * 1_555).alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.lit(0).alias("l_linenumber"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    events = spark.range(400).select((k * 23).alias("event_id"), F.lit("view").alias("event_type"), F.lit(1).cast("long").alias("user_id"), F.lit(1.0).alias("value"), F.lit("1").alias("props"), F.timestamp_seconds(k).alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    registry.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    rows, size = got.count(), sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert rows == got.distinct().count() == (400 * 22_500 if name == "JOI07" else 400 * 6_000)
    assert size < rows * 0.4 and got.select(F.input_file_name()).distinct().count() > 1


def test_cochange_without_a_bound_leaves_no_commit_out(spark, monkeypatch, tmp_path):
    """JOI13 left commits of more than eight rows out; large ones make their pairs from blocks of files (F9)."""
    from loregrid.operators import relational as R
    from loregrid.plans import registry

    monkeypatch.setattr(R, "LISTED", 4)
    lines = [(1, k) for k in range(23)] + [(2, k) for k in range(0, 23, 2)] + [(3, 1), (3, 2), (4, 1), (4, 2), (4, 2), (5, 7), (None, 1), (None, 2), (6, None), *[(6, k) for k in range(30)]]
    df = spark.createDataFrame(lines, "l_orderkey long, l_partkey long")
    df.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    commits: dict = {}
    for c, k in lines:
        if c is not None and k is not None:
            commits.setdefault(c, set()).add(f"src/f{k}.rs")
    want = Counter(p for files in commits.values() for p in itertools.combinations(sorted(files), 2))
    rows = registry.QUERIES["JOI13"](spark, str(tmp_path)).collect()
    assert {(r.file_a, r.file_b): r.n for r in rows} == {p: n for p, n in want.items() if n >= 2} and len(rows) == sum(n >= 2 for n in want.values())


def test_identifiers_of_an_item_are_strong_evidence(spark, tmp_path, monkeypatch):
    """STR08 left out the first arm, an identifier of the query that stands anywhere in the text (F10)."""
    from loregrid.functions import multi, text as X
    from loregrid.plans import registry

    monkeypatch.setattr(multi, "PATTERNS", 2)
    items = ["why does Store::write fail", "what is min_recall and utf8", "one two three four", "utf8", "camelCase a.b", None]
    texts = ["x store::writer y", "the MIN_RECALL_cosine", "one two three", "nothing here", "UTF8x CAMELCASES a.b", "aab a.bc", "", None]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["STR08"](spark, str(tmp_path)).select("item_id", "doc_id", "strong").collect()))
    both = b.withColumnRenamed("text", "q").crossJoin(d.withColumnRenamed("text", "e"))
    want = both.select("item_id", "doc_id", F.coalesce(X.strong_lexical(F.col("q"), F.col("e")), F.lit(False)))
    assert got == sorted(map(tuple, want.collect())) and {(0, 0), (1, 1), (1, 4), (3, 4), (4, 5), (2, 2)} <= {g[:2] for g in got if g[2]}


def test_triggers_are_written_in_little_space(spark, tmp_path):
    """JOI19's pairs came in the order of the sessions' table, and a title's pairs were one task (F6)."""
    from loregrid.plans import registry

    k = F.col("id")
    docs = spark.range(3_000).select((k * 2_100 + 3).alias("doc_id"), *[F.lit("x").alias(c) for c in ("text", "lang", "source")], F.lit(1).cast("long").alias("n_chars"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")  # reminders, all titled "Note 3"
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    events = spark.range(1_200).select(k.alias("event_id"), F.when(k % 3 == 0, "click").otherwise("signup").alias("event_type"), (k * 7 % 900).alias("user_id"), F.lit(3.5).alias("value"), F.lit("1").alias("props"), F.timestamp_seconds(k).alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    registry.QUERIES["JOI19"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    e = events.collect()
    said, clicks = {r.user_id for r in e if r.event_type == "signup"}, {(r.user_id, r.event_id % 200) for r in e if r.event_type == "click"}
    rows, size = got.count(), sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert rows == got.distinct().count() == sum((s, d) not in clicks for s in said for d in range(3, 6_300_000, 2_100))
    assert size < rows * 0.4 and got.select(F.input_file_name()).distinct().count() > 1, (size, rows)
