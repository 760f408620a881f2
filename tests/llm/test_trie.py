"""The prefix trie against one built of nested dictionaries, over many sorted partitions and over odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loregrid.llm import trie


def plain(conversations: list[tuple], shared: bool = True) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            role, text = role or "", text or ""
            fp = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, fp, role, text))
    own = {c: [(r, x) for *_, r, x in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if shared else 0
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, out = defaultdict(list), []
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if whole[c] == node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed: int, n: int, deep: int) -> list[tuple]:
    """Conversations that branch everywhere: few different turns, some conversations equal, ids with gaps."""
    rng = random.Random(seed)
    rows, ids = [], rng.sample(range(3 * n), n)
    for c in ids:
        for t in range(rng.randint(1, deep)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ü", "long text", None])))
    return rows


def found(df) -> list[tuple]:
    return sorted([(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize(("seed", "n", "deep", "parts"), [(1, 120, 4, 9), (2, 60, 30, 13), (3, 40, 3, None)])
def test_same_nodes(spark, seed, n, deep, parts):
    rows = made(seed, n, deep)
    seqs = trie.sequences(spark.createDataFrame(rows, SCHEMA))
    assert found(trie.prefix_trie(trie.shared_starts(seqs), parts)) == plain(rows)


def test_long_shared_prefix_over_many_partitions(spark):
    """One start that all share, a chain of prefixes of each other, one group of equal conversations."""
    start = [(t, "user", f"s{t}") for t in range(25)]
    rows = [(c, *x) for c in range(30) for x in start] + [(c, 100, "user", f"own {c % 11}") for c in range(20)]
    rows += [(c, t, "user", f"s{t}") for c in range(40, 60) for t in range(c - 39)] + [(c, t, "user", "same") for c in range(100, 140) for t in range(3)]
    seqs = trie.sequences(spark.createDataFrame(rows, SCHEMA))
    for parts in (1, 11):
        assert found(trie.prefix_trie(seqs, parts)) == plain(rows, shared=False)


def test_only_points_are_made(spark):
    rows = made(5, 50, 40)
    seqs = trie.sequences(spark.createDataFrame(rows, SCHEMA)).withColumn("key", trie._prefix("fps", trie.F.size("fps")))
    once = seqs.groupBy("key").agg(*[trie.F.first(c).alias(c) for c in ("fps", "bytes")], trie.F.min("conv_id").alias("conv_id"), trie.F.count("*").alias("n"))
    tree = trie.points(once, 7).collect()
    kids = defaultdict(int)
    for r in tree:
        kids[r.up] += 1
    assert all(kids[r.key] != 1 or r.n for r in tree if r.up) and len(tree) <= 2 * once.count() + 1
    assert len({r.key for r in tree}) == len(tree)


def test_odd_rows(spark):
    rows = [
        (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, None, "b"), (5, None, "user", None), (6, 3, None, None), (6, 3, "", ""), (None, 1, "user", "lost"),
        (7, 1, "x" * 40_000, "y" * 90_000), (8, 1, "ab", "c"), (9, 1, "a", "bc"), (4096, 0, "user", "a"), (8192, 0, "user", "a"), (2, 0, "user", "only"), (3, 0, "user", "only"), (-4, 1, "user", "below zero"),
    ]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "'x' AS n")
    assert found(trie.prefix_trie(trie.shared_starts(trie.sequences(df)), 5)) == plain(rows)


def test_empty_table(spark):
    seqs = trie.sequences(spark.createDataFrame([], SCHEMA))
    assert trie.prefix_trie(trie.shared_starts(seqs)).count() == 0


def test_hashes_of_many_ends(spark):
    ids = [7 * k for k in range(9_000)]
    got = trie.end_hashes(spark.createDataFrame([("k", c) for c in ids] + [("other", 3)], "key string, conv_id long"))
    assert {r.key: r.ends_sha256 for r in got.collect()} == {"k": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "other": hashlib.sha256(b"3").hexdigest()}
