"""Greedy groupings in rounds against the sequential rules, and the threshold join by pivots against all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from loregrid.operators import duplication, priors, vectors


def greedy(pairs: set[tuple]) -> dict:
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    groups: list[list] = []
    for node in sorted(near):
        home = next((g for g in groups if all(m in near[node] for m in g)), None)
        home.append(node) if home is not None else groups.append([node])
    return {n: g[0] for g in groups for n in g}


def graphs():
    rng = random.Random(1)
    sparse = {tuple(sorted(rng.sample(range(150), 2))) for _ in range(200)}
    dense = {(a, b) for a, b in itertools.combinations(range(1000, 1030), 2) if rng.random() < 0.7}
    clique = set(itertools.combinations(range(2000, 2060), 2))
    chain = {(k, k + 1) for k in range(3000, 3040)}
    return sparse | dense | clique | chain | {(2003, 3000)}


@pytest.mark.parametrize("rounds", [0, 3, 10])
def test_dense_groups_equal_the_sequential_rule(spark, rounds):
    pairs = graphs()
    df = spark.createDataFrame(sorted(pairs), "a long, b long")
    got = duplication.dense_groups(df.union(df.limit(5)), duplication.components(df), rounds).collect()
    assert {r.node: r.grp for r in got} == greedy(pairs) and len(got) == len(greedy(pairs))


def test_groups_of_a_wide_component_need_no_last_pass(spark, monkeypatch):
    """A component that spans nearly all nodes, and near-copies with links missing: rounds decide it, no task holds the component (F12)."""
    monkeypatch.setattr(duplication, "_finished", lambda *_: pytest.fail("a component went to one task"))
    rng = random.Random(5)
    wide = {tuple(sorted(rng.sample(range(500), 2))) for _ in range(2_500)}
    near = {(a, b) for a, b in itertools.combinations(range(450, 540), 2) if rng.random() < 0.95}
    pairs = wide | near
    df = spark.createDataFrame(sorted(pairs), "a long, b long")
    got = {r.node: r.grp for r in duplication.dense_groups(df, duplication.components(df)).collect()}
    assert got == greedy(pairs)


def test_semantic_clusters_make_pairs_once_and_of_different_vectors(spark, tmp_path, monkeypatch):
    """COD15: copies are pairs of their group, but aren't compared; no pair is made twice (F12)."""
    from loregrid.plans import registry

    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(3, 8)), 40, axis=0), rng.normal(size=(200, 8)), np.zeros((3, 8))])[rng.permutation(323)].astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0, 2.0]), (902, [1.0, 2.0]), (903, [float("nan")] * 8), (904, [float("nan")] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    made, plain = spark.sparkContext.accumulator(0), vectors.cosine_pairs

    def counted(df, least):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        pairs = plain(df, least)
        return pairs.mapInArrow(run, pairs.schema)

    monkeypatch.setattr(vectors, "cosine_pairs", counted)
    got = {r.grp: (r.weakest, r.pairs) for r in registry.QUERIES["COD15"](spark, str(tmp_path)).collect()}
    x = x.astype(float)
    pairs = brute(x, 0.45)
    home = greedy(pairs)
    want: dict = {}
    for a, b in pairs:
        if home[a] == home[b]:
            want.setdefault(home[a], []).append(float(x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b])))
    assert {g: n for g, (_, n) in got.items()} == {g: len(s) for g, s in want.items()}
    assert all(abs(w - min(want[g])) < 2e-6 for g, (w, _) in got.items())
    _, firsts = np.unique(x, axis=0, return_index=True)
    assert made.value == sum(a in firsts and b in firsts for a, b in pairs)


def sequential_clusters(rows, least):
    """(key, id, cluster) by one pass over each key in order of creation."""
    out, seeds = [], {}
    for _, i, key, v in sorted((r[2], r[1], r[0], r[3]) for r in rows):
        x = np.array(v or [], dtype=float)
        n = np.linalg.norm(x)
        best = max(((float(x @ s / (n * np.linalg.norm(s))), -k) for k, s in seeds.get(key, [])), default=None) if n else None
        if best and best[0] >= least:
            out.append((key, i, -best[1]))
        else:
            if n:
                seeds.setdefault(key, []).append((i, x))
            out.append((key, i, i))
    return sorted(out)


def test_leader_clusters_equal_one_pass(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    rows = [(f"k{rng.integers(3)}", i, int(rng.integers(400)), [float(x) for x in centres[rng.integers(30)] + rng.normal(scale=0.45, size=8)]) for i in range(900)]
    rows += [("k0", 2_000 + i, 5, rows[i][3]) for i in range(40)] + [("k1", 3_000, 7, None), ("k1", 3_001, 7, [0.0] * 8), ("k1", 3_002, 7, [0.0] * 8)]
    got = priors.cluster_candidates(spark.createDataFrame(rows, "key string, id long, created_at long, v array<double>"), 0.7)
    assert sorted(map(tuple, got.collect())) == sequential_clusters(rows, 0.7)


def test_leaders_of_a_hot_key_of_copies(spark):
    """One key of 30,000 candidates, few different vectors: copies make no pairs."""
    base = [[1.0, 0.0], [0.9, 0.5], [0.0, 1.0], [-1.0, 0.1]]
    rows = [("hot", i, i, base[(i * 7 + i // 3) % 4]) for i in range(30_000)]
    got = priors.cluster_candidates(spark.createDataFrame(rows, "key string, id long, created_at long, v array<double>"), 0.7)
    assert sorted(map(tuple, got.collect())) == sequential_clusters(rows, 0.7)


def brute(x, least):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    return {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= least, 1)), strict=True)}


@pytest.mark.parametrize(("kind", "least"), [("clusters", 0.9), ("clusters", 0.6), ("uniform", 0.5), ("copies", 0.99)])
def test_pairs_by_pivots_equal_all_pairs(spark, kind, least):
    rng = np.random.default_rng(4)
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(60, 24)), 40, axis=0) + rng.normal(scale=0.15, size=(2_400, 24))
    elif kind == "uniform":
        x = rng.normal(size=(1_200, 12))
    else:
        x = np.concatenate([np.repeat(rng.normal(size=(1, 6)), 300, axis=0), rng.normal(size=(700, 6)), np.zeros((3, 6))])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(9_000, None), (9_001, [1.0, 2.0])], "id long, v array<double>")
    got = [(r.a, r.b) for r in vectors.cosine_pairs(df, least, block=128).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(x, least)
    if (kind, least) == ("clusters", 0.9):
        assert vectors.compared(df, least, 128) < len(x) ** 2 / 2 / 20


def test_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 5))
    df = spark.createDataFrame([(f"v{i}", [float(c) for c in v]) for i, v in enumerate(x)] + [("null", None), ("short", [1.0])], "id string, v array<double>").repartition(5)
    q = spark.createDataFrame([(k, [float(c) for c in x[k] + 0.1]) for k in range(9)], "query int, q array<double>")
    d = np.linalg.norm(x[None] - (x[:9] + 0.1)[:, None], axis=2)
    got = {(r.query, r["rank"]): r.id for r in vectors.knn(df, q, 6).collect()}
    assert got == {(k, n + 1): f"v{i}" for k in range(9) for n, i in enumerate(np.argsort(d[k])[:6])}
    assert vectors.knn(df, q.limit(0), 6).count() == 0


def test_postings_of_fingerprints_are_not_broadcast(spark):
    """A table of fingerprints that is small by its files was broadcast with its 28 keys a row, through the driver (F2, F3, F4)."""
    from loregrid.storage import commits

    fps = commits.kept(spark.range(4_000).selectExpr("id", "xxhash64(id div 2) AS fp"), "fps")
    pairs = duplication.hamming_join(fps, 6)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.where("distance = 0").count() == 2_000


def test_structural_groups_equal_the_sequential_rule(spark):
    """COD16 reported components; groups are of admissible pairs only, in the order of contents (F8)."""
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(260):
        fp = rng.choice(base) ^ sum({1 << rng.randrange(64) for _ in range(rng.choice([0, 0, 2, 3, 5]))})
        rows.append((i, fp - (1 << 64) if fp >= 1 << 63 else fp, rng.choice([None, None, "A", "B", "C"])))
    called = {tuple(sorted(rng.sample(range(260), 2))) for _ in range(2_000)}
    far = lambda a, b: ((rows[a][1] ^ rows[b][1]) & (2**64 - 1)).bit_count()
    fits = lambda a, b: far(a, b) <= 6 and (min(a, b), max(a, b)) not in called and (rows[a][2] is None or rows[a][2] != rows[b][2])
    groups: list[list] = []
    for n in sorted(range(260), key=lambda n: (rows[n][1] & (2**64 - 1), n)):
        home = next((g for g in groups if all(fits(m, n) for m in g)), None)
        home.append(n) if home is not None else groups.append([n])
    want = {n: (g[0], max(far(a, b) for a, b in itertools.combinations(g, 2))) for g in groups if len(g) > 1 for n in g}
    df, calls = spark.createDataFrame(rows, "id long, fp long, owner string"), spark.createDataFrame(sorted(called), "a long, b long")
    got = duplication.structural_groups(df, calls, 6).collect()
    assert {r.id: (r.grp, r.hamming) for r in got} == want and len(got) == len(want)


def test_verdicts_accept_subsets_and_tell_growth(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (3, 5), (3, 6)], "cluster long, id long")
    accepted = spark.createDataFrame([(10, 1), (10, 2), (10, 9), (11, 3), (12, 5), (12, 8)], "entry long, id long")
    assert {r.cluster: r.verdict for r in duplication.verdicts(members, accepted).collect()} == {1: "accepted", 2: "changed", 3: "report"}
