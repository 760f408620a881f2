"""SimHash near-duplicates against an independent version."""

from __future__ import annotations

import itertools
import random

import pytest
import xxhash

from loregrid.llm import simhash


def plain_fingerprint(text: str | None) -> int:
    """From the contract: lower-case A-Z, words between blanks, 4-word shingles with repeats, a bit set in over half of the hashes."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\f\r":
        low = low.replace(blank, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near) -> dict:
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if near(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_report_equals_brute_force(spark):
    rnd = random.Random(6)
    words = ["Alpha", "beta", "ÜBER", "naïve", "x", "1.", "gamma delta", " ", "omega"]
    rows: list[tuple] = [(k, rnd.choice([" ", "\n", "\t "]).join(rnd.choices(words, k=rnd.choice([0, 1, 3, 4, 5, 40, 300])))) for k in range(120)]
    rows += [(1000 + k, rows[k][1].swapcase() if k % 2 else rows[k][1] + " tail") for k in range(60)] + [(2000, None), (2001, ""), (2001, ""), (None, "  "), (None, "one of its own")]
    fp = {t: plain_fingerprint(t) for _, t in rows}
    root = roots(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    ids: dict = {}
    for d, t in rows:
        ids.setdefault(root[fp[t]], []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    got = [tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(((d, f"{fp[t]:016x}", least[root[fp[t]]]) for d, t in rows), key=str)


@pytest.mark.parametrize("hot", [3, 40, 512])
def test_connections_connect_what_all_links_connect(spark, hot):
    from loregrid.llm.common import components

    rnd = random.Random(hot)
    base = [rnd.getrandbits(64) for _ in range(5)] + [0]
    fps = sorted({b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(7))) for b in base for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    found = simhash.connections(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, hot)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(near(a, b) for a, b in pairs)
    want = roots(signed, near)
    linked = {x for p in pairs for x in p}
    assert {r.node: r.root for r in components(found).collect()} == {x: r for x, r in want.items() if x in linked}
    assert all(want[x] == x and list(want.values()).count(x) == 1 for x in set(signed) - linked)


def test_rows_of_clashing_columns_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i * i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (None, a), (None, b), (7, c), (7, " ".join(reversed(c.split()))), (1, a)]
    df = spark.createDataFrame([(*r, "own", "own", "own", "own") for r in rows], "doc_id long, text string, _d string, _th string, d string, th string")
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("1", a), ("None", b), ("7", c), ("7", rows[4][1])])
    assert simhash.deduplicated(df.limit(0)).count() == 0
