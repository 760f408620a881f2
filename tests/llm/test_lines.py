"""Line dedup against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

from loregrid.llm import lines

SCHEMA = "doc_id long, text string"


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_lines, n_removed, sha) of each row: components of all pairs of lines, first by (doc_id, line)."""
    key = lambda d: -1 if d is None else d
    seen = [(key(d), n, t or "", lines.normal(x)) for d, t in rows for n, x in enumerate((t or "").split("\n"))]
    sets = {x: lines.shingles(x) for *_, x in seen if x}
    group = {x: x for x in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = {k: new if v == old else v for k, v in group.items()}
    first: dict = {}
    for d, n, t, x in seen:
        if x:
            first[group[x]] = min(first.get(group[x], (d, n)), (d, n))
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        keep = [x for n, x in enumerate(ls) if not lines.normal(x) or first[group[lines.normal(x)]] == (key(d), n)]
        out.append((d, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


def texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "lambda", "über", "naïve"]
    base = [" ".join(rnd.choices(words, k=rnd.choice([1, 2, 20, 60]))) for _ in range(14)]

    def line() -> str:
        x = rnd.choice(base)
        return rnd.choice([x, x.upper(), x.replace("alpha", "alpho", 1), f"  {x} ", x + " end", "", "  "])

    return ["\n".join(line() for _ in range(rnd.randrange(1, 6))) for _ in range(n)]


def test_report_equals_brute_force(spark):
    rows = [*enumerate(texts(4, 60)), (900, None), (901, ""), (902, "only here, nowhere else")]
    got = [tuple(r) for r in lines.line_report(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(brute_force(rows))


@pytest.mark.parametrize("met", [2, 64])
def test_shared_buckets_are_all_found(spark, monkeypatch, met):
    """Every line of every bucket with two different lines, once for each task that signed it."""
    monkeypatch.setattr(lines, "_MET", met)
    base = "the quick brown fox jumps over the lazy dog near the old stone bridge at noon "
    many = [(k, base + str(k if k % 3 == 0 else k * 7919) + "\n" + hashlib.sha256(str(k).encode()).hexdigest() + "\n" + base) for k in range(600)]
    for rows in ([], [(1, None), (2, ""), (3, "x"), (None, "y\ny")], many):
        signed = lines.line_signatures(spark.createDataFrame(rows, SCHEMA)).persist()
        at = {r.sid: (r.h1, r.h2) for r in signed.collect()}
        want: dict = {}
        for r in signed.where("bands is not null").collect():
            for band, b in enumerate(np.frombuffer(bytes(r.bands), dtype=np.uint64).tolist()):
                want.setdefault((band, b), set()).add((r.h1, r.h2))
        got: dict = {}
        for r in lines.shared_buckets(signed).collect():
            got.setdefault(r.bucket, set()).add(at[r.sid])
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
        signed.unpersist()


def test_lines_that_share_ends_are_surely_alike():
    rnd = random.Random(9)
    told = 0
    for _ in range(3000):
        x = "".join(rnd.choices("ab c", k=rnd.randrange(1, 90)))
        at = rnd.randrange(len(x))
        y = x[:at] + "".join(rnd.choices("ab c", k=rnd.randrange(0, 6))) + x[at + rnd.randrange(0, 6) :]
        if not y:
            continue
        a, b = lines.shingles(x), lines.shingles(y)
        if lines._surely_alike(x, y, len(a), len(b), 0.8):
            told += 1
            assert len(a & b) >= 0.8 * len(a | b)
    assert told > 100


def test_odd_rows_and_clashing_columns(spark):
    rows = [(None, "one line that two texts hold\nsome text of its own", "a"), (None, "one line that two texts hold\nquite another text here", "b"), (3, None, "c"), (3, "", "d"), (4, "x\nx", "e"), (4, "x\nx", "f"), (5, "long " * 30_000, "g")]
    names = ["doc_id", "text", "_gone", "gone", "_th", "th", "_d", "d", "class", "first"]
    df = spark.createDataFrame([(*r[:2], *[r[2]] * 8) for r in rows], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = lines.deduplicated(df)
    assert out.columns == names
    got = {r.first: r.text for r in out.collect()}
    assert sorted([got["a"], got["b"]], key=len) in (["some text of its own", "one line that two texts hold\nquite another text here"], ["quite another text here", "one line that two texts hold\nsome text of its own"])
    assert (got["c"], got["d"], got["e"], got["f"], got["g"]) == (None, "", "x", "x", "long " * 30_000)
    assert lines.deduplicated(df.limit(0)).count() == 0


def test_second_run_joins_whole_components(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, root long")
    more = spark.createDataFrame([(2, 6), (20, 21), (9, 30)], "a long, b long")
    got: dict = {}
    for r in lines._joined(comp, 6, more).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [[1, 2, 5, 6], [8, 9, 30], [20, 21]]


def test_lines_whose_hashes_agree_in_24_bits_are_told_apart(spark):
    """Two similar lines that agree in the leading bits of their hash stay two lines of every bucket that they share."""
    base = "a sentence of some length that is repeated with another number at its very end, again and again: "
    seen: dict = {}
    for k in range(200_000):
        line = base + str(k)
        h = np.frombuffer(lines.xxhash.xxh3_128_digest(line.encode()), dtype=np.uint64)[0]
        if (other := seen.setdefault(int(h >> np.uint64(40)), line)) is not line and h != np.frombuffer(lines.xxhash.xxh3_128_digest(other.encode()), dtype=np.uint64)[0]:
            break
    else:
        raise AssertionError("no collision found")
    rows = [(1, other), (2, line), (3, "something else entirely")]
    got = [tuple(r) for r in lines.line_report(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(brute_force(rows)) and sum(r[2] for r in got) == 1
