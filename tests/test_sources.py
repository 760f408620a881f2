"""Ignore rules over real files, many patterns in one pass, trigram postings, innermost spans; each against brute force."""

from __future__ import annotations

import fnmatch
import os
import random

import pytest

from loregrid.functions import multi
from loregrid.operators.spans import innermost
from loregrid.sources import ignore
from loregrid.storage import trigrams


def segments(pattern: list[str], path: list[str]) -> bool:
    """Whether a pattern's segments, ** among them, match all of a path's; written without regular expressions."""
    if not pattern:
        return not path
    if pattern[0] == "**":
        if len(pattern) == 1:
            return bool(path)
        return any(segments(pattern[1:], path[k:]) for k in range(len(path) + 1))
    return bool(path) and fnmatch.fnmatchcase(path[0], pattern[0]) and segments(pattern[1:], path[1:])


def plain_ignored(tree: dict[str, str], path: str) -> bool:
    parts = path.split("/")
    for n in range(1, len(parts) + 1):  # from the top: what lies in an ignored folder is ignored
        node, is_dir, verdict = parts[:n], n < len(parts), None
        for d in range(n):
            text = tree.get("/".join([*parts[:d], ".gitignore"]))
            for line in (text or "").split("\n"):
                if not line.strip() or line.startswith("#"):
                    continue
                no, line = line.startswith("!"), line.removeprefix("!")
                only, line = line.endswith("/"), line.rstrip("/")
                if only and not is_dir:
                    continue
                rel = node[d:]
                hit = segments(line.removeprefix("/").split("/"), rel) if "/" in line else fnmatch.fnmatchcase(rel[-1], line)
                verdict = (not no) if hit else verdict
        if verdict:
            return True
    return False


def test_a_tree_of_real_files(spark, tmp_path):
    rng = random.Random(3)
    names, dirs = ["a.py", "b.rs", "c.log", "keep.log", "x1.txt", "x2.txt", "Makefile", ".hidden"], ["src", "build", "docs", "node_modules", "deep"]
    tree = {}
    for _ in range(220):
        tree["/".join([*rng.choices(dirs, k=rng.randrange(0, 4)), rng.choice(names)])] = "text"
    folders = sorted({os.path.dirname(p) for p in tree})
    lines = ["*.log", "!keep.log", "build/", "/docs", "src/**/x1.txt", "**/deep/*.py", "x[12].txt", "!x2.txt", "# no rule", "", "node_modules", "deep/**", "!src/deep/", "*.r?", "[!a-m]akefile", "/src/build/a.py", "**/docs/b.rs"]
    for f in ["", *rng.sample([f for f in folders if f], 14)]:
        tree[f"{f}/.gitignore".lstrip("/")] = "\n".join(rng.sample(lines, rng.randrange(2, 7)))
    for path, text in tree.items():
        (tmp_path / os.path.dirname(path)).mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "big.txt").write_text("x" * 5_000)
    (tmp_path / "binary.txt").write_bytes(b"\xff\xfe\x00")
    tree |= {"big.txt": None, "binary.txt": None}
    got = {r.path: r.content for r in ignore.scan(spark, f"file://{tmp_path}", most=4_000).collect()}
    want = {p: t for p, t in tree.items() if not plain_ignored(tree, p)}
    assert got == want and 30 < len(got) < len(tree) - 30
    less = {r.path for r in ignore.scan(spark, f"file://{tmp_path}", ["*.py", "/docs/"], most=4_000).collect()}
    assert less == {p for p in want if not p.endswith(".py") and not p.startswith("docs/")}


@pytest.mark.parametrize(("line", "hits", "misses"), [
    ("a b\\ ", ["a b "], ["a b"]), ("\\#x", ["#x"], ["x"]), ("\\!x", ["!x"], ["x"]), ("a.b", ["a.b", "d/a.b"], ["axb"]), ("/a*", ["a", "ab"], ["d/a", "a/b"]), ("d/**", ["d/x", "d/x/y"], ["d"]), ("a?c", ["abc"], ["a/c"]), ("[^a]", ["b"], ["a", "/"]), ("**/x/y", ["x/y", "a/b/x/y"], ["ax/y"]),
])
def test_single_rules(line, hits, misses):
    import re

    regex = ignore.rule(line)[0]
    assert all(re.search(regex, x) for x in hits) and not any(re.search(regex, x) for x in misses)


def test_no_rules_and_empty_listing(spark, tmp_path):
    assert ignore.rule("   ") is None and ignore.rule("# c") is None and ignore.rule("/") is None
    assert ignore.listing(spark, f"file://{tmp_path}").count() == 0
    df = spark.createDataFrame([("a", None), (None, None), ("b/c", "x")], "path string, content string")
    assert {r.path for r in ignore.visible(df).collect()} == {"a", "b/c"}


def plain_found(rows, patterns, fold=False):
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        raw = raw.lower() if fold else raw
        for n, p in enumerate(patterns):
            word, at = p.encode().lower() if fold else p.encode(), -1
            while (at := raw.find(word, at + 1)) >= 0:
                line = raw.count(b"\n", 0, at)
                out.append((key, n, line + 1, at - (raw.rfind(b"\n", 0, at) + 1) + 1, at))
    return sorted(out, key=str)


@pytest.mark.parametrize("fold", [False, True])
def test_sixty_four_patterns_over_documents(spark, fold):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(path).collect()] if os.path.isdir("/root/testdata/sf0.001") else []
    rows += [(None, "aaaa ÄaÄ\nthe the"), (5, None), (5, ""), (6, "the\n" * 20_000), (7, "THE The ü")]
    words = sorted({w for _, t in rows[:50] for w in (t or "").split() if len(w) > 1})
    patterns = [*random.Random(2).sample(words, min(50, len(words))), "the", "the", "th", "h", "aa", "aaa", "Ä", "ü", "no such words", " the", "The"]
    patterns = (patterns + [f"pad{k}" for k in range(64)])[:64]
    got = multi.found(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", patterns, fold)
    assert sorted(map(tuple, got.collect()), key=str) == plain_found(rows, patterns, fold)


def test_patterns_are_checked():
    for bad in ([], ["x"] * 65, [" "], ["a\nb"]):
        with pytest.raises(ValueError):
            multi.checked(bad)


def test_substrings_by_trigrams(spark, tmp_path):
    rng = random.Random(6)
    names = [(k, "".join(rng.choices("abcdeé_", k=rng.randrange(0, 14)))) for k in range(3_000)] + [(9_000, "needle_in_here"), (9_001, None), (9_002, "ab")]
    df = spark.createDataFrame(names, "id long, name string")
    index = trigrams.TrigramIndex(spark, f"file://{tmp_path}/grams").add(df.where("id % 2 = 0"), "even").add(df.where("id % 2 = 1"), "odd").add(df, "odd")
    asked = ["abc", "needle", "é_a", "zzz", "ab", "abcab", "a_b_", "%b_", ""]
    patterns = spark.createDataFrame([*enumerate(asked)], "query int, text string")
    got = sorted(map(tuple, index.search(patterns).collect()))
    assert got == sorted((q, i) for q, p in enumerate(asked) for i, n in names if n is not None and p and p in n)
    met = index.candidates(patterns).groupBy("query").count().collect()
    assert {r.query: r["count"] for r in met}[1] == 1 and sum(r["count"] for r in met) < len(names) / 4  # of seven full scans


def test_innermost_spans(spark):
    rng = random.Random(9)
    spans = [(k, f"f{rng.randrange(4)}", a := rng.randrange(300), a + rng.choice([0, 3, 3, 40, 200])) for k in range(400)] + [(900, "f0", 0, 100_000), (901, None, 1, 2), (902, "f1", 5, None), (903, "f1", 9, 3)]
    points = [(f"p{k}", f"f{rng.randrange(5)}", rng.randrange(320)) for k in range(900)] + [("far", "f0", 99_999), ("null", None, 3), ("none", "f1", None), ("p1", "f0", 5)]
    p, s = spark.createDataFrame(points, "id string, path string, line int"), spark.createDataFrame(spans, "id long, path string, line_start int, line_end int")
    want = []
    for i, f, line in points:
        held = [(b - a, k) for k, g, a, b in spans if f is not None and g == f and line is not None and b is not None and a <= line <= b]
        want += [(i, min(held)[1])] if held else []
    for stretch in (16, 4_096):
        assert sorted(map(tuple, innermost(p, s, stretch).collect())) == sorted(want)
