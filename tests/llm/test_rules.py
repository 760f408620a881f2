"""The rule ledger against a plain count, its policies and ablations against the texts themselves, and odd rows."""

from __future__ import annotations

import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from loregrid.llm import rules

TEXT = st.text(alphabet="ab #1\n\t é\U0001f600", max_size=60)


def plain(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    held = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(held), len(lines), sum(c in "0123456789" for c in text)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_measures(text):
    assert rules.measured(text.encode()) == plain(text)


def odd() -> list[tuple]:
    long = " ".join(f"w{i % 7_001}" for i in range(200_000))
    return [(1, "a b c a b c"), (1, "a b c a b c"), (1, "another text"), (None, None), (2, ""), (3, " \n\t\n"), (4, long), (5, "# " * 80), (6, "x" * 90_000), (None, "word " * 60), (7, "1 22 333 " * 30), (8, "same line here\n" * 40)]


def test_ledger_of_odd_rows(spark):
    docs = spark.createDataFrame(odd(), "doc_id long, text string")
    got = sorted(map(tuple, rules.ledger(docs).collect()), key=str)
    want = []
    for d, text in odd():
        m = dict(zip(rules.MEASURES, plain(text), strict=True))
        failed = sum(1 << k for k, (_, fails) in enumerate(rules.RULES) if eval(fails, {}, m))
        want.append((d, *m.values(), failed))
    assert got == sorted(want, key=str)


def test_policies_and_ablations(spark):
    rows = rules.ledger(spark.createDataFrame(odd(), "doc_id long, text string"))
    for policy, names in rules.POLICIES.items():
        out = rules.judged(rows, policy).collect()
        fails = [{n for k, (n, _) in enumerate(rules.RULES) if r.failed >> k & 1 and n in names} for r in out]
        assert [r.kept for r in out] == [not f for f in fails]
        assert [r.only_rule for r in out] == [min(f) if len(f) == 1 else None for f in fails]
        want = {n: (sum(n in f for f in fails), sum(f == {n} for f in fails)) for n in names}
        assert {r.rule: (r.n_failed, r.n_only) for r in rules.ablations(rows, policy).collect()} == want


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 9, 8)], "doc_id long, text string, N_words int, failed int")
    (r,) = rules.ledger(docs).collect()
    assert r.asDict()["N_words"] == 9 and r.asDict()["failed"] == 8 and r._n_words == 2 and r._failed & 1
    (j,) = rules.judged(rules.ledger(docs), "v2", failed="_failed").collect()
    assert j.kept is False
    empty = rules.ledger(docs.limit(0))
    assert empty.count() == 0 and {r.n_failed for r in rules.ablations(empty, "v2", "_failed").collect()} <= {0}
