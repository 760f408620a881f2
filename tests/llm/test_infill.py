"""Fill-in-middle against a plain cut of each text, and its round trip."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from loregrid.llm import infill

UNIT = re.compile(infill.UNIT)


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd() -> list[tuple]:
    texts = ["one", " two  words ", "\n\t \r", "a <P> mark", "ends with < and <S", "é ü \U0001f600 ß x", "x " * 30_000, "y" * 50_000, "<", "S> M> P>"]
    rows = [(i, t) for i in range(40) for t in texts[i % 3 :: 3]]
    return [*rows, *rows[:20], (None, "no id at all"), (None, "no id at all"), (0, "no id at all"), (None, None), (7, None), (8, ""), (-5, "minus five words in here")]


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd(), "doc_id long, text string")
    out = infill.transformed(docs).withColumn("back", infill.rebuilt(F.col("output"), F.col("form"))).collect()
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out], key=str) == sorted([(d, *plain(d, t)) for d, t in odd()], key=str)
    assert all(r.back == (r.text or "") for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(i, f"some words {i} and more", 1, "f", 2, 3, 4, 5) for i in range(12)], "doc_id long, text string, n int, Form string, _d int, _th int, _first int, output int")
    out = infill.transformed(docs)
    assert {(r.doc_id, r._n, r._Form if "_Form" in r else r._form, r.prefix_chars, r.middle_chars, r._output) for r in out.collect()} == {(i, *plain(i, f"some words {i} and more")) for i in range(12)}
    assert infill.transformed(docs.limit(0)).count() == 0
