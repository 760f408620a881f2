"""Hashed vectors and commit logs: nothing is held for a whole text's words or a whole log."""

from __future__ import annotations

import hashlib
import random
from collections import Counter


def test_hashed_vectors_are_one_sum_by_text_and_bucket(spark):
    from loregrid.operators.retrieval import DIMENSIONS, hashed

    rnd = random.Random(2)
    words = [f"word{k}" for k in range(300)]
    texts = [(k, " ".join(rnd.choices(words, k=rnd.randrange(400)))) for k in range(20)] + [(20, None), (21, "\u00fcber \u00fcber caf\u00e9")]
    texts += [(3, "word7 word7 word9")]  # a repeated id adds up
    want: Counter = Counter()
    for i, text in texts:
        for w in (text or "").split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
            want[i, h % DIMENSIONS] += 1 if h // DIMENSIONS % 2 == 0 else -1
    df = hashed(spark.createDataFrame(texts, "id long, text string"), "text")
    assert {(r.id, r.bucket): r.v for r in df.collect()} == {k: float(v) for k, v in want.items() if v}
    assert df._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2  # partial and final, by id and bucket only


def test_entries_meet_the_first_of_their_title_only(spark, tmp_path):
    from loregrid.plans import registry

    ids = [700 * k + (k % 2) for k in range(1, 40)] + [0, 5]
    spark.createDataFrame([(i, "a text", "en", "src1", 6) for i in ids], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = registry.QUERIES["RET12"](spark, str(tmp_path))
    want = [(i, "title", old) for i in ids if i >= 700 if (old := min(x for x in ids if x % 700 == i % 700)) < i]
    assert sorted(map(tuple, df.collect())) == sorted([*want, (3, "vector", 1)])
    assert "Aggregate [title" in df._jdf.queryExecution().optimizedPlan().toString()
