"""Quality classifier: posteriors against brute force, held-out labels, odd rows."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loregrid.llm import quality

SF = "/root/testdata/sf0.1"


def test_posteriors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for host in range(12):
        for path in range(rng.integers(1, 4)):
            level = np.clip(0.5 + 0.25 * np.sin(host) + 0.1 * path, 0.05, 0.95)
            rows += [(f"h{host}", f"h{host}/{path}", float(np.clip(rng.normal(level, 0.1), 0.01, 0.99))) for _ in range(rng.integers(1, 30))]
    sums, mean, a, b = quality.site_sums(spark.createDataFrame(rows, "host string, path string, doc_score double"))
    x = np.array([r[2] for r in rows])
    by = lambda k: {g: np.array([r[2] for r in rows if r[k] == g]) for g in {r[k] for r in rows}}
    hosts, paths = by(0), by(1)
    n = len(x)
    within = sum(((v - v.mean()) ** 2).sum() for v in paths.values()) / (n - len(paths))
    spread = sum(len(v) * (v.mean() - x.mean()) ** 2 for v in hosts.values())
    tau = max(0, (spread - within * (len(hosts) - 1)) / (n - sum(len(v) ** 2 for v in hosts.values()) / n))
    inner = sum(len(v) * (v.mean() - hosts[p.split("/")[0]].mean()) ** 2 for p, v in paths.items())
    rho = max(0, (inner - within * (len(paths) - len(hosts))) / (n - sum(len(v) ** 2 / len(hosts[p.split("/")[0]]) for p, v in paths.items())))
    assert mean == pytest.approx(x.mean()) and a == pytest.approx(quality.strength(within, tau)) and b == pytest.approx(quality.strength(within, rho))
    for r in sums.collect():
        assert (r.s, r.n, r.hs, r.hn) == (pytest.approx(paths[r.path].sum()), len(paths[r.path]), pytest.approx(hosts[r.host].sum()), len(hosts[r.host]))


def test_score_leaves_the_document_out_of_its_sites(spark):
    texts = ["plain words of a quiet text. " * 8, "SHOUT !!! | | | 111 " * 9]
    docs = [(k, texts[k % 3 == 0], "en", f"s{k % 4}") for k in range(60)] + [(60, None, None, None), (61, "", "en", "lone")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    host = {d: s or "" for d, _, _, s in docs}
    path = {d: f"{s or ''}/{lang or ''}" for d, _, lang, s in docs}
    scored = spark.createDataFrame([(host[d], path[d], got[d].doc_score) for d in host], "host string, path string, doc_score double")
    _, mean, a, b = quality.site_sums(scored)
    for d, r in got.items():
        others = [got[o].doc_score for o in host if host[o] == host[d] and o != d]
        hp = (sum(others) + a * mean) / (len(others) + a)
        same = [got[o].doc_score for o in path if path[o] == path[d] and o != d]
        pp = (sum(same) + b * hp) / (len(same) + b)
        assert (r.host_post, r.path_post) == (pytest.approx(hp, abs=1e-4), pytest.approx(pp, abs=1e-4))
    assert got[60].host_post == got[61].host_post == pytest.approx(mean, abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_labels_of_the_test_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    keep = {r.doc_id: r.keep for r in quality.classify(docs, known).collect()}
    held = [(bool(r.quality > 0 and r.toxic == 0), keep[r.doc_id]) for r in labels.join(known, "doc_id", "left_anti").collect() if r.doc_id in keep]
    assert len(held) > 100 and np.mean([w == k for w, k in held]) >= 0.97 and np.mean([k for w, k in held if w]) >= 0.98


def test_odd_rows_and_clashing_columns(spark):
    names = ["_d", "_th", "d", "th", "host", "path", "x", "s", "n", "keep", "kept", "doc_score"]
    rows = [(1, "good text here", "en", "s"), (None, None, None, None), (None, "", "en", "s"), (3, "w " * 30_000, "en", "t"), (1, "good text here", "en", "s"), (1, "another", "en", "s")]
    df = spark.createDataFrame([(*r, *["own"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(2, 1, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.accepted(df, labels)
    assert out.columns == df.columns and out.count() == 6
    assert quality.accepted(df.limit(0), labels).count() == 0 and quality.accepted(df, labels.limit(0)).count() == 6
