"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded, fresh, read, release, stored

#: Labelled documents that the classifiers are fitted on, at most: those with the smallest hashes of doc_id.
MOST_LABELLED = 20_000
#: Toxic documents, the share of all toxic ones, and the odds that a term of the learned lexicon needs.
LEAST_TOXIC, LEAST_TOXIC_SHARE, LEAST_ODDS = 3, 0.005, 8.0
#: Bounds of the prior's strength, in documents.
STRENGTH = (5.0, 5_000.0)
#: Documents that score less are rejected.
THRESHOLD = 0.5

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FEATURES = ["log_words", "upper", "symbols", "pipes", "digits", "word_length", "distinct", "repeated", "longest"]


def features(text: str | None) -> list[float]:
    """Shape of a text, without looking at which words it holds. Null and empty texts: zeros."""
    b = (text or "").encode("utf-8", "surrogatepass")
    if not b.strip():
        return [0.0] * len(FEATURES)
    n = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    upper, lower, digits, high = n[65:91].sum(), n[97:123].sum(), n[48:58].sum(), n[128:].sum()
    blank = n[32] + n[9:14].sum()
    marks = len(b) - upper - lower - digits - high - blank
    w = b.lower().split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    size = len(b) - blank
    return [
        float(np.log1p(len(w))), upper / (upper + lower + high + 1.0), (marks - n[ord(".")] - n[ord(",")]) / size, n[ord("|")] / len(w), digits / size,
        size / len(w), len(set(w)) / len(w) ** 0.9, 1 - len(set(lines)) / len(lines), float(np.log1p(max(map(len, w)))),
    ]


def terms(text: str | None) -> set[bytes]:
    return set(_WORD.findall((text or "").encode("utf-8", "surrogatepass").lower()))


def copy_key(text: str | None) -> bytes:
    """The text's least hash over 3-word shingles: copies and near copies mostly share it."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return min((xxhash.xxh64_digest(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=b"")


@dataclass
class Logistic:
    """Ridge logistic regression on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w = np.zeros(z.shape[1])
        penalty = np.r_[1e-3, np.full(len(w) - 1, ridge)]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    quality: Logistic | None = None
    toxic: Logistic | None = None
    lexicon: dict[bytes, float] = field(default_factory=dict)

    def odds(self, text: str | None) -> list[float]:
        """Evidence of the learned toxic terms: their summed log odds, their number, the strongest."""
        found = [self.lexicon[t] for t in terms(text) & self.lexicon.keys()] if self.lexicon else []
        return [sum(found), float(len(found)), max(found, default=0.0)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is good: of quality and not toxic."""
        if not texts:
            return np.zeros(0)
        good = np.full(len(texts), 0.5) if self.quality is None else self.quality(np.array([features(t) for t in texts]))
        return good * (1 if self.toxic is None else 1 - self.toxic(np.array([self.odds(t) for t in texts])))


def _per_text(df: DataFrame, make, kind: str) -> DataFrame:
    """``df`` with its column text replaced by ``x``, what ``make`` gives for a list of texts."""
    names = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [make(part.column(part.schema.get_field_index("text")).to_pylist())], names=[*names, "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text")
    return df.mapInArrow(run, f"{schema}, x {kind}")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Classifiers for quality and toxicity from ``labels(doc_id, quality, toxic)``.

    Fitted on at most ``most`` labelled documents, those whose doc_id has the smallest hash. Labels with
    nulls are left out; of repeated labels the lower quality and the higher toxicity count. A side without
    both classes isn't fitted: quality is then 0.5 and toxicity 0.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    held = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``most`` rows of three numbers
    held = stored(held.select("doc_id", "quality", "toxic", "text").dropDuplicates(["doc_id"]), "labelled-texts")
    rows = _per_text(held.select("quality", "toxic", "text"), lambda ts: pa.array([features(t) for t in ts], pa.list_(pa.float64())), "array<double>").toPandas()
    if rows.empty:
        return Model()
    x, q, t = np.array(rows["x"].tolist()), (rows["quality"] > 0).to_numpy(float), (rows["toxic"] > 0).to_numpy(float)
    model = Model()
    if 0 < q.sum() < len(q):
        model.quality = Logistic.fit(x, q)
    if 0 < t.sum() < len(t):
        # copies of a document tell of its terms only once
        listed = _per_text(held.select("toxic", "text"), lambda ts: pa.array([{"key": copy_key(t), "terms": list(terms(t))} for t in ts], pa.struct([("key", pa.binary()), ("terms", pa.list_(pa.binary()))])), "struct<key: binary, terms: array<binary>>")
        toxic = (F.col("toxic") > 0).alias("toxic")
        sizes = dict(map(tuple, listed.groupBy(toxic).agg(F.countDistinct("x.key")).collect()))
        seen = listed.select(toxic, "x.key", F.explode("x.terms").alias("term")).distinct()
        counts = seen.groupBy("term").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("fine"))
        bad, fine = float(sizes[True]), float(sizes[False])
        odds = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("fine") + 0.5) / (fine + 1))
        strong = counts.where(F.col("bad") >= max(LEAST_TOXIC, LEAST_TOXIC_SHARE * bad)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
        model.lexicon = {bytes(r.term): float(np.log(r.odds)) for r in strong.collect()}  # terms of a bounded sample
        if model.lexicon:
            both = _per_text(held.select("toxic", "text"), lambda ts: pa.array([model.odds(t) for t in ts], pa.list_(pa.float64())), "array<double>").toPandas()
            model.toxic = Logistic.fit(np.array(both["x"].tolist()), (both["toxic"] > 0).to_numpy(float))
    release(docs.sparkSession)
    return model


def _logit(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def strength(within: float, between: float) -> float:
    """How many documents a prior is worth, from the variance within and between groups."""
    return float(np.clip(within / max(between, 1e-9), *STRENGTH))


def _between(ss: float, n: float, mean_ss: float, n_effective: float, within: float, groups: float) -> float:
    """Variance between groups by the method of moments: the spread of their means less what chance makes of it."""
    return max(0.0, (ss - mean_ss - within * groups) / n_effective) if n > 0 and n_effective > 0 else 0.0


def site_sums(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Stored ``(host, path, s, n, hs, hn)``: sums and counts of ``doc_score`` by path and host; the global mean, and the strengths of the priors.

    A host's mean is shrunk toward the global one and a path's toward its host's, each by a prior worth as many
    documents as the spread at its own level tells (method of moments): between hosts, and between the paths
    of a host. Partial sums go over the network, not rows.
    """
    x = F.col("doc_score")
    paths = stored(scored.groupBy("host", "path").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("pss"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"))
    t = hosts.agg(
        F.sum("hs").alias("s"), F.sum("hn").alias("n"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("hss"), F.sum("pss").alias("pss"),
        F.sum(F.col("hn") * F.col("hn")).alias("hh"), F.sum(F.col("nn") / F.col("hn")).alias("pp"), F.sum("k").alias("paths"), F.count("*").alias("hosts"),
    ).first()
    q = paths.agg(F.sum("q")).first()[0]
    if not t.n:
        return paths.select("host", "path", "s", "n", F.lit(0.0).alias("hs"), F.lit(0).cast("long").alias("hn")), 0.5, STRENGTH[0], STRENGTH[0]
    mean = t.s / t.n
    within = max(1e-9, (q - t.pss) / max(1, t.n - t.paths))
    of_hosts = strength(within, _between(t.hss, t.n, t.s * mean, t.n - t.hh / t.n, within, t.hosts - 1))
    of_paths = strength(within, _between(t.pss, t.n, t.hss, t.n - t.pp, within, t.paths - t.hosts))
    sums = stored(paths.join(hosts.select("host", "hs", "hn"), "host").select("host", "path", "s", "n", "hs", "hn"), "sites")
    return sums, mean, of_hosts, of_paths


def _sited(docs: DataFrame, host: str, path: list[str]) -> DataFrame:
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host, *path)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), named[0].alias("host"), F.concat_ws("/", *named).alias("path"), "text")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("lang",), threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, doc_score, host_post, path_post, score, keep (and th, a hash of the text).

    host_post and path_post are the posteriors of the document's sites without the document itself, so that no
    score stands for its own evidence; those of a site of one document are its prior's. The score is the
    document's odds with the global prior replaced by its path's posterior. Null hosts and paths are sites of
    their own. Null or empty texts are scored like any text. Without labels every score is 0.5. Repeated rows
    each count and each get their row; other columns are not looked at.
    """
    model = fit(docs, labels)
    scored = stored(_per_text(_sited(docs, host, list(path)), lambda ts: pa.array(model.score(ts)), "double").withColumnRenamed("x", "doc_score"), "scored")
    sums, mean, a, b = site_sums(scored)
    joined = scored.join(bounded(sums, sums.count(), 150), ["host", "path"])
    own = F.col("doc_score")
    joined = joined.withColumn("hp", (F.col("hs") - own + a * mean) / (F.col("hn") - 1 + a))
    joined = joined.withColumn("pp", (F.col("s") - own + F.lit(b) * F.col("hp")) / (F.col("n") - 1 + b))
    score = 1 / (1 + F.exp(-(_logit(own) - _logit(F.lit(mean)) + _logit(F.col("pp")))))
    r = lambda c: F.round(c, 6)
    return joined.select("doc_id", "th", r(own).alias("doc_score"), r(F.col("hp")).alias("host_post"), r(F.col("pp")).alias("path_post"), r(score).alias("score"), (r(score) >= threshold).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that ``classify`` rejects; rows that repeat doc_id and text share their fate. Columns pass through, whatever their names."""
    d, th = fresh(docs, "d"), fresh(docs, "th")
    out = stored(classify(docs, labels).groupBy(F.coalesce("doc_id", F.lit(-1)).alias(d), F.col("th").alias(th)).agg(F.bool_or("keep").alias("kept")).where("NOT kept").drop("kept"), "rejected")
    own = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col(d)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(th))
    return docs.join(bounded(out, out.count(), 16), own, "left_anti")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``classify`` of all documents by all labels; nulls, ties and repeats as there."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("th")
