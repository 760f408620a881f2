"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import components, discard, fresh, read, release, stored

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Members of one posting list from which its pairs are looked for in longer keys.
HOT_LIST = 512
_CHUNK = 1 << 16


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; no words: zero."""
    w = (text or b"").lower().split()  # bytes: lower() and split() know ASCII only
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), seed=SEED) for i in range(at, min(n, at + _CHUNK))], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, fp)`` for every row of ``docs``; th is a hash of the text, fp the fingerprint's bit pattern as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), _text_hash().alias("th")).mapInArrow(run, "doc_id long, th long, fp long")


def cover() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions such that any 4 positions hold one of them (Turan's construction)."""
    parts = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [t for p in parts for t in combinations(p, 3)]
    for i, p in enumerate(parts):
        found += [(*two, one) for two in combinations(p, 2) for one in parts[(i + 1) % 3]]
    return found


def _byte(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255))


def _key(fp: Column, at: tuple[int, ...]) -> Column:
    key = F.lit(0).cast("long")
    for i in at:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, i))
    return key


def _first(x: Column, lists: list[tuple[int, ...]]) -> Column:
    """Number of the first list in which both ends of a pair stand, from their XOR."""
    out = F.when(_key(x, lists[0]) == 0, 0)
    for n, at in enumerate(lists[1:], 1):
        out = out.when(_key(x, at) == 0, n)
    return out


def _pairs(postings: DataFrame, lists: list[tuple[int, ...]], max_bits: int, once: bool, root: bool = False) -> DataFrame:
    more = ["root"] if root else []
    left = postings.select("list", "key", F.col("fp").alias("a"), *more)
    right = postings.select("list", "key", F.col("fp").alias("b"), *more)
    x = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((F.when(_byte(x, i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))
    # conditions of the join itself: only links leave it; with ``once``, each from the first list that its ends share
    meets = (F.col("l.list") == F.col("r.list")) & (F.col("l.key") == F.col("r.key")) & (F.col("a") < F.col("b")) & (shared >= 8 - max_bits) & (F.bit_count(x) <= max_bits)
    if root:
        meets = meets & (F.col("l.root") != F.col("r.root"))
    if once:
        meets = meets & (_first(x, lists) == F.col("l.list"))
    return left.alias("l").join(right.alias("r"), meets).select("a", "b")


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT_LIST) -> DataFrame:
    """Stored: all pairs ``(a, b)``, a < b, of the distinct longs in ``fps.fp`` that differ in at most ``max_bits`` <= 4 bits.

    Fingerprints within 4 bits share at least 4 of their 8 positional bytes. Lists of single bytes
    would pair up every 32nd fingerprint, so postings are kept by triples of positions: any 4 shared
    bytes hold one of the 20 triples of ``cover()``. Each pair's shared bytes are tallied, pairs below
    8 - max_bits go, the rest is verified. Lists longer than ``hot`` are left for keys of 4 bytes:
    the same lists, each split by a further shared byte, which any such pair has too.
    """
    triples = cover()
    postings = _postings(fps, triples)
    long_lists = _long(postings, hot)
    if long_lists.isEmpty():
        return _ending(_pairs(postings, triples, max_bits, once=True), postings)
    rest = postings.join(long_lists, ["list", "key"], "left_anti")
    quads = list(combinations(range(8), 4))
    heated = _heated(postings.join(long_lists, ["list", "key"], "left_semi"), triples, quads)
    return _ending(_pairs(rest, triples, max_bits, once=False).union(_pairs(heated, quads, max_bits, once=False)).distinct(), postings)


def _postings(fps: DataFrame, lists: list[tuple[int, ...]]) -> DataFrame:
    """Stored ``(fp, list, key)``: each fingerprint under its bytes at each list's positions."""
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("list"), _key(F.col("fp"), at).alias("key")) for n, at in enumerate(lists)])).alias("p")
    return stored(fps.select("fp", listed).select("fp", "p.list", "p.key"), "postings")


def _long(postings: DataFrame, hot: int) -> DataFrame:
    return stored(postings.groupBy("list", "key").count().where(F.col("count") > hot).select("list", "key"), "hot")


def _heated(postings: DataFrame, triples: list[tuple[int, ...]], quads: list[tuple[int, ...]]) -> DataFrame:
    """``(fp, list, key)`` under the 4-byte keys that hold one of the postings' triples."""
    of = {t: [n for n, q in enumerate(quads) if set(t) <= set(q)] for t in triples}
    longer = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("list"), _key(F.col("fp"), quads[q]).alias("key")) for t, n in enumerate(triples) for q in of[n]])).alias("p")
    return postings.select("fp", F.col("list").alias("t")).distinct().select("fp", "t", longer).where("p.t = t").select("fp", "p.list", "p.key").distinct()


def connections(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT_LIST) -> DataFrame:
    """Stored links ``(a, b)`` that connect the same fingerprints as ``links`` does, without all pairs of a large group.

    Lists up to ``hot`` give all their links. The members of a longer list are compared with two of them first,
    chosen by a hash, so that a group of near fingerprints is joined by links in proportion to its size. Then only
    4-byte keys whose members are still in different components are looked at, and only pairs across components.
    """
    triples = cover()
    postings = _postings(fps, triples)
    long_lists = _long(postings, hot)
    if long_lists.isEmpty():
        return _ending(_pairs(postings, triples, max_bits, once=True), postings)
    rest = _pairs(postings.join(long_lists, ["list", "key"], "left_anti"), triples, max_bits, once=False)
    heated = stored(postings.join(long_lists, ["list", "key"], "left_semi"), "heated")
    rank = F.xxhash64("fp")
    lead = heated.groupBy("list", "key").agg(F.min_by("fp", rank).alias("low"), F.max_by("fp", rank).alias("high"))
    star = heated.join(lead, ["list", "key"]).select("fp", F.explode(F.array("low", "high")).alias("lead")).where((F.col("fp") != F.col("lead")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("lead"))) <= max_bits))
    found = stored(rest.union(star.select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b"))).distinct(), "pairs")
    comp = stored(components(found).withColumnRenamed("node", "fp"), "components")
    quads = list(combinations(range(8), 4))
    longer = stored(_heated(heated, triples, quads).join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "longer")
    mixed = longer.groupBy("list", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("list", "key")
    across = _pairs(longer.join(mixed, ["list", "key"]), quads, max_bits, once=True, root=True)
    out = _ending(found.union(across).distinct(), postings)
    discard(heated, found, comp, longer)
    return out


def _ending(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    out = stored(pairs, "pairs")
    discard(postings)
    release(out.sparkSession)
    return out


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    Null or empty texts have fingerprint zero and link like any other. Copies share one fingerprint;
    links are made between distinct fingerprints only. Repeated rows each return a row. A null doc_id
    is never a component_id unless its component has no other. Other columns are not looked at.
    """
    fp = stored(fingerprints(docs), "fingerprints")
    joined = _rooted(fp, max_bits)
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = stored(joined.join(least, "root").select("fp", "component_id"), "members")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fp.join(per_class, "fp").select("doc_id", hexed, "component_id")


def _rooted(fp: DataFrame, max_bits: int) -> DataFrame:
    """Stored ``(fp, least, root)``: each distinct fingerprint with its smallest doc_id and its component's root."""
    classes = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    comp = components(connections(classes.select("fp"), max_bits)).withColumnsRenamed({"node": "fp"})
    return stored(classes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def deduplicated(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, nulls last, then with the smallest hash of its text.

    Rows are told apart by doc_id and text, so neither a null nor a repeated doc_id takes along rows of other components.
    """
    fp = stored(fingerprints(docs), "fingerprints")
    rows = stored(fp.join(_rooted(fp, max_bits).select("fp", "root"), "fp").select("root", "doc_id", "th"), "members")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    d, th = fresh(docs, "d"), fresh(docs, "th")
    gone = stored(rows.join(first, "root").where(other).select(F.col("doc_id").alias(d), F.col("th").alias(th)).distinct(), "gone")
    kept = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (_text_hash() == F.col(th)), "left_anti")
    if rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn(th, _text_hash()).dropDuplicates(["doc_id", th]).select(docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents; null and empty texts have fingerprint zero, repeated rows each a row."""
    return near_duplicates(read(spark, sf_dir, "documents"))
