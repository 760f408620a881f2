"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from .common import discard, fresh, read, release, small, stored, words

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: A broadcast holds at most so many terms or anchors of test items; beyond it a term's postings are dealt to so many tasks.
MOST_TERMS, SALTS = 200_000, 32
#: Words within which an item's two rarest terms are near each other.
SLOP = 13


def keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """Rows by (d, th): the doc_id, -1 for null, and a hash of the text. What is found depends on the text alone."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), *more)


def _named(tokens: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``tokens(term, d, ...)`` joined with the ``n`` rows of ``keys(term, ...)``; a frequent term is never one task's."""
    if n <= MOST_TERMS:
        return tokens.join(F.broadcast(keys), "term")
    dealt = tokens.withColumn("salt", F.pmod(F.xxhash64("d", "th"), F.lit(SALTS)))
    return dealt.join(keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["term", "salt"]).drop("salt")


def positional_index(docs: DataFrame, terms: DataFrame | None = None, n_terms: int = 0) -> DataFrame:
    """Stored postings ``(term, d, th, pos)`` of ``docs(doc_id, text)``, sorted by term within each segment.

    ``terms`` (distinct ``term``) limits the index to the lists that queries can name; without it every
    word of every document is indexed. A segment is what one task reads, so the build doesn't shuffle.
    """
    tokens = keyed(docs, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    if terms is not None:
        tokens = _named(tokens, terms, n_terms)
    return stored(tokens.select("term", "d", "th", "pos").sortWithinPartitions("term"), "postings")


def test_items(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored ``(item, item_id, iw, n, size)``: each distinct item with its words, their number and its window's size.

    Items without words or without item_id are left out; repeated items count once.
    """
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("iw")).where("size(iw) > 0").distinct()
    items = items.withColumn("n", F.size("iw")).withColumn("size", F.least("n", F.lit(window)))
    return stored(items.select(F.xxhash64("item_id", "iw").alias("item"), "item_id", "iw", "n", "size"), "items")


def _anchors(items: DataFrame, index: DataFrame) -> DataFrame:
    """``(item, t1, p1, t2, p2)``: for each window of each item its two rarest terms and where they stand in the item.

    Windows with a term that no document has can't occur and are left out. A window of one word has t2 null.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("cf"))
    starts = items.select("item", "iw", "size", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))).alias("o"))
    cells = starts.select("item", "o", "size", F.posexplode(F.slice("iw", F.col("o") + 1, F.col("size"))).alias("j", "term"))
    cells = cells.join(counts, "term", "left")
    ranked = cells.withColumn("rank", F.row_number().over(W.partitionBy("item", "o").orderBy("cf", "term", "j")))
    whole = ranked.groupBy("item", "o").agg(
        F.count_if(F.col("cf").isNull()).alias("missing"),
        *[F.max(F.when(F.col("rank") == k, F.struct("term", (F.col("o") + F.col("j")).alias("p")))).alias(f"r{k}") for k in (1, 2)],
    )
    return whole.where("missing = 0").select("item", F.col("r1.term").alias("t1"), F.col("r1.p").alias("p1"), F.col("r2.term").alias("t2"), F.col("r2.p").alias("p2")).distinct()


def _candidates(index: DataFrame, items: DataFrame) -> DataFrame:
    """``(d, th, item, diag)``: where offset-adjusted lists of a window's two rarest terms meet; diag is document minus item position."""
    anchors = stored(_anchors(items, index), "anchors")
    n = anchors.count()
    first = _named(index, anchors.withColumnRenamed("t1", "term"), n).select("d", "th", "item", (F.col("pos") - F.col("p1")).alias("diag"), "t2", "p2")
    second = _named(index, anchors.select(F.col("t2").alias("term")).where("term is not null").distinct(), n)
    second = second.select("d", "th", F.col("term").alias("t2"), F.col("pos").alias("pos2")).distinct()
    first = first.withColumn("pos2", F.col("diag") + F.col("p2")).distinct()
    met = first.where("t2 is not null").join(second, ["d", "th", "t2", "pos2"], "left_semi").select("d", "th", "item", "diag")
    return met.union(first.where("t2 is null").select("d", "th", "item", "diag")).distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    """Stored ``(d, th, item_id, start, end)``: every place where a window of an item stands in a document; words from 0, end exclusive.

    Candidates from the index are verified on the documents' words, so hash collisions can't pass.
    """
    cands = stored(_candidates(index, items), "candidates")
    keys = cands.select("d", "th").distinct()
    held = keyed(docs, "text").join(keys, ["d", "th"], "left_semi").select("d", "th", words(F.col("text")).alias("w")).distinct()
    placed = held.join(cands, ["d", "th"]).join(small(items, items.count(), 20_000), "item")
    same = F.expr("array_join(transform(iw, (x, i) -> CASE WHEN diag + i >= 0 AND x = get(w, diag + i) THEN '1' ELSE '0' END), '')")
    runs = placed.select("d", "th", "item_id", "diag", "n", "size", same.alias("same"), F.expr("repeat('1', size)").alias("ones"))
    found = runs.where("contains(same, ones)").select("d", "th", "item_id", "diag", "size", F.explode(F.expr("filter(sequence(0, n - size), o -> substring(same, o + 1, size) = ones)")).alias("o"))
    return stored(found.select("d", "th", "item_id", (F.col("diag") + F.col("o")).alias("start"), (F.col("diag") + F.col("o") + F.col("size")).alias("end")), "matches")


def proximity_matches(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """``(pair_id, d, th, pos_a, pos_b)``: places where the terms of ``pairs(pair_id, a, b)`` stand within ``slop`` words, in either order.

    The longer list meets the shorter by blocks of positions: an equi-join on document and block with the
    two neighbouring blocks, never a product of whole lists.
    """
    n = pairs.count()
    block = F.floor(F.col("pos") / max(1, slop))
    a = _named(index, pairs.select("pair_id", F.col("a").alias("term")), n).select("pair_id", "d", "th", F.col("pos").alias("pos_a"), block.alias("block"))
    b = _named(index, pairs.select("pair_id", F.col("b").alias("term")), n).select("pair_id", "d", "th", F.col("pos").alias("pos_b"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    near = F.abs(F.col("pos_a") - F.col("pos_b")).between(1, slop)
    return a.join(b, ["pair_id", "d", "th", "block"]).where(near).select("pair_id", "d", "th", "pos_a", "pos_b").distinct()


def near_items(items: DataFrame, index: DataFrame, slop: int = SLOP) -> DataFrame:
    """``(d, th, n_near)``: how many items have their two rarest terms, of those that documents have, within ``slop`` words of each other in a document."""
    counts = index.groupBy("term").agg(F.count("*").alias("cf"))
    ranked = items.select("item", "item_id", F.explode(F.array_distinct("iw")).alias("term")).join(counts, "term").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy("cf", "term")))
    pairs = ranked.where("rank <= 2").groupBy("item", "item_id").agg(F.max(F.when(F.col("rank") == 1, F.col("term"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("term"))).alias("b"))
    pairs = stored(pairs.where("b is not null").select(F.col("item").alias("pair_id"), "item_id", "a", "b"), "pairs")
    met = proximity_matches(index, pairs.drop("item_id"), slop).select("pair_id", "d", "th").distinct().join(small(pairs.select("pair_id", "item_id"), pairs.count(), MOST_TERMS), "pair_id")
    return met.groupBy("d", "th").agg(F.countDistinct("item_id").alias("n_near"))


def _report(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """``(d, th, n_hit, item_ids)``: words covered by any match, from the union of its spans, and the distinct items in order."""
    spans = matches.groupBy("d", "th", "start").agg(F.max("end").alias("end"))
    w = W.partitionBy("d", "th").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("d", "th").agg(F.sum("fresh").alias("n_hit"))
    ids = matches.select("d", "th", F.col("item_id").cast("string").alias("id")).distinct().groupBy("d", "th").agg(F.sort_array(F.collect_list("id")).alias("item_ids"))
    return hit.join(ids, ["d", "th"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and n_near, the items that are near (``near_items``).

    Null or empty texts have no words and aren't contaminated; an empty benchmark hits nothing. Items without
    item_id or words are ignored. Repeated documents each get their row. Other columns are not looked at.
    """
    items = test_items(benchmark, window)
    terms = stored(items.select(F.explode("iw").alias("term")).distinct(), "terms")
    index = positional_index(docs, terms, terms.count())
    report = stored(_report(docs, phrase_matches(docs, items, index)), "report")
    near = stored(near_items(items, index), "near")
    discard(index)
    release(docs.sparkSession)
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(report, ["d", "th"], "left").join(near, ["d", "th"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``docs`` without contaminated documents; repeated rows stay repeated."""
    items = test_items(benchmark, window)
    terms = stored(items.select(F.explode("iw").alias("term")).distinct(), "terms")
    index = positional_index(docs, terms, terms.count())
    report = stored(_report(docs, phrase_matches(docs, items, index)).select("d", "th", "n_hit"), "report")
    discard(index)
    release(docs.sparkSession)
    held = keyed(docs, F.size(words(F.col("text"))).alias("n_words")).join(report, ["d", "th"])
    d, th = fresh(docs, "d"), fresh(docs, "th")
    gone = stored(held.where(F.col("n_hit") * share >= F.col("n_words")).select(F.col("d").alias(d), F.col("th").alias(th)).distinct(), "contaminated")
    own = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col(d)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(th))
    return docs.join(gone, own, "left_anti")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contamination`` of all documents by all benchmark items; nulls, short items and repeats as there."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[o + 1:o + least(len(w), 13)], ' ') AS phrase
  FROM b, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS r(o) WHERE len(w) > 0
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), sizes AS (SELECT DISTINCT size FROM win),
g AS (
  SELECT rid, size, o, array_to_string(w[o + 1:o + size], ' ') AS phrase
  FROM d, sizes, unnest(range(0, greatest(len(w) - size, -1) + 1)) AS r(o)
), hit AS (SELECT g.rid, g.o, g.size, win.item_id FROM g JOIN win ON g.phrase = win.phrase AND g.size = win.size),
cov AS (SELECT rid, count(DISTINCT o + k) AS n_hit FROM hit, unnest(range(0, size)) AS r(k) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hit) GROUP BY rid), tok AS MATERIALIZED (SELECT rid, pos, w[pos + 1] AS term FROM d, unnest(range(0, len(w))) AS r(pos)),
cf AS MATERIALIZED (SELECT term, count(*) AS cf FROM tok GROUP BY term),
two AS MATERIALIZED (
  SELECT item, item_id, max(term) FILTER (rank = 1) AS a, max(term) FILTER (rank = 2) AS b FROM (
    SELECT item, item_id, term, row_number() OVER (PARTITION BY item ORDER BY cf, encode(term)) AS rank
    FROM (SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(w)) AS term FROM (SELECT DISTINCT item_id, w FROM b)) AS t JOIN cf USING (term)
  ) AS r WHERE rank <= 2 GROUP BY item, item_id
), near AS (
  SELECT x.rid, count(DISTINCT two.item_id) AS n_near FROM two JOIN tok x ON x.term = two.a JOIN tok y ON y.term = two.b AND y.rid = x.rid
  WHERE abs(x.pos - y.pos) BETWEEN 1 AND 13 GROUP BY x.rid
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(cov.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AND 20 * coalesce(cov.n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid) LEFT JOIN near USING (rid)
"""
