"""Search pipelines: hashing embedder, hybrid document search, gated memory recall, chunking."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.text import content_tokens, identifiers, recall_terms, strong_tokens
from ..storage import commits
from ..storage.postings import LexicalIndex
from . import hybrid, memory, vectors
from .bounds import small

#: Buckets of the offline embedder; a model's vectors take its place where one is at hand.
DIMENSIONS = 64


def hashed(texts: DataFrame, text: str) -> DataFrame:
    """``(id, bucket, v)``: a sparse unit vector for each ``texts(id, text)``: content words in signed hash buckets."""
    md5 = F.md5(F.col("w").cast("binary"))
    h = F.conv(F.substring(md5, 14, 2), 16, 10).cast("int")  # the low byte of the leading 60 bits holds bucket and sign
    words = texts.select("id", F.explode(content_tokens(F.col(text))).alias("w")).select("id", h.alias("h"))
    # a word counts each time it stands there, so no table of a text's words is held: a text is DIMENSIONS sums at most
    summed = words.groupBy("id", (F.col("h") % DIMENSIONS).cast("long").alias("bucket")).agg(F.sum(F.when(F.floor(F.col("h") / DIMENSIONS) % 2 == 0, 1).otherwise(-1)).cast("double").alias("v"))
    return summed.where("v <> 0")


def dense(sparse: DataFrame) -> DataFrame:
    """``(id, v)``: sparse vectors ``(id, bucket, v)`` as arrays of ``DIMENSIONS``."""
    at = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "v"))).alias("m"))  # a bucket each, so DIMENSIONS at most
    return at.select("id", F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0))).alias("v"))


class Corpus:
    """A searchable table under ``root``: its lexical index and its vectors, written once and read by every search after.

    ``fields`` are indexed for words, ``embedded`` are joined and embedded. ``add`` appends a batch of rows with new ids;
    a batch that is there already changes nothing, one that died on the way is written again.
    """

    def __init__(self, spark: SparkSession, root: str, fields: Sequence[str], embedded: Sequence[str]) -> None:
        self.spark, self.root, self.embedded = spark, root, list(embedded)
        self.index = LexicalIndex(spark, f"{root}/lexical", fields)

    def add(self, rows: DataFrame, batch: str, embed: bool = True) -> Corpus:
        """``embed``: whether vectors are wanted too; they can follow later."""
        self.index.add(rows, batch)
        if not embed:
            return self
        version, content = commits.latest(self.spark, f"{self.root}/vectors")
        if batch not in content:
            folder = uuid.uuid4().hex
            # texts are dealt by id once, and all sums over their words stay where they are
            tasks = max(self.spark.sparkContext.defaultParallelism, rows.count() // 50_000)
            texts = rows.select("id", F.concat_ws(" ", *self.embedded).alias("text")).repartition(tasks, "id")
            dense(hashed(texts, "text")).write.parquet(f"{self.root}/vectors/{folder}")
            commits.publish(self.spark, f"{self.root}/vectors", version + 1, content | {batch: folder})
        return self

    def vectors(self) -> DataFrame:
        """``(id, v)`` of all batches; rows without content words have none."""
        return self.spark.read.parquet(*[f"{self.root}/vectors/{f}" for f in commits.latest(self.spark, f"{self.root}/vectors")[1].values()])

    def near(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query, id, cosine, rank)``: the k nearest vectors of the texts of ``queries(query, text)``."""
        q = dense(hashed(queries.select(F.col("query").alias("id"), "text"), "text")).toDF("query", "q")
        found = vectors.nearest(self.vectors(), q, k, "cosine").select("query", "id", F.round("value", 6).alias("cosine"))
        return top(found, k, F.desc("cosine"), F.col("id"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def hybrid_documents(corpus: Corpus, queries: DataFrame, limit: int) -> DataFrame:
    """``(query, id, score, cosine, rank)``: lexical and vector legs of ``2 * limit`` rows, fused by rank, normalised.

    ``corpus`` has the fields title and body; ``queries(query, text)``: a stated set. The cosine stays absolute.
    """
    terms = queries.select("query", F.array_distinct(content_tokens(F.col("text"))).alias("terms"))
    lex = corpus.index.search(terms, 2 * limit, {"title": 10.0, "body": 1.0}).select("query", "id", F.col("score").alias("lex"))
    vec = commits.kept(corpus.near(queries, 2 * limit).drop("rank"), "nearest")
    fused = hybrid.rrf([(lex, [F.desc("lex"), F.col("id")], hybrid.LEXICAL_WEIGHT), (vec, [F.desc("cosine"), F.col("id")], hybrid.VECTOR_WEIGHT)], per="query")
    fused = hybrid.normalize(fused, "score", ["query"]).withColumn("score", F.round("score", 6))
    return top(fused.join(vec.select("query", "id", "cosine"), ["query", "id"], "left"), limit, F.desc("score"), F.col("id"))


def recall(corpus: Corpus, entries: DataFrame, queries: DataFrame, limit: int, now: int, floor: float, half_life: int = 14 * 86_400) -> DataFrame:
    """``(query, id, score, cosine, rank)``: gated hybrid recall over memory entries.

    ``corpus`` holds the fields title and content of ``entries``. Candidates come from any shared recall term and from
    the nearest vectors; an entry is admitted by strong lexical evidence or by its absolute cosine, before anything
    is normalised; recency adds a third rank; relevance and confidence are blended at the end.
    """
    terms = queries.select("query", recall_terms(F.col("text")).alias("terms"))
    lex = commits.kept(corpus.index.search(terms, 2 * limit, {"title": 1.0, "content": 1.0}).select("query", "id", F.col("score").alias("lex")), "lexical")
    vec = commits.kept(corpus.near(queries, 2 * limit).drop("rank"), "nearest")
    pool = lex.select("query", "id").union(vec.select("query", "id")).distinct()
    # the pool is small: only its entries are tokenised, and only its pairs get a cosine where the vector leg has none
    whole = F.concat_ws(" ", "title", "content")
    tokens = entries.join(pool.select("id").distinct(), "id", "left_semi").withColumns({"whole": whole, "_e": content_tokens(whole)})
    asked = queries.select("query", content_tokens(F.col("text")).alias("_q"), identifiers(F.col("text")).alias("_i"))
    q = dense(hashed(queries.select(F.col("query").alias("id"), "text"), "text")).toDF("query", "qv")
    pairs = pool.join(corpus.vectors(), "id").join(q, "query").select("query", "id", F.round(vectors.cosine("v", "qv"), 6).alias("cosine"))
    pool = pool.join(tokens, "id").join(small(asked, 1_000), "query").join(pairs, ["query", "id"], "left")
    admitted = pool.where(hybrid.admits(strong_tokens(F.col("_q"), F.col("_e"), F.col("_i"), F.col("whole")), F.sqrt(2 * (1 - F.least("cosine", F.lit(1.0)))), (2 * (1 - floor)) ** 0.5 + 1e-9))
    keys = commits.kept(admitted.select("query", "id", "cosine", F.round(memory.access_recency(F.lit(now), half_life), 9).alias("recency"), F.round(memory.confidence(F.lit(now)), 9).alias("confidence")), "admitted")
    inside = lambda leg: leg.join(keys.select("query", "id"), ["query", "id"], "left_semi")
    legs = [(inside(lex), [F.desc("lex"), F.col("id")], hybrid.LEXICAL_WEIGHT), (inside(vec), [F.desc("cosine"), F.col("id")], hybrid.VECTOR_WEIGHT), (keys.where("recency > 0").select("query", "id", "recency"), [F.desc("recency"), F.col("id")], 1.0)]
    fused = hybrid.normalize(hybrid.rrf(legs, per="query"), "score", ["query"]).join(keys, ["query", "id"])
    fused = fused.withColumn("score", F.round(memory.final_score(F.col("score"), F.col("confidence")), 6))
    return top(fused, limit, F.desc("score"), F.col("id")).select("query", "id", "score", "cosine", "rank")


CHUNK = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("content", T.StringType())]))


def markdown_chunks(max_tokens: int = 400):
    """UDF: a Markdown text as chunks under heading paths ``A > B``; chunks below a quarter of the limit join the one before."""

    def size(text: str) -> int:
        return len(text.split())

    def cut(text: str) -> list[tuple[int, str, str]]:
        stack: list[tuple[int, str]] = []
        parts: list[list] = [["", []]]
        fence = False
        for line in (text or "").split("\n"):
            fence ^= line.lstrip().startswith("```")
            level = len(line) - len(line.lstrip("#"))
            if not fence and 1 <= level <= 6 and line[level : level + 1] == " ":
                stack = [s for s in stack if s[0] < level] + [(level, line[level:].strip())]
                parts.append([" > ".join(s[1] for s in stack), [line]])
            else:
                if size("\n".join(parts[-1][1])) + size(line) > max_tokens and parts[-1][1]:
                    parts.append([parts[-1][0], []])
                parts[-1][1].append(line)
        chunks: list[list] = []
        for heading, lines in parts:
            body = "\n".join(lines).strip("\n")
            if not body.strip():
                continue
            if chunks and size(body) < max_tokens // 4 and size(chunks[-1][1]) + size(body) <= max_tokens:
                chunks[-1][1] += "\n" + body
            else:
                chunks.append([heading, body])
        return [(i, h, b) for i, (h, b) in enumerate(chunks)]

    return F.udf(cut, CHUNK, useArrow=False)  # an Arrow batch would hold ten thousand texts and all their chunks at once


def fixed_chunks(max_tokens: int = 200, overlap: int = 40):
    """UDF: windows of whole lines of about ``max_tokens`` words; each begins with the last lines of the one before, ``overlap`` words at most."""

    def cut(text: str) -> list[tuple[int, str, str]]:
        lines = (text or "").split("\n")
        n = [len(x.split()) for x in lines]
        out, at = [], 0
        while at < len(lines):
            to, total = at, 0
            while to < len(lines) and (to == at or total + n[to] <= max_tokens):
                total += n[to]
                to += 1
            body = "\n".join(lines[at:to])
            if body.strip():
                out.append((len(out), "", body))
            if to >= len(lines):
                break
            back, kept = to, 0
            while back > at + 1 and kept + n[back - 1] <= overlap:
                back -= 1
                kept += n[back]
            at = back
        return out

    return F.udf(cut, CHUNK, useArrow=False)  # an Arrow batch would hold ten thousand texts and all their chunks at once


def session_chunks(turns: DataFrame, size: int = 10, overlap: int = 2, least_user: int = 3) -> DataFrame:
    """``(conv_id, start, n, text)``: windows of turns of conversations with enough user turns; conversations up to ``size`` turns are one window."""
    user = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count("*").alias("n")).where(F.col("u") >= least_user)
    placed = turns.join(user.select("conv_id", "n"), "conv_id").withColumn("p", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    step = size - overlap
    last = F.floor(F.col("p") / step) * step
    starts = F.when(F.col("n") <= size, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.array(last, last - step), lambda s: (s >= 0) & (F.col("p") - s < size)))
    each = placed.select("conv_id", "role", "text", "p", F.explode(starts).alias("start"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return each.groupBy("conv_id", "start").agg(F.count("*").alias("n"), body.alias("text"))  # at most ``size`` turns for each window
