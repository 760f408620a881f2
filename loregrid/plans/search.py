"""Retrieval (RET) and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as S, vectors as V
from ..storage import commits
from .filters import _CURRENT, _VISIBLE, current, visible
from .catalog import query
from .relational import _SHINGLES, _TOK
from .scalars import _CONF, _RECENCY
from .tables import NOW


def _bm25(table: str, fields: dict[str, float], terms: str, where: str = "true") -> str:
    """CTEs ``q``-based BM25 over ``table``: ends in ``lex(query, id, lex, matched, asked)``."""
    f = " UNION ALL ".join(f"SELECT id, '{c}' AS field, {_TOK.format(c)} AS w FROM {table} WHERE {where}" for c in fields)
    weight = "CASE p.field " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in fields.items()) + " END"
    return f"""t AS ({terms}), f AS ({f}), st AS (SELECT field, avg(len(w)) AS avgl FROM f GROUP BY field), nn AS (SELECT count(*) AS n FROM {table} WHERE {where}),
    p AS (SELECT id, field, term, count(*) AS tf, any_value(len) AS len FROM (SELECT id, field, len(w) AS len, unnest(w) AS term FROM f) AS x GROUP BY id, field, term),
    df AS (SELECT term, count(DISTINCT id) AS df FROM p GROUP BY term),
    lex AS (SELECT query, p.id, round(sum({weight} * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgl))), 6) AS lex, count(DISTINCT p.term) AS matched, max(asked) AS asked
      FROM p JOIN t ON t.term = p.term JOIN df ON df.term = p.term JOIN st ON st.field = p.field, nn GROUP BY query, p.id)"""


def _terms(where: str) -> str:
    return f"SELECT item_id AS query, unnest(list_distinct({_TOK.format('text')})) AS term, len(list_distinct({_TOK.format('text')})) AS asked FROM benchmark WHERE {where}"


def _hashed(source: str, name: str) -> str:
    h = "('0x' || substr(md5(w), 1, 15))::BIGINT"
    return f"""{name}w AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest({_TOK.format('text')}) AS w FROM ({source}) AS s) AS x GROUP BY id, w),
    {name} AS (SELECT id, {h} % 64 AS bucket, sum(CASE WHEN ({h} // 64) % 2 = 0 THEN tf ELSE -tf END)::DOUBLE AS v FROM {name}w GROUP BY ALL HAVING sum(CASE WHEN ({h} // 64) % 2 = 0 THEN tf ELSE -tf END) <> 0)"""


_COS = """cosines AS (SELECT qv.id AS query, dv.id AS id, round(sum(dv.v * qv.v) / (any_value(nd) * any_value(nq)), 6) AS cosine FROM dv JOIN qv ON dv.bucket = qv.bucket
    JOIN (SELECT id, sqrt(sum(v * v)) AS nd FROM dv GROUP BY id) AS a ON a.id = dv.id JOIN (SELECT id, sqrt(sum(v * v)) AS nq FROM qv GROUP BY id) AS b ON b.id = qv.id GROUP BY qv.id, dv.id)"""


def _corpus(t, name: str, rows, fields: list[str], embed: bool = True):
    """The corpus of a table, under a name that changes with the driver's files: written by the first query that needs it."""
    paths = [f"{t.sf_dir}/{x}.parquet" for x in ("documents", "labels")]
    root = f"{commits.shared_dir(t.spark)}/corpora/{name}-{commits.fingerprint(t.spark, *paths)}"
    return S.Corpus(t.spark, root, fields, [f for f in fields if f in ("title", "body", "content")]).add(rows, "all", embed)


def _docs(t, embed: bool = False):
    return _corpus(t, "docs", t.docs.where(current()), ["title", "body"], embed)


@query("RET01", f"WITH {_bm25('docs', {'title': 10.0, 'body': 1.0}, _terms('true'), _CURRENT)} SELECT query, id, lex AS score FROM lex QUALIFY row_number() OVER (PARTITION BY query ORDER BY lex DESC, id) <= 10")
def _(t):
    q = t.benchmark.select(F.col("item_id").alias("query"), F.array_distinct(X.content_tokens(F.col("text"))).alias("terms"))
    return _docs(t).index.search(q, 10, {"title": 10.0, "body": 1.0}).drop("rank")


_AND = "SELECT 0 AS query, unnest(['the', 'tion', 'ering'][1:2]) AS term, 2 AS asked UNION ALL SELECT 1, 'note', 1"


@query("RET01_and", f"WITH {_bm25('docs', {'title': 10.0, 'body': 1.0}, _AND, _CURRENT)} SELECT query, id, lex AS score FROM lex WHERE matched = asked QUALIFY row_number() OVER (PARTITION BY query ORDER BY lex DESC, id) <= 10")
def _(t):
    q = t.spark.range(2).select(F.col("id").cast("int").alias("query"), F.when(F.col("id") == 0, F.array(F.lit("the"), F.lit("tion"))).otherwise(F.array(F.lit("note"))).alias("terms"))
    return _docs(t).index.search(q, 10, {"title": 10.0, "body": 1.0}, require_all=True).drop("rank")


@query("RET02", f"WITH {_bm25('memory', {'id': 1.0, 'title': 1.0, 'content': 1.0, 'tags': 1.0}, _terms('true'))} SELECT query, id, lex AS score FROM lex QUALIFY row_number() OVER (PARTITION BY query ORDER BY lex DESC, id) <= 10")
def _(t):
    q = t.benchmark.select(F.col("item_id").alias("query"), F.array_distinct(X.content_tokens(F.col("text"))).alias("terms"))
    fields = ["key", "title", "content", "tags"]  # an entry's id is a field and names the row
    corpus = _corpus(t, "memory", t.memory.select("id", F.col("id").alias("key"), "title", "content", "tags"), fields, False)
    return corpus.index.search(q, 10, dict.fromkeys(fields, 1.0)).drop("rank")


@query("RET03", "SELECT q.vec_id AS query, e.vec_id AS id, round(1 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id < 3 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), e.vec_id) <= 10")
def _(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.knn(v, v.where("id < 3").toDF("query", "q"), 10).select("query", "id", F.round(1 - F.col("distance"), 6).alias("score"))


@query("RET04", "SELECT vec_id % 120 AS doc_id, round(min(round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 11)), 6)), 6) AS distance FROM embeddings GROUP BY vec_id % 120 ORDER BY distance, doc_id LIMIT 10")
def _(t):
    q = t.embeddings.where("vec_id = 11").select(F.col("embedding").alias("q"))
    d = t.embeddings.crossJoin(F.broadcast(q)).select((F.col("vec_id") % 120).alias("doc_id"), F.round(V.l2("embedding", "q"), 6).alias("d"))
    return d.groupBy("doc_id").agg(F.min("d").alias("distance")).orderBy("distance", "doc_id").limit(10)


@query("RET05", f"""WITH {_bm25('docs', {'title': 10.0, 'body': 1.0}, _terms('true'), _CURRENT)}, {_hashed(f"SELECT id, concat_ws(' ', title, body) AS text FROM docs WHERE {_CURRENT}", 'dv')}, {_hashed("SELECT item_id AS id, text FROM benchmark", 'qv')}, {_COS},
    l AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY lex DESC, id) AS r FROM lex QUALIFY r <= 20), v AS (SELECT query, id, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS r FROM cosines QUALIFY r <= 20),
    s AS (SELECT query, id, sum(s) AS s FROM (SELECT query, id, 1.0::DOUBLE / (60 + r) AS s FROM l UNION ALL SELECT query, id, 0.7::DOUBLE / (60 + r) FROM v) AS u GROUP BY query, id), z AS (SELECT query, id, round(s / max(s) OVER (PARTITION BY query), 6) AS score FROM s)
    SELECT z.query, z.id, score, cosine, row_number() OVER (PARTITION BY z.query ORDER BY score DESC, z.id) AS rank FROM z LEFT JOIN v ON v.query = z.query AND v.id = z.id QUALIFY rank <= 10""")
def _(t):
    q = t.benchmark.select(F.col("item_id").alias("query"), "text")
    return S.hybrid_documents(_docs(t, True), q, 10).withColumn("rank", F.col("rank").cast("long"))


_LIVE = f"status = 'active' AND {_VISIBLE}"
_RECALL = f"""SELECT query, term, 0 AS asked FROM (SELECT item_id AS query, w[i] AS term, min(i) AS i FROM (SELECT item_id, {_TOK.format('text')} AS w FROM benchmark) AS b, unnest(range(1, len(w) + 1)) AS u(i) GROUP BY item_id, w[i]) AS d
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY octet_length(encode(term)) DESC, i) <= 32"""
_IDS = r"list_transform(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')), lambda w: octet_length(encode(w)) >= 3 AND (regexp_matches(w, '[_.\p{N}]|::') OR (regexp_matches(w, '\p{Ll}') AND regexp_matches(w, '^.+\p{Lu}')))), lambda w: lower(w))"


@query("RET06", f"""WITH {_bm25('memory', {'title': 1.0, 'content': 1.0}, _RECALL, _LIVE)}, {_hashed(f"SELECT id, concat_ws(' ', title, content) AS text FROM memory WHERE {_LIVE}", 'dv')}, {_hashed("SELECT item_id AS id, text FROM benchmark", 'qv')}, {_COS},
    l AS (SELECT query, id, lex FROM lex QUALIFY row_number() OVER (PARTITION BY query ORDER BY lex DESC, id) <= 10), v AS (SELECT query, id, cosine FROM cosines QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) <= 10),
    qt AS (SELECT item_id AS query, {_TOK.format('text')} AS q, {_IDS} AS ids FROM benchmark), et AS (SELECT id, {_TOK.format('whole')} AS e, lower(whole) AS low, round({_RECENCY}, 9) AS recency, round({_CONF}, 9) AS confidence FROM (SELECT *, concat_ws(' ', title, content) AS whole FROM memory WHERE {_LIVE}) AS m),
    k AS (SELECT p.query, p.id, coalesce(c.cosine, 0) AS cosine, recency, confidence FROM (SELECT query, id FROM l UNION SELECT query, id FROM v) AS p JOIN qt ON qt.query = p.query JOIN et ON et.id = p.id LEFT JOIN cosines c ON c.query = p.query AND c.id = p.id
      WHERE len(list_filter(ids, lambda x: contains(low, x))) > 0 OR list_has_any({_SHINGLES.format('q')}, {_SHINGLES.format('e')}) OR len(list_filter(list_distinct(list_intersect(q, e)), lambda w: octet_length(encode(w)) >= 7)) >= 2 OR sqrt(2 * (1 - least(coalesce(c.cosine, 0), 1))) <= sqrt(1.2::DOUBLE) + 1e-9),
    fused AS (SELECT query, id, sum(s) AS s FROM (SELECT l.query, l.id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY l.query ORDER BY lex DESC, l.id)) AS s FROM l JOIN k ON k.query = l.query AND k.id = l.id
      UNION ALL SELECT v.query, v.id, 0.7::DOUBLE / (60 + row_number() OVER (PARTITION BY v.query ORDER BY v.cosine DESC, v.id)) FROM v JOIN k ON k.query = v.query AND k.id = v.id
      UNION ALL SELECT query, id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query ORDER BY recency DESC, id)) FROM k WHERE recency > 0) AS u GROUP BY query, id),
    z AS (SELECT fused.query, fused.id, round(0.7 * (s / max(s) OVER (PARTITION BY fused.query)) + 0.3 * confidence, 6) AS score, cosine FROM fused JOIN k ON k.query = fused.query AND k.id = fused.id)
    SELECT query, id, score, cosine, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM z QUALIFY rank <= 5""")
def _(t):
    q = t.benchmark.select(F.col("item_id").alias("query"), "text")
    live = t.memory.where((F.col("status") == "active") & visible())
    return S.recall(_corpus(t, "live-memory", live, ["title", "content"]), live, q, 5, NOW, 0.40).withColumn("rank", F.col("rank").cast("long"))


@query("RET07", "SELECT prompt_id, rank, rank = 0 OR coalesce(sqrt(2 * (1 - cosine)) <= sqrt(1.2::DOUBLE), false) AS admitted FROM recall_candidates")
def _(t):
    from ..operators.hybrid import admits

    return t.recall_candidates.select("prompt_id", "rank", admits(F.col("rank") == 0, F.sqrt(2 * (1 - F.col("cosine"))), 1.2**0.5).alias("admitted"))


@query("RET08", f"WITH q AS (SELECT {_TOK.format('text')} AS q FROM benchmark WHERE item_id = 0), m AS (SELECT id, {_TOK.format('content')} AS e, round({_RECENCY}, 9) AS r FROM memory), a AS (SELECT id, r FROM m, q WHERE list_has_any({_SHINGLES.format('q')}, {_SHINGLES.format('e')}) OR len(list_filter(list_distinct(list_intersect(q, e)), lambda w: octet_length(encode(w)) >= 7)) >= 2) SELECT id, round(1.0 / row_number() OVER (ORDER BY r DESC, id), 6)::DOUBLE AS score FROM a QUALIFY row_number() OVER (ORDER BY r DESC, id) <= 50")
def _(t):
    from pyspark.sql import Window as W

    from ..operators.memory import access_recency

    q = t.benchmark.where("item_id = 0").select(X.content_tokens(F.col("text")).alias("q"), X.identifiers(F.col("text")).alias("ids"))
    # a text is split once: the words come out of a generator, or each of the expressions over them would split it again
    e = t.memory.withColumn("e", F.explode(F.array(X.content_tokens(F.col("content")))))
    m = e.crossJoin(F.broadcast(q)).where(X.strong_tokens(F.col("q"), F.col("e"), F.col("ids"), F.col("content")))
    ranked = m.select("id", F.round(access_recency(F.lit(NOW), 14 * 86_400), 9).alias("r")).orderBy(F.desc("r"), "id").limit(50)
    return ranked.select("id", F.round(1.0 / F.row_number().over(W.orderBy(F.desc("r"), "id")), 6).alias("score"))


@query("RET09", "SELECT c.prompt_id, c.entry_id, round(CASE WHEN c.cosine IS NOT NULL THEN sqrt(2 * (1 - c.cosine)) ELSE list_distance(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) END, 6) AS distance FROM recall_candidates c LEFT JOIN embeddings e ON concat('m-', CAST(e.vec_id AS STRING)) = c.entry_id")
def _(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    stored = t.embeddings.crossJoin(F.broadcast(q)).select(F.concat(F.lit("m-"), F.col("vec_id").cast("string")).alias("entry_id"), V.l2("embedding", "q").alias("d"))
    return t.recall_candidates.join(stored, "entry_id", "left").select("prompt_id", "entry_id", F.round(F.coalesce(F.sqrt(2 * (1 - F.col("cosine"))), "d"), 6).alias("distance"))


@query("RET10", "SELECT prompt_id, entry_id, round(cosine, 6) AS score FROM recall_candidates WHERE rank < 5 AND cosine >= 0.45")
def _(t):
    from ..operators.rerank import rerank

    pool = t.recall_candidates.where("rank < 5").select("prompt_id", "entry_id", F.coalesce("cosine", F.lit(0.0)).alias("evidence"))
    return rerank(pool, lambda pdf: pdf["evidence"], 0.45).select("prompt_id", "entry_id", F.round("score", 6).alias("score"))


@query("RET11", "SELECT s.id, s.name, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 5)), 6) AS score FROM symbols s JOIN embeddings e ON e.vec_id = s.id WHERE s.kind = 'function' AND list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 5)) >= 0.1 ORDER BY score DESC, s.id LIMIT 10")
def _(t):
    q = t.embeddings.where("vec_id = 5").select(F.col("embedding").alias("q"))
    f = t.symbols.where("kind = 'function'").select("id", "name").join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id").crossJoin(F.broadcast(q))
    return f.select("id", "name", V.cosine("embedding", "q").alias("c")).where("c >= 0.1").select("id", "name", F.round("c", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("RET12", "SELECT a.rowid AS new, 'title' AS evidence, min(b.rowid) AS old FROM memory a JOIN memory b ON a.title = b.title AND b.rowid < a.rowid WHERE a.rowid >= 700 GROUP BY a.rowid UNION ALL SELECT a.vec_id, 'vector', min(b.vec_id) FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 0.32 GROUP BY a.vec_id")
def _(t):
    a = t.memory.where("rowid >= 700").select(F.col("rowid").alias("new"), "title")
    first = t.memory.groupBy("title").agg(F.min("rowid").alias("old"))  # the least of a title is the least before any other, so no pairs are made
    same = a.join(first, "title").where("old < new").groupBy("new").agg(F.min("old").alias("old")).select("new", F.lit("title").alias("evidence"), "old")
    pairs = V.cosine_pairs(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 1 - 0.32**2 / 2 - 1e-6)
    e = t.embeddings.select("vec_id", "embedding")
    near = pairs.join(e.toDF("a", "va"), "a").join(e.toDF("b", "vb"), "b").where(V.l2("va", "vb") < 0.32).groupBy(F.col("b").alias("new")).agg(F.min("a").alias("old"))
    return same.unionByName(near.select("new", F.lit("vector").alias("evidence"), "old"))


@query("RET13", f"SELECT id, 'due' AS part FROM memory WHERE entry_type = 'reminder' AND status = 'active' AND due_at <= {NOW} UNION ALL SELECT id, 'warm' FROM (SELECT id FROM memory WHERE status = 'active' AND entry_type <> 'reminder' ORDER BY access_count DESC, id LIMIT 10) AS w")
def _(t):
    live = t.memory.where("status = 'active'")
    due = live.where(f"entry_type = 'reminder' AND due_at <= {NOW}").select("id", F.lit("due").alias("part"))
    return due.unionByName(live.where("entry_type <> 'reminder'").orderBy(F.desc("access_count"), "id").limit(10).select("id", F.lit("warm").alias("part")))


@query("RET14", "SELECT * FROM (SELECT collection AS repo, id, length(body) AS score FROM docs WHERE collection IN ('src1', 'src2', 'src4') AND contains(body, 'en') UNION ALL SELECT 'memory', rowid, length(content) FROM memory WHERE contains(content, 'token')) AS u ORDER BY score DESC, repo, id LIMIT 30")
def _(t):
    d = t.docs.where(F.col("collection").isin("src1", "src2", "src4") & F.contains("body", F.lit("en"))).select(F.col("collection").alias("repo"), "id", F.length("body").cast("long").alias("score"))
    m = t.memory.where(F.contains("content", F.lit("token"))).select(F.lit("memory").alias("repo"), F.col("rowid").alias("id"), F.length("content").cast("long").alias("score"))
    return d.unionByName(m).orderBy(F.desc("score"), "repo", "id").limit(30)


@query("RET15")
def _(t):
    md = F.concat(F.lit("# "), "title", F.lit("\n"), F.regexp_replace("body", r"\n", "\n## part\n"))
    return t.docs.select("id", F.explode(S.markdown_chunks(200)(md)).alias("c")).select("id", "c.index", "c.heading", "c.content")


@query("RET16")
def _(t):
    return t.docs.select("id", F.explode(S.fixed_chunks(200, 40)(F.col("body"))).alias("c")).select("id", "c.index", "c.content")


@query("RET17", "SELECT conv_id, 0::BIGINT AS start, count(*) AS n, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS text FROM turns WHERE conv_id IN (SELECT conv_id FROM turns GROUP BY conv_id HAVING count(*) FILTER (role = 'user') >= 3) GROUP BY conv_id")
def _(t):
    return S.session_chunks(t.turns)  # conversations of the driver have 8 turns at most: one window each


@query("RET18", f"WITH {_hashed('SELECT id, body AS text FROM docs', 'dv')} SELECT id, bucket, v FROM dv WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    done = t.embeddings.select(F.col("vec_id").alias("id"))
    return S.hashed(t.docs.select("id", F.col("body").alias("text")).join(done, "id", "left_anti"), "text")
