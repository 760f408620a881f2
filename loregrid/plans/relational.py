"""Joins, aggregates, windows, top-k and set operations (JOI, AGG, WIN, TOP, SET)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as X
from ..operators import relational as R
from ..storage import commits
from .filters import _CURRENT, current, visible
from .catalog import query
from .tables import DAY, NOW

_TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "], w))"
_SHINGLES = "list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2])"
_HITS = "SELECT doc_id, length(text) - length(replace(text, 'en', '')) AS score FROM documents WHERE contains(text, 'en')"


def _hits(t):
    return t.documents.where(F.col("text").contains("en")).select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("en"), F.lit("")))).cast("long").alias("score"))


@query("JOI01", f"SELECT h.doc_id, score, path FROM ({_HITS}) AS h JOIN docs ON docs.id = h.doc_id WHERE {_CURRENT}")
def _(t):
    return _hits(t).join(t.docs.where(current()).select(F.col("id").alias("doc_id"), "path"), "doc_id")


@query("JOI02", f"SELECT h.doc_id AS rowid, m.id, m.title FROM ({_HITS}) AS h JOIN memory m ON m.rowid = h.doc_id WHERE m.entry_type = 'decision'")
def _(t):
    return _hits(t).select(F.col("doc_id").alias("rowid")).join(t.memory.where("entry_type = 'decision'").select("rowid", "id", "title"), "rowid")


@query("JOI03", """SELECT d.id, s.path AS superseded_by FROM docs d LEFT JOIN (SELECT target_doc_id, arg_max(p.path, e.created_at) AS path FROM evolution e JOIN docs p ON p.id = e.source_doc_id WHERE relationship = 'supersedes' GROUP BY target_doc_id) AS s ON s.target_doc_id = d.id""")
def _(t):
    newer = t.docs.select(F.col("id").alias("source_doc_id"), "path")
    by = t.evolution.where("relationship = 'supersedes'").join(newer, "source_doc_id").groupBy(F.col("target_doc_id").alias("id")).agg(F.max_by("path", "created_at").alias("superseded_by"))
    return t.docs.select("id").join(by, "id", "left")


_CHUNKS = "SELECT vec_id % 120 AS doc_id, vec_id, CAST(round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS DOUBLE) AS sim FROM embeddings"


def _chunks(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("q"))
    sim = F.expr("aggregate(zip_with(v, q, (x, y) -> x * y), 0D, (a, x) -> a + x)")
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).crossJoin(F.broadcast(q)).select((F.col("vec_id") % 120).alias("doc_id"), "vec_id", F.round(sim, 6).alias("sim"))


@query("JOI04", f"SELECT c.doc_id, path, max(sim) AS best FROM ({_CHUNKS}) AS c JOIN docs ON docs.id = c.doc_id GROUP BY c.doc_id, path")
def _(t):
    return _chunks(t).groupBy("doc_id").agg(F.max("sim").alias("best")).join(t.docs.select(F.col("id").alias("doc_id"), "path"), "doc_id")


@query("JOI05", f"SELECT vec_id, sim FROM ({_CHUNKS}) AS c WHERE doc_id IN (SELECT id FROM docs WHERE collection = 'src7')")
def _(t):
    return _chunks(t).join(t.docs.where("collection = 'src7'").select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("vec_id", "sim")


_LEGS = "SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY access_count DESC, id)) AS s FROM memory WHERE access_count > 3 UNION ALL SELECT id, 0.7 / (60 + row_number() OVER (ORDER BY updated_at DESC, id)) FROM memory WHERE updated_at > 1701000000"


@query("JOI06", f"SELECT id, round(sum(s), 9)::DOUBLE AS score FROM ({_LEGS}) AS l GROUP BY id")
def _(t):
    from ..operators.hybrid import rrf

    a = t.memory.where("access_count > 3").orderBy(F.desc("access_count"), "id").select("id", "access_count")
    b = t.memory.where("updated_at > 1701000000").select("id", "updated_at")
    return rrf([(a, [F.desc("access_count"), F.col("id")], 1.0), (b, [F.desc("updated_at"), F.col("id")], 0.7)]).select("id", F.round("score", 9).alias("score"))


@query("JOI07", "SELECT r.id AS edge, f.id AS caller, s.id AS callee FROM relationships r JOIN symbols f ON f.id = r.from_symbol_id JOIN symbols s ON s.name = r.to_name AND s.kind IN ('function', 'method') WHERE r.kind = 'Calls'")
def _(t):
    callee = t.symbols.where("kind IN ('function', 'method')").select(F.col("id").alias("callee"), F.col("name").alias("to_name"))
    calls = t.relationships.where("kind = 'Calls'").select(F.col("id").alias("edge"), F.col("from_symbol_id").alias("caller"), "to_name")
    calls = commits.kept(calls.join(t.symbols.select(F.col("id").alias("caller")), "caller"), "calls")
    return R.many_to_many(calls, callee, "to_name").select("edge", "caller", "callee")


@query("JOI08", "SELECT r.id AS edge, r.to_name, count(s.id) AS candidates FROM relationships r LEFT JOIN symbols s ON s.name = r.to_name AND s.kind IN ('function', 'method') GROUP BY r.id, r.to_name")
def _(t):
    n = t.symbols.where("kind IN ('function', 'method')").groupBy(F.col("name").alias("to_name")).agg(F.count("*").alias("c"))
    return t.relationships.select(F.col("id").alias("edge"), "to_name").join(n, "to_name", "left").select("edge", "to_name", F.coalesce("c", F.lit(0)).alias("candidates"))


@query("JOI09", "SELECT s.id, r.file_id, EXISTS (SELECT 1 FROM imports i WHERE i.file_id = r.file_id AND (i.path = s.module_path OR i.path = concat(s.module_path, '::', s.name))) AS imported FROM symbols s JOIN (SELECT DISTINCT file_id FROM relationships) AS r ON r.file_id = s.id % 97")
def _(t):
    files = t.relationships.select("file_id").distinct()
    pairs = t.symbols.select("id", "name", "module_path", (F.col("id") % 97).alias("file_id")).join(files, "file_id")
    keys = pairs.select("id", "file_id", F.explode(F.array("module_path", F.concat("module_path", F.lit("::"), "name"))).alias("path"))
    seen = keys.join(t.imports, ["file_id", "path"], "left_semi").select("id", "file_id").distinct().withColumn("imported", F.lit(True))
    return pairs.select("id", "file_id").join(seen, ["id", "file_id"], "left").select("id", "file_id", F.coalesce("imported", F.lit(False)).alias("imported"))


@query("JOI10", "SELECT id, to_receiver_call FROM relationships r WHERE to_receiver_call IS NOT NULL AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.name = r.to_receiver_call)")
def _(t):
    names = t.symbols.select(F.col("name").alias("to_receiver_call")).distinct()
    return t.relationships.where("to_receiver_call is not null").join(names, "to_receiver_call", "left_anti").select("id", "to_receiver_call")


_CONNECTED = "SELECT DISTINCT least(f.file_path, s.file_path) AS file_a, greatest(f.file_path, s.file_path) AS file_b FROM relationships r JOIN symbols f ON f.id = r.from_symbol_id JOIN symbols s ON s.name = r.to_name WHERE f.file_path <> s.file_path AND s.kind IN ('function', 'method')"


def connected_pairs(t):
    a = t.symbols.select(F.col("id").alias("from_symbol_id"), F.col("file_path").alias("a"))
    b = t.symbols.where("kind IN ('function', 'method')").select(F.col("name").alias("to_name"), F.col("file_path").alias("b")).distinct()
    ends = t.relationships.join(a, "from_symbol_id").select("to_name", "a").distinct().join(b, "to_name").where("a <> b")
    return ends.select(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b")).distinct()


@query("JOI11", _CONNECTED)
def _(t):
    return connected_pairs(t)


_COCHANGE = "SELECT a.path AS file_a, b.path AS file_b, count(*) AS n FROM (SELECT DISTINCT commit_id, path FROM commits WHERE commit_id IN (SELECT commit_id FROM commits GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)) AS a JOIN (SELECT DISTINCT commit_id, path FROM commits WHERE commit_id IN (SELECT commit_id FROM commits GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)) AS b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL"


@query("JOI12", f"WITH cc AS ({_COCHANGE}) SELECT * FROM cc WHERE n >= 3 AND NOT EXISTS (SELECT 1 FROM commits k WHERE k.commit_id % 50 = 0 AND k.path = cc.file_a)")
def _(t):
    linked = t.commits.where("commit_id % 50 = 0").select(F.col("path").alias("file_a")).distinct()
    return R.cochange(t.commits, most_files=8).where("n >= 3").join(linked, "file_a", "left_anti")


@query("JOI13", "SELECT a.path AS file_a, b.path AS file_b, count(*) AS n FROM (SELECT DISTINCT commit_id, path FROM commits) AS a JOIN (SELECT DISTINCT commit_id, path FROM commits) AS b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL HAVING count(*) >= 2")
def _(t):
    return R.cochange(t.commits, most_files=None).where("n >= 2")


@query("JOI14", "SELECT DISTINCT least(e.source_id, e.target_ref) AS a, greatest(e.source_id, e.target_ref) AS b FROM memory_edges e JOIN memory x ON x.id = e.source_id JOIN memory y ON y.id = e.target_ref WHERE e.relation = 'contradicts' AND x.status = 'active' AND y.status = 'active'")
def _(t):
    live = t.memory.where("status = 'active'").select("id")
    e = t.memory_edges.where("relation = 'contradicts'").join(live.withColumnRenamed("id", "source_id"), "source_id").join(live.withColumnRenamed("id", "target_ref"), "target_ref")
    return e.select(F.least("source_id", "target_ref").alias("a"), F.greatest("source_id", "target_ref").alias("b")).distinct()


@query("JOI15", "SELECT DISTINCT source_id FROM memory_edges WHERE relation = 'depends_on' AND target_ref IN (SELECT id FROM memory WHERE status = 'superseded' OR corrections > confirmations)")
def _(t):
    stale = t.memory.where("status = 'superseded' OR corrections > confirmations").select(F.col("id").alias("target_ref"))
    return t.memory_edges.where("relation = 'depends_on'").join(stale, "target_ref", "left_semi").select("source_id").distinct()


@query("JOI16", "SELECT c.prompt_id, c.entry_id, p.session, coalesce(m.title, '') AS title FROM recall_candidates c JOIN recall_prompts p ON p.id = c.prompt_id LEFT JOIN memory m ON m.id = c.entry_id WHERE c.outcome IS NULL")
def _(t):
    p = t.recall_prompts.select(F.col("id").alias("prompt_id"), "session")
    return t.recall_candidates.where("outcome is null").join(p, "prompt_id").join(t.memory.select(F.col("id").alias("entry_id"), "title"), "entry_id", "left").select("prompt_id", "entry_id", "session", F.coalesce("title", F.lit("")).alias("title"))


_BAND = 3 * 3600


@query("JOI17", f"SELECT id, query_hash FROM query_events a WHERE EXISTS (SELECT 1 FROM query_events b WHERE b.query_hash = a.query_hash AND b.id <> a.id AND abs(b.created_at - a.created_at) <= {_BAND})")
def _(t):
    return R.band_semi_join(t.query_events, "query_hash", "created_at", _BAND, "id").select("id", "query_hash")


@query("JOI18", "SELECT c.id, m.id AS entry, (SELECT max(injected_at) FROM injections i WHERE i.cluster_id = c.id) AS last_injected FROM clusters c JOIN memory m ON m.rowid = c.n WHERE c.state = 'promoted' AND m.status = 'active'")
def _(t):
    last = t.injections.groupBy(F.col("cluster_id").alias("id")).agg(F.max("injected_at").alias("last_injected"))
    live = t.memory.where("status = 'active'").select(F.col("rowid").alias("n"), F.col("id").alias("entry"))
    return t.clusters.where("state = 'promoted'").join(live, "n").join(last, "id", "left").select("id", "entry", "last_injected")


@query("JOI19", "SELECT DISTINCT m.id, e.session_id FROM memory m JOIN calls e ON contains(m.title, concat(' ', CAST(e.tokens AS STRING))) AND m.entry_type = 'reminder' WHERE e.tool = 'signup' AND NOT EXISTS (SELECT 1 FROM injections i WHERE i.session = e.session_id AND i.cluster_id = concat('c-', CAST(m.rowid AS STRING)))")
def _(t):
    # a title holds " n" if n's digits begin one of its numbers that follow a space: equal strings meet, nothing is compared with all
    ctx = t.calls.where("tool = 'signup'").select("session_id", F.concat(F.lit(" "), F.col("tokens").cast("string")).alias("said")).distinct()
    m = t.memory.where("entry_type = 'reminder'").select("id", "title", F.concat(F.lit("c-"), F.col("rowid").cast("string")).alias("cluster_id")).distinct()
    titles = m.select("title").distinct()
    runs = titles.select("title", F.explode(F.regexp_extract_all("title", F.lit(r" -?\d+"), F.lit(0))).alias("run"))
    said = runs.select("title", F.explode(F.transform(F.sequence(F.lit(2), F.length("run")), lambda k: F.substring("run", F.lit(1), k))).alias("said")).distinct()
    # sessions meet titles, of which many entries have the same; the pairs with entries are made last and are distinct, for an entry has one title
    hit = commits.kept(ctx.join(said, "said").select("title", "session_id").distinct(), "hit")
    done = t.injections.select(F.col("session").alias("session_id"), "cluster_id").distinct()
    ever = m.join(done.select("cluster_id").distinct(), "cluster_id", "left_semi")
    never = m.join(done.select("cluster_id").distinct(), "cluster_id", "left_anti")
    checked = hit.join(ever, "title").join(done, ["session_id", "cluster_id"], "left_anti")
    # a session meets blocks of a title's entries, so a written result is runs of sessions, and no title is one task
    return R.many_to_many(hit, never.select("title", "id"), "title").select("id", "session_id").unionByName(checked.select("id", "session_id"))


@query("JOI20", "SELECT c.id, e.id AS event FROM clusters c JOIN calls e ON lower(c.tool) = e.tool WHERE c.state = 'promoted' AND c.trigger_kind = 'pre_tool' AND e.truncated = 1 AND (c.error_contains IS NULL OR contains(c.error_contains, 'E'))")
def _(t):
    c = t.clusters.where("state = 'promoted' AND trigger_kind = 'pre_tool' AND (error_contains IS NULL OR contains(error_contains, 'E'))").select("id", F.lower("tool").alias("tool"))
    return R.many_to_many(t.calls.where("truncated = 1").select(F.col("id").alias("event"), "tool"), c, "tool").select("id", "event")


_SIG = "list_distinct(list_transform(list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) > 1 AND NOT regexp_full_match(w, '[0-9]+')), lambda w: lower(w)))"


@query("JOI21", f"""WITH k AS (SELECT id, {_SIG.format('error_signature')} AS ks FROM clusters), e AS (SELECT session, at_s, {_SIG.format('signature')} AS es FROM errors)
    SELECT i.cluster_id, i.session, i.injected_at, coalesce(bool_or((e.at_s IS NULL OR e.at_s >= i.injected_at) AND len(list_intersect(ks, es)) / len(ks) >= 0.6), false) AS recurred FROM injections i JOIN k ON k.id = i.cluster_id LEFT JOIN e ON e.session = i.session WHERE i.outcome IS NULL GROUP BY ALL""")
def _(t):
    known = t.clusters.select(F.col("id").alias("cluster_id"), "error_signature")
    open_ = t.injections.where("outcome is null").select("cluster_id", "session", "injected_at").distinct().join(known, "cluster_id")
    # errors that differ only in numbers are one: the latest stands for all, an undated one counts always
    errs = t.errors.select("session", F.array_sort(X.signature_tokens(F.col("signature"))).alias("es"), "at_s").groupBy("session", "es").agg(F.max("at_s").alias("last"), F.count_if(F.col("at_s").isNull()).alias("undated"))
    k = X.signature_tokens(F.col("error_signature"))
    same = (F.size(k) > 0) & (F.size(F.array_intersect(k, F.col("es"))) / F.size(k) >= X.SIGNATURE_RATIO)
    hit = F.coalesce(same & ((F.col("undated") > 0) | (F.col("last") >= F.col("injected_at"))), F.lit(False))
    return open_.join(errs, "session", "left").groupBy("cluster_id", "session", "injected_at").agg(F.bool_or(hit).alias("recurred"))


@query("JOI22", "SELECT e.id, (SELECT max(p.created_at) FROM recall_prompts p WHERE p.session = e.session AND p.created_at <= e.at_s) AS prompt_at FROM errors e WHERE e.at_s IS NOT NULL")
def _(t):
    e = t.errors.where("at_s is not null").select("id", "session", "at_s")
    return R.asof_join(e, t.recall_prompts.select("session", F.col("created_at").alias("prompt_at"), F.col("created_at").alias("p")), "session", "at_s", "p", "prompt_at").select("id", "prompt_at")


@query("JOI23", "SELECT s.id, f.language FROM symbols s LEFT JOIN code_files f ON f.file_id = s.file_id AND f.language <> 'go' WHERE s.kind IN ('function', 'method') AND s.line_end - s.line_start + 1 >= 10")
def _(t):
    lang = t.code_files.where("language <> 'go'").select("file_id", "language")
    return t.symbols.where("kind IN ('function', 'method') AND line_end - line_start + 1 >= 10").join(lang, "file_id", "left").select("id", "language")


_FP = f"""(WITH w AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents), g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
    h AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 15))::BIGINT AS h FROM g), b AS (SELECT doc_id, {' + '.join(f'CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {1 << k}::BIGINT ELSE 0 END' for k in range(60))} AS fp FROM h GROUP BY doc_id)
    SELECT d.doc_id AS id, coalesce(fp, 0) AS fp FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id)"""


def text_fingerprints(t):
    """``(id, fp)``: fingerprints of all texts that SQL can make too."""
    from ..operators.duplication import fingerprinted, md5_60

    return fingerprinted(t.documents, "text", X.content_tokens, md5_60).select(F.col("doc_id").alias("id"), "fp")


@query("JOI24", f"WITH f AS MATERIALIZED (SELECT * FROM {_FP} AS x) SELECT a.id AS a, b.id AS b, bit_count(xor(a.fp, b.fp))::INT AS distance FROM f a JOIN f b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= 6")
def _(t):
    from ..operators.duplication import hamming_join

    return hamming_join(commits.kept(text_fingerprints(t), "fingerprints"), 6)


_COS = 0.45


@query("JOI25", f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {_COS}")
def _(t):
    from ..operators.vectors import cosine_pairs

    return cosine_pairs(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), _COS).select("a", "b")


@query("JOI26", f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45 JOIN memory x ON x.rowid = a.vec_id JOIN memory y ON y.rowid = b.vec_id WHERE x.status = 'active' AND y.status = 'active'")
def _(t):
    from ..operators.vectors import cosine_pairs

    live = t.memory.where("status = 'active'").select(F.col("rowid").alias("id"))
    return cosine_pairs(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).join(live, "id", "left_semi"), 0.45).select("a", "b")


@query("JOI27", "SELECT e.id, coalesce(d.path, concat('#', CAST(e.source_doc_id AS STRING))) AS source, e.target_ref FROM edges e LEFT JOIN docs d ON d.id = e.source_doc_id AND d.status IS NULL")
def _(t):
    paths = t.docs.where("status is null").select(F.col("id").alias("source_doc_id"), "path")
    return t.edges.join(paths, "source_doc_id", "left").select("id", F.coalesce("path", F.concat(F.lit("#"), F.col("source_doc_id").cast("string"))).alias("source"), "target_ref")


_RESOLVED = """SELECT e.id, coalesce((SELECT min(d.id) FROM docs d WHERE d.path = e.target_ref),
    (SELECT min(d.id) FROM docs d WHERE d.path = regexp_replace(e.target_ref, '^([.]/|/)+', '')),
    (SELECT min(d.id) FROM docs d WHERE d.path = concat(regexp_replace(regexp_replace(e.target_ref, '^([.]/|/)+', ''), '[.]md$', ''), '.md')),
    (SELECT min(a.doc_id) FROM aliases a WHERE a.alias = e.target_ref)) AS target FROM edges e"""


@query("JOI28", _RESOLVED)
def _(t):
    from ..operators.graph import resolve

    return resolve(t.edges.select("id", "target_ref"), t.docs, t.aliases).select("id", "target")


@query("JOI29", "SELECT c.id, k.state, k.n FROM candidates c LEFT JOIN clusters k ON k.id = c.cluster_id AND k.evidence_count > 10")
def _(t):
    k = t.clusters.where("evidence_count > 10").select(F.col("id").alias("cluster_id"), "state", "n")
    return t.candidates.join(k, "cluster_id", "left").select("id", "state", "n")


@query("JOI30", "SELECT f.path, count(s.id) AS symbols FROM code_files f LEFT JOIN symbols s ON s.file_id = f.file_id AND s.kind = 'struct' GROUP BY f.path")
def _(t):
    n = t.symbols.where("kind = 'struct'").groupBy("file_id").agg(F.count("*").alias("n"))
    return t.code_files.join(n, "file_id", "left").select("path", F.coalesce("n", F.lit(0)).alias("symbols"))


# --- aggregates -------------------------------------------------------------------------------------------------


@query("AGG01", "SELECT count(DISTINCT session_id) AS sessions, count(*) AS calls, coalesce(sum(tokens), 0)::BIGINT AS tokens, CASE WHEN count(*) > 0 THEN round(sum(tokens) / count(*), 6) ELSE 0.0 END AS per_call FROM calls")
def _(t):
    n = F.count("*")
    return t.calls.agg(F.countDistinct("session_id").alias("sessions"), n.alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.when(n > 0, F.round(F.sum("tokens") / n, 6)).otherwise(0.0).alias("per_call"))


@query("AGG02", "SELECT tool, count(*) AS calls, sum(tokens)::BIGINT AS tokens, sum(results)::BIGINT AS results, sum(truncated)::BIGINT AS truncated FROM calls GROUP BY tool")
def _(t):
    return t.calls.groupBy("tool").agg(F.count("*").alias("calls"), *[F.sum(c).cast("long").alias(c) for c in ("tokens", "results", "truncated")]).orderBy(F.desc("calls"))


@query("AGG03", "SELECT search_type, count(*) AS n, round(avg(latency_ms), 6) AS mean, max(latency_ms) AS worst, count(*) FILTER (result_count = 0) AS empty FROM query_events GROUP BY search_type")
def _(t):
    return t.query_events.groupBy("search_type").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean"), F.max("latency_ms").alias("worst"), F.count_if(F.col("result_count") == 0).alias("empty"))


_PCT = "(SELECT latency_ms FROM query_events ORDER BY latency_ms LIMIT 1 OFFSET (SELECT least(floor(count(*) * {} / 100), count(*) - 1)::BIGINT FROM query_events))"


@query("AGG04", f"""SELECT count(*) AS n, round(100.0 * count(*) FILTER (result_count = 0) / count(*), 6)::DOUBLE AS zero_pct,
    round(100.0 * (SELECT count(*) FROM query_events a WHERE EXISTS (SELECT 1 FROM query_events b WHERE b.query_hash = a.query_hash AND b.id <> a.id AND abs(b.created_at - a.created_at) <= {_BAND})) / count(*), 6)::DOUBLE AS again_pct,
    {_PCT.format(50)} AS p50, {_PCT.format(95)} AS p95, {_PCT.format(99)} AS p99, count(*) FILTER (top_score >= 0.7) AS high, count(*) FILTER (top_score >= 0.3 AND top_score < 0.7) AS medium, count(*) FILTER (top_score < 0.3) AS low FROM query_events""")
def _(t):
    q, n, s = t.query_events, F.count("*"), F.col("top_score")
    base = q.agg(n.alias("n"), F.round(100.0 * F.count_if(F.col("result_count") == 0) / n, 6).alias("zero_pct"), F.count_if(s >= 0.7).alias("high"), F.count_if((s >= 0.3) & (s < 0.7)).alias("medium"), F.count_if(s < 0.3).alias("low"))
    again = R.band_semi_join(q, "query_hash", "created_at", _BAND, "id").agg(F.count("*").alias("again"))
    pct = R.offset_percentiles(q, "latency_ms", (50, 95, 99))
    return base.crossJoin(again).crossJoin(pct).withColumn("again_pct", F.round(100.0 * F.col("again") / F.col("n"), 6)).drop("again")


@query("AGG05", "SELECT search_type, list_sort(list(latency_ms))[1 + least(floor(count(*) * 90 / 100), count(*) - 1)::BIGINT] AS p90 FROM query_events GROUP BY search_type")
def _(t):
    counts = t.query_events.groupBy("search_type", "latency_ms").agg(F.count("*").alias("c"))
    w = W.partitionBy("search_type")
    run = counts.select("search_type", "latency_ms", F.sum("c").over(w.orderBy("latency_ms")).alias("hi"), F.sum("c").over(w).alias("n"))
    return run.where(F.col("hi") > F.least(F.floor(F.col("n") * 90 / 100), F.col("n") - 1)).groupBy("search_type").agg(F.min("latency_ms").alias("p90"))


@query("AGG06", "SELECT id, search_type, created_at FROM query_events WHERE created_at >= 1704067200 + 20 * 86400 ORDER BY created_at DESC, id")
def _(t):
    return t.query_events.where(F.col("created_at") >= 1704067200 + 20 * DAY).orderBy(F.desc("created_at"), "id").select("id", "search_type", "created_at")


_BANDS = """CASE WHEN c IS NULL THEN 'fts' WHEN c < 0.40 THEN '<0.40' WHEN c < 0.45 THEN '0.40-0.45' WHEN c < 0.50 THEN '0.45-0.50' WHEN c < 0.55 THEN '0.50-0.55' WHEN c < 0.60 THEN '0.55-0.60' WHEN c < 0.65 THEN '0.60-0.65' ELSE '0.65+' END"""
_BAND_COUNTS = f"""SELECT {_BANDS} AS band, entry_type, holdout, count(*) AS offered, count(*) FILTER (injected) AS injected, count(*) FILTER (outcome IS NOT NULL) AS labelled,
    count(*) FILTER (injected AND coalesce(outcome, '') IN ('used', 'confirmed')) AS positive, count(*) FILTER (injected AND coalesce(outcome, '') IN ('refuted', 'corrected')) AS negative, count(*) FILTER (NOT injected AND outcome = 'missed') AS missed
    FROM (SELECT *, round(cosine, 4) AS c FROM recall_candidates) AS r GROUP BY ALL"""


@query("AGG07", _BAND_COUNTS)
def _(t):
    from ..operators.telemetry import band_counts

    return band_counts(t.recall_candidates)


@query("AGG08", f"WITH b AS ({_BAND_COUNTS}), n AS (SELECT sum(labelled) FILTER (NOT holdout) AS labelled FROM b) SELECT band, entry_type, holdout, positive, negative, CASE WHEN n.labelled >= 30 AND positive + negative > 0 THEN round(positive / (positive + negative), 6) END AS precision FROM b, n")
def _(t):
    from ..operators.telemetry import recall_report

    return recall_report(t.recall_candidates).select("band", "entry_type", "holdout", "positive", "negative", F.round("precision", 6).alias("precision"))


@query("AGG09", "SELECT mode, count(*) AS prompts, count(*) FILTER (created_at >= 1704067200 + 15 * 86400) AS recent FROM recall_prompts GROUP BY mode")
def _(t):
    return t.recall_prompts.groupBy("mode").agg(F.count("*").alias("prompts"), F.count_if(F.col("created_at") >= 1704067200 + 15 * DAY).alias("recent"))


@query("AGG10", """SELECT event, count(*) AS invocations, count(*) FILTER (outcome = 'fired' OR payload_bytes > 0) AS fired, count(*) FILTER (outcome = 'invoked') AS converted, (sum(elapsed_ms) // count(*))::BIGINT AS avg_ms,
    list_sort(list(elapsed_ms))[ceil(count(*) * 0.95)::BIGINT] AS p95_ms, count(*) FILTER (outcome = 'deadline') AS deadline_hits, sum(payload_bytes)::BIGINT AS payload_bytes, sum(docs_bytes)::BIGINT AS docs, sum(memory_bytes)::BIGINT AS memory_total FROM hook_events WHERE event <> 'mining' GROUP BY event""")
def _(t):
    from ..operators.telemetry import hook_event_stats

    return hook_event_stats(t.hook_events, {"docs": "docs_bytes", "memory_total": "memory_bytes"})


@query("AGG11", "SELECT outcome, count(*) AS n, arg_max(reason, at_s * 100000 + id) AS last_reason FROM hook_events WHERE event = 'mining' GROUP BY outcome")
def _(t):
    return t.hook_events.where("event = 'mining'").groupBy("outcome").agg(F.count("*").alias("n"), F.max_by("reason", F.struct("at_s", "id")).alias("last_reason"))


@query("AGG12", "SELECT count(*) AS prompts, count(*) FILTER (docs_bytes > 0) AS with_docs FROM hook_events WHERE event = 'user_prompt_submit'")
def _(t):
    return t.hook_events.where("event = 'user_prompt_submit'").agg(F.count("*").alias("prompts"), F.count_if(F.col("docs_bytes") > 0).alias("with_docs"))


@query("AGG13", "SELECT count(*) AS slow FROM hook_events WHERE elapsed_ms > 200 AND at_s >= 1704067200 + 7 * 86400")
def _(t):
    return t.hook_events.where((F.col("elapsed_ms") > 200) & (F.col("at_s") >= 1704067200 + 7 * DAY)).agg(F.count("*").alias("slow"))


@query("AGG14", """SELECT 'language' AS part, f.language AS name, count(DISTINCT f.file_id) AS files, count(s.id) AS n FROM code_files f LEFT JOIN symbols s ON s.file_id = f.file_id GROUP BY f.language
    UNION ALL SELECT 'kind', kind, NULL, count(*) FROM symbols GROUP BY kind UNION ALL SELECT 'file', file_path, NULL, n FROM (SELECT file_path, count(*) AS n FROM symbols GROUP BY file_path ORDER BY n DESC, file_path LIMIT 8) AS x""")
def _(t):
    none = F.lit(None).cast("long").alias("files")
    lang = t.code_files.join(t.symbols.select("file_id", "id"), "file_id", "left").groupBy("language").agg(F.countDistinct("file_id").alias("files"), F.count("id").alias("n")).select(F.lit("language").alias("part"), F.col("language").alias("name"), "files", "n")
    kind = t.symbols.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("kind").alias("part"), F.col("kind").alias("name"), none, "n")
    top = t.symbols.groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(8).select(F.lit("file").alias("part"), F.col("file_path").alias("name"), none, "n")
    return lang.unionByName(kind).unionByName(top)


@query("AGG15", f"SELECT entry_type, count(*) AS n, count(*) FILTER (due_at <= {NOW}) AS due, count(*) FILTER (due_at > {NOW} AND due_at <= {NOW} + 7 * 86400) AS upcoming FROM memory WHERE status = 'active' GROUP BY entry_type")
def _(t):
    due = F.col("due_at")
    return t.memory.where("status = 'active'").groupBy("entry_type").agg(F.count("*").alias("n"), F.count_if(due <= NOW).alias("due"), F.count_if((due > NOW) & (due <= NOW + 7 * DAY)).alias("upcoming"))


@query("AGG16", "SELECT coalesce(a.collection, b.collection) AS collection, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS now, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT collection, count(*) AS n FROM docs WHERE id % 3 < 2 GROUP BY 1) AS a FULL JOIN (SELECT collection, count(*) AS n FROM docs WHERE id % 5 > 0 GROUP BY 1) AS b ON a.collection = b.collection")
def _(t):
    n = lambda cond, name: t.docs.where(cond).groupBy("collection").agg(F.count("*").alias(name))
    both = n("id % 3 < 2", "before").join(n("id % 5 > 0", "now"), "collection", "full").fillna(0, ["before", "now"])
    return both.withColumn("delta", F.col("now") - F.col("before"))


@query("AGG17", "SELECT count(*) AS documents, count(DISTINCT collection) AS collections, max(indexed_at) AS last_indexed, count(*) FILTER (status IS NOT NULL) AS retired FROM docs")
def _(t):
    return t.docs.agg(F.count("*").alias("documents"), F.countDistinct("collection").alias("collections"), F.max("indexed_at").alias("last_indexed"), F.count_if(F.col("status").isNotNull()).alias("retired"))


@query("AGG18", """SELECT entity, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS total, sum(CASE WHEN relation = 'mentions' THEN 1 ELSE 0 END)::BIGINT AS mentions FROM (SELECT src AS entity, 1 AS o, 0 AS i, relation FROM doc_links UNION ALL SELECT dst, 0, 1, relation FROM doc_links) AS x GROUP BY entity ORDER BY total DESC, entity LIMIT 40""")
def _(t):
    by = t.doc_links.select(F.explode(F.array("src", "dst")).alias("entity"), "relation").groupBy("entity").agg(F.count_if(F.col("relation") == "mentions").alias("mentions"))
    return R.degrees(t.doc_links).orderBy(F.desc("total"), "entity").limit(40).join(by, "entity")


@query("AGG19", "SELECT alias, string_agg(CAST(doc_id AS STRING), ',' ORDER BY doc_id) AS ids FROM (SELECT DISTINCT alias, doc_id FROM aliases) AS a GROUP BY alias HAVING count(*) > 1")
def _(t):
    g = t.aliases.groupBy("alias").agg(F.sort_array(F.collect_set("doc_id")).alias("ids")).where(F.size("ids") > 1)
    return g.select("alias", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("AGG20", f"WITH r AS ({_RESOLVED}) SELECT e.relation AS key, count(r.target) FILTER (r.target <> e.source_doc_id) AS hits, count(*) AS total, count(r.target) FILTER (r.target <> e.source_doc_id) / count(*) >= 0.5 AS relation_key FROM edges e JOIN r ON r.id = e.id GROUP BY e.relation")
def _(t):
    from ..operators.graph import resolve

    r = resolve(t.edges.select("id", "target_ref", "relation", "source_doc_id"), t.docs, t.aliases)
    hits = F.count_if(F.col("target") != F.col("source_doc_id"))
    return r.groupBy(F.col("relation").alias("key")).agg(hits.alias("hits"), F.count("*").alias("total"), (hits / F.count("*") >= 0.5).alias("relation_key"))


_VSTAT = "SELECT experiment_id, variant, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(latency_ms), 6) AS mean_latency, list_sort(list(latency_ms))[ceil(count(*) * 0.95)::BIGINT] AS p95, round(count(*) FILTER (result_count = 0) / count(*), 6) AS zero_rate, round(var_pop(score), 6) AS variance FROM experiment_results GROUP BY ALL"


@query("AGG21", _VSTAT)
def _(t):
    from ..operators.telemetry import variant_stats

    s = variant_stats(t.experiment_results)
    return s.select("experiment_id", "variant", "n", *[F.round(c, 6).alias(c) for c in ("mean_score", "mean_latency", "zero_rate", "variance")], "p95")


_PHI = "(1 - (0.254829592 * k - 0.284496736 * k * k + 1.421413741 * k ** 3 - 1.453152027 * k ** 4 + 1.061405429 * k ** 5) * exp(-x * x))"


@query("AGG22", f"""WITH v AS (SELECT experiment_id, variant, count(*) AS n, avg(score) AS m, var_pop(score) AS var FROM experiment_results GROUP BY ALL),
    z AS (SELECT a.experiment_id, a.m AS ma, b.m AS mb, (a.m - b.m) / sqrt(a.var / a.n + b.var / b.n) AS z, (a.m - b.m) / sqrt((a.var + b.var) / 2) AS d FROM v a JOIN v b ON a.experiment_id = b.experiment_id WHERE a.variant = 'A' AND b.variant = 'B'),
    p AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS k FROM z), q AS (SELECT *, 2 * (1 - (1 + {_PHI}) / 2) AS p FROM p)
    SELECT experiment_id, round(z, 6) AS z, round(p, 6) AS p, round(d, 6) AS effect, CASE WHEN p < 0.05 THEN CASE WHEN ma > mb THEN 'A' ELSE 'B' END END AS winner FROM q""")
def _(t):
    from ..operators.telemetry import significance, variant_stats

    s = significance(variant_stats(t.experiment_results))
    return s.select("experiment_id", *[F.round(c, 6).alias(c) for c in ("z", "p", "effect")], "winner")


@query("AGG23", "SELECT cluster_id, count(*) AS evidence, count(DISTINCT session) AS sessions, max(created_at) AS last_seen FROM candidates GROUP BY cluster_id")
def _(t):
    return t.candidates.groupBy("cluster_id").agg(F.count("*").alias("evidence"), F.countDistinct("session").alias("sessions"), F.max("created_at").alias("last_seen"))


_BUCKET = "CASE WHEN h IS NULL THEN 'cosine' WHEN h = 6 THEN 'at cut' WHEN h = 0 THEN '0' WHEN h BETWEEN 1 AND 3 THEN '1-3' WHEN h = 4 THEN '4' WHEN h = 5 THEN '5' ELSE 'at cut' END"
_DUPS = "SELECT name AS cluster, CASE WHEN length(name) > 4 THEN CAST(substr(name, 3) AS INT) % 7 END AS h, file_path, module_path, visibility, line_end - line_start + 1 AS lines FROM symbols"


def _dups(t):
    return t.symbols.select(F.col("name").alias("cluster"), F.when(F.length("name") > 4, F.substring("name", 3, 9).cast("int") % 7).alias("hamming"), "file_path", "module_path", "visibility", F.expr("line_end - line_start + 1").alias("lines"))


@query("AGG24", f"SELECT bucket, count(*) AS clusters, sum(dup)::BIGINT AS duplicated FROM (SELECT cluster, {_BUCKET} AS bucket, sum(lines) - max(lines) AS dup FROM ({_DUPS}) AS d GROUP BY ALL) AS c GROUP BY bucket")
def _(t):
    from ..operators.duplication import cluster_report

    return cluster_report(_dups(t), 6).groupBy("bucket").agg(F.count("*").alias("clusters"), F.sum("duplicated").alias("duplicated"))


@query("AGG25", f"SELECT cluster, (sum(lines) - max(lines))::BIGINT AS duplicated, count(DISTINCT coalesce(module_path, file_path)) AS module_spread, count(DISTINCT file_path) AS file_spread FROM ({_DUPS}) AS d GROUP BY cluster")
def _(t):
    from ..operators.duplication import cluster_report

    return cluster_report(_dups(t), 6).select("cluster", "duplicated", "module_spread", "file_spread")


@query("AGG26", "SELECT tag, count(*) AS n, min(id) AS first FROM (SELECT id, unnest(string_split(tags, ',')) AS tag FROM memory WHERE status = 'active') AS x GROUP BY tag HAVING count(*) >= 2")
def _(t):
    tags = t.memory.where("status = 'active'").select("id", F.explode(F.split("tags", ",")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n >= 2")


@query("AGG27", "SELECT session_id, tool, count(*) AS calls, sum(tokens)::BIGINT AS tokens, max(at_s) AS last FROM calls GROUP BY ALL")
def _(t):
    return t.calls.groupBy("session_id", "tool").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.max("at_s").alias("last"))


_RANKED = "SELECT user_id AS query, event_id % 50 AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events"


@query("AGG28", f"WITH h AS (SELECT query, min(r) AS r FROM ({_RANKED}) AS x WHERE id = query % 50 GROUP BY query), q AS (SELECT DISTINCT query FROM ({_RANKED}) AS y) SELECT count(*) AS n, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall_at_5, round(avg(CASE WHEN r <= 5 THEN 1.0 / r ELSE 0.0 END), 6)::DOUBLE AS mrr FROM q LEFT JOIN h USING (query)")
def _(t):
    from ..operators.evals import recall_report

    ranked = t.events.select(F.col("user_id").alias("query"), (F.col("event_id") % 50).alias("id"), F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))
    expected = ranked.select("query", (F.col("query") % 50).alias("id")).distinct()
    return recall_report(ranked, expected, 5)


@query("AGG29", "SELECT count(*) AS n, round(avg(CASE WHEN contains(lower(d.text), lower(substr(b.text, 1, 12))) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 5")
def _(t):
    from ..operators.evals import judge_accuracy

    pairs = t.benchmark.join(t.documents.select(F.col("doc_id"), F.col("text").alias("found")), F.col("item_id") * 5 == F.col("doc_id")).select(F.substring("text", 1, 12).alias("answer"), "found")
    return judge_accuracy(pairs)


@query("AGG30", "SELECT round(avg(cosine) FILTER (injected) - avg(cosine) FILTER (NOT injected), 6) AS gap FROM recall_candidates")
def _(t):
    hi, lo = F.avg(F.when(F.col("injected"), F.col("cosine"))), F.avg(F.when(~F.col("injected"), F.col("cosine")))
    return t.recall_candidates.agg(F.round(hi - lo, 6).alias("gap"))


@query("AGG31", "SELECT tool, count(*) AS calls, max(tokens) AS most, sum(truncated)::BIGINT AS truncated FROM calls GROUP BY tool")
def _(t):
    return t.calls.groupBy("tool").agg(F.count("*").alias("calls"), F.max("tokens").alias("most"), F.sum("truncated").cast("long").alias("truncated"))


# --- windows ----------------------------------------------------------------------------------------------------


@query("WIN01", "SELECT edge, sym_id, tier FROM (SELECT r.id AS edge, s.id AS sym_id, CASE WHEN s.file_id = r.file_id THEN 4 WHEN s.module_path = f.module_path THEN 6 ELSE 7 END AS tier FROM relationships r JOIN symbols f ON f.id = r.from_symbol_id JOIN symbols s ON s.name = r.to_name AND s.kind IN ('function', 'method')) AS x QUALIFY tier = min(tier) OVER (PARTITION BY edge)")
def _(t):
    from ..operators.code import has

    # an edge's best tier is told by the keys of its name's callables; it then meets those that stand at that tier only
    f = t.symbols.select(F.col("id").alias("from_symbol_id"), F.col("module_path").alias("fm"))
    s = t.symbols.where("kind IN ('function', 'method')").select(F.col("id").alias("sym_id"), F.col("name").alias("to_name"), F.col("file_id").alias("sf"), F.col("module_path").alias("sm"))
    e = t.relationships.select(F.col("id").alias("edge"), "from_symbol_id", "to_name", "file_id").join(f, "from_symbol_id")
    e = has(e, s.select("to_name", "sf"), "here", to_name=F.col("to_name"), sf=F.col("file_id"))
    e = has(e, s.select("to_name", "sm"), "beside", to_name=F.col("to_name"), sm=F.col("fm"))
    e = e.withColumn("tier", F.when(F.col("here"), 4).when(F.col("beside"), 6).otherwise(7))
    key = lambda file, module: F.when(F.col("tier") == 4, F.col(file).cast("string")).when(F.col("tier") == 6, F.col(module)).otherwise("")
    at = s.withColumn("tier", F.explode(F.array(*map(F.lit, (4, 6, 7))))).withColumn("key", key("sf", "sm"))
    return e.withColumn("key", key("file_id", "fm")).join(at, ["to_name", "tier", "key"]).select("edge", "sym_id", "tier")


@query("WIN02", "SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY top_score DESC, id) - 1 AS rank FROM query_events")
def _(t):
    return t.query_events.select("session_id", "id", (F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("top_score"), "id")) - 1).cast("long").alias("rank"))


@query("WIN03", f"SELECT id, entry_type, CASE WHEN access_count > 0 THEN row_number() OVER (PARTITION BY entry_type, access_count > 0 ORDER BY round(ln(1.0 + access_count) * pow(0.5, ({NOW} - last_accessed) / (14.0 * 86400)), 9) DESC, id) END AS rank FROM memory")
def _(t):
    from ..operators.memory import access_recency

    s = t.memory.select("id", "entry_type", F.round(access_recency(F.lit(NOW), 14 * DAY), 9).alias("s"))
    ranked = s.where("s > 0").select("id", F.row_number().over(W.partitionBy("entry_type").orderBy(F.desc("s"), "id")).cast("long").alias("rank"))
    return s.select("id", "entry_type").join(ranked, "id", "left")


@query("WIN04", "SELECT id, round(top_score / max(top_score) OVER (PARTITION BY session_id), 6) AS score FROM query_events")
def _(t):
    top = F.max("top_score").over(W.partitionBy("session_id"))
    return t.query_events.select("id", F.round(F.when(top > 0, F.col("top_score") / top).otherwise(F.col("top_score")), 6).alias("score"))


def _newest(df, key, n):
    return df.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id")))).where(F.col("n") <= n)


@query("WIN05", "SELECT cluster_id, id FROM candidates QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, id DESC) <= 3")
def _(t):
    return _newest(t.candidates, "cluster_id", 3).select("cluster_id", "id")


@query("WIN06", "SELECT session_id, max(at_s) AS last FROM calls GROUP BY session_id ORDER BY last DESC, session_id LIMIT 25")
def _(t):
    return t.calls.groupBy("session_id").agg(F.max("at_s").alias("last")).orderBy(F.desc("last"), "session_id").limit(25)


@query("WIN07", "SELECT source, arg_max(id, updated_at * 1000000 + rowid) AS newest FROM memory WHERE entry_type = 'handoff' AND status = 'active' GROUP BY source")
def _(t):
    return t.memory.where("entry_type = 'handoff' AND status = 'active'").groupBy("source").agg(F.max_by("id", F.struct("updated_at", "rowid")).alias("newest"))


_EV = "SELECT user_id, list(event_id ORDER BY event_id) AS xs, count(*) AS n FROM events GROUP BY user_id"


@query("WIN08", f"SELECT user_id, s AS start, len(xs[s + 1:s + 10]) AS size, xs[s + 1] AS first FROM (SELECT *, unnest(range(0, n, 8)) AS s FROM ({_EV}) AS e WHERE n > 10) AS x")
def _(t):
    # windows of 10 that advance by 8: an element at place p is in the one or two windows that start at multiples of 8 at or before it
    p = t.events.select("user_id", "event_id", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("p"))
    last = F.floor(F.col("p") / 8) * 8
    placed = p.select("user_id", "event_id", "p", F.explode(F.filter(F.array(last, last - 8), lambda s: (s >= 0) & (F.col("p") - s < 10))).alias("start"))
    n = t.events.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 10").select("user_id")
    return placed.join(n, "user_id", "left_semi").groupBy("user_id", "start").agg(F.count("*").alias("size"), F.min_by("event_id", "p").alias("first"))


@query("WIN09", "SELECT doc_id, len(w) - 2 AS n, w[1] || ' ' || w[2] || ' ' || w[3] AS first FROM (SELECT doc_id, string_split(lang || ' ' || source || ' ' || substr(text, 1, 30), ' ') AS w FROM documents) AS d WHERE len(w) >= 3")
def _(t):
    w = F.split(F.concat_ws(" ", "lang", "source", F.substring("text", 1, 30)), " ")
    return t.documents.select("doc_id", X.shingles(w, 3).alias("s")).where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"))




@query("WIN10", f"WITH q AS (SELECT item_id, {_TOK.format('text')} AS q FROM benchmark), e AS (SELECT doc_id, {_TOK.format('text')} AS e FROM documents) SELECT item_id, doc_id FROM q, e WHERE list_has_any({_SHINGLES.format('q')}, {_SHINGLES.format('e')})")
def _(t):
    # the runs of three words are the join key: no query meets a document with which it shares none
    runs = lambda df, key: df.select(key, X.content_tokens(F.col("text")).alias("w")).select(key, F.explode(F.array_distinct(X.shingles(F.col("w"), 3))).alias("s"))
    q, e = runs(t.benchmark, "item_id"), runs(t.documents, "doc_id")
    return q.join(e, "s").select("item_id", "doc_id").distinct()


# --- top-k ------------------------------------------------------------------------------------------------------


@query("TOP01", f"SELECT doc_id, score FROM ({_HITS}) AS h ORDER BY score DESC, doc_id LIMIT 10")
def _(t):
    return _hits(t).orderBy(F.desc("score"), "doc_id").limit(10)


@query("TOP02", "SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS distance FROM embeddings ORDER BY round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6), vec_id LIMIT 15")
def _(t):
    from ..operators.vectors import knn

    q = t.embeddings.where("vec_id = 7").select(F.lit(0).alias("query"), F.col("embedding").alias("q"))
    return knn(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q, 15).select(F.col("id").alias("vec_id"), "distance")


@query("TOP03", f"WITH lex AS (SELECT doc_id FROM ({_HITS}) AS h ORDER BY score DESC, doc_id LIMIT 20) SELECT id, path FROM docs WHERE id IN (SELECT doc_id FROM lex) AND {_CURRENT} ORDER BY id LIMIT 10")
def _(t):
    leg = _hits(t).orderBy(F.desc("score"), "doc_id").limit(2 * 10).select(F.col("doc_id").alias("id"))
    return t.docs.where(current()).join(F.broadcast(leg), "id", "left_semi").orderBy("id").limit(10).select("id", "path")


_REACH = "CASE visibility WHEN 'public' THEN 5 WHEN 'package' THEN 4 WHEN 'crate' THEN 3 WHEN 'module' THEN 2 WHEN 'restricted' THEN 1 ELSE 0 END"


@query("TOP04", f"""SELECT cluster, row_number() OVER (ORDER BY list_position(['0', '1-3', '4', '5', 'at cut', 'cosine'], bucket), ms DESC, fs DESC, reach DESC, dup DESC, cluster) AS place
    FROM (SELECT cluster, {_BUCKET} AS bucket, sum(lines) - max(lines) AS dup, count(DISTINCT coalesce(module_path, file_path)) AS ms, count(DISTINCT file_path) AS fs, max({_REACH}) AS reach FROM ({_DUPS}) AS d GROUP BY cluster, h) AS c""")
def _(t):
    from ..operators.duplication import cluster_report, ranking

    return R.numbered(cluster_report(_dups(t), 6), *ranking(), F.col("cluster"), name="place").select("cluster", "place")


@query("TOP05", f"SELECT file_a, file_b, n FROM ({_COCHANGE}) AS c WHERE n >= 3 ORDER BY n DESC, file_a, file_b LIMIT 50")
def _(t):
    return R.cochange(t.commits, most_files=8).where("n >= 3").orderBy(F.desc("n"), "file_a", "file_b").limit(50)


@query("TOP06", "WITH r AS (SELECT id, row_number() OVER (ORDER BY access_count DESC, id) AS rn FROM memory ORDER BY access_count DESC, id LIMIT 9) SELECT id, row_number() OVER (ORDER BY CASE WHEN rn % 2 = 1 THEN rn ELSE 1000000000 - rn END) AS place FROM r")
def _(t):
    from ..operators.hybrid import lost_in_middle

    top = t.memory.orderBy(F.desc("access_count"), "id").limit(9).select("id", "access_count")
    ranked = top.withColumn("rn", F.row_number().over(W.orderBy(F.desc("access_count"), "id")))
    return ranked.select("id", F.row_number().over(W.orderBy(lost_in_middle(F.col("rn")))).cast("long").alias("place"))


@query("TOP07", "SELECT id, entry_type FROM (SELECT * FROM memory WHERE status = 'active' AND expires_at IS NULL ORDER BY access_count DESC, id LIMIT 100) AS x ORDER BY updated_at DESC, id LIMIT 10")
def _(t):
    pool = t.memory.where("status = 'active' AND expires_at IS NULL").orderBy(F.desc("access_count"), "id").limit(min(10 * 10, 500))
    return pool.orderBy(F.desc("updated_at"), "id").limit(10).select("id", "entry_type")


@query("TOP08", f"WITH d AS (SELECT *, row_number() OVER (ORDER BY due_at, id) AS rn, count(*) OVER () AS n FROM memory WHERE entry_type = 'reminder' AND status = 'active' AND due_at <= {NOW}) SELECT rn AS place, title AS line FROM d WHERE rn <= 5 UNION ALL SELECT DISTINCT 6, concat('+', CAST(n - 5 AS STRING), ' more') FROM d WHERE n > 5")
def _(t):
    due = t.memory.where(f"entry_type = 'reminder' AND status = 'active' AND due_at <= {NOW}")
    top = due.orderBy("due_at", "id").limit(5).select("due_at", "id", "title").withColumn("place", F.row_number().over(W.orderBy("due_at", "id")).cast("long")).select("place", F.col("title").alias("line"))
    more = due.agg(F.count("*").alias("n")).where("n > 5").select(F.lit(6).cast("long").alias("place"), F.concat(F.lit("+"), (F.col("n") - 5).cast("string"), F.lit(" more")).alias("line"))
    return top.unionByName(more)


@query("TOP09", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) >= 0.2 ORDER BY score DESC, vec_id LIMIT 12")
def _(t):
    from ..operators.vectors import cosine

    q = t.embeddings.where("vec_id = 3").select(F.col("embedding").alias("q"))
    s = t.embeddings.crossJoin(F.broadcast(q)).select("vec_id", cosine("embedding", "q").alias("c")).where("c >= 0.2").select("vec_id", F.round("c", 6).alias("score"))
    return s.orderBy(F.desc("score"), "vec_id").limit(12)


@query("TOP10", "SELECT source_doc_id, target_doc_id, relationship, created_at FROM evolution WHERE source_doc_id = 60 OR target_doc_id = 60 ORDER BY created_at DESC, id DESC")
def _(t):
    return t.evolution.where("source_doc_id = 60 OR target_doc_id = 60").orderBy(F.desc("created_at"), F.desc("id")).select("source_doc_id", "target_doc_id", "relationship", "created_at")


# --- sets -------------------------------------------------------------------------------------------------------


@query("SET01", f"SELECT doc_id, max(sim) AS best FROM (SELECT doc_id, sim FROM ({_CHUNKS}) AS a WHERE vec_id % 2 = 0 UNION ALL SELECT doc_id, sim FROM ({_CHUNKS}) AS b WHERE vec_id % 3 = 0) AS u GROUP BY doc_id")
def _(t):
    c = _chunks(t)
    return c.where("vec_id % 2 = 0").select("doc_id", "sim").unionByName(c.where("vec_id % 3 = 0").select("doc_id", "sim")).groupBy("doc_id").agg(F.max("sim").alias("best"))


@query("SET02", "SELECT source, tag FROM (SELECT source, unnest(string_split(tags, ',')) AS tag, id FROM memory) AS x GROUP BY source, tag HAVING count(DISTINCT id) = (SELECT count(*) FROM memory m WHERE m.source = x.source)")
def _(t):
    n = t.memory.groupBy("source").agg(F.count("*").alias("n"))
    tags = t.memory.select("source", "id", F.explode(F.array_distinct(F.split("tags", ","))).alias("tag")).groupBy("source", "tag").agg(F.countDistinct("id").alias("c"))
    return tags.join(n, "source").where("c = n").select("source", "tag")


@query("SET03", "SELECT 'vanished' AS what, collection AS name FROM docs WHERE id % 4 = 0 EXCEPT SELECT 'vanished', collection FROM docs WHERE id % 4 = 1 AND id % 3 > 0")
def _(t):
    was, now = (t.docs.where(c).select(F.lit("vanished").alias("what"), F.col("collection").alias("name")).distinct() for c in ("id % 4 = 0", "id % 4 = 1 AND id % 3 > 0"))
    return was.join(now, ["what", "name"], "left_anti")


@query("SET04", "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM doc_links")
def _(t):
    return t.doc_links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


@query("SET05", "SELECT name, count(DISTINCT id) FILTER (id % 3 = 0) AS accepted, count(DISTINCT id) FILTER (id % 3 <> 0) AS added, count(DISTINCT id) FILTER (id % 3 <> 0) = 0 AS unchanged FROM symbols GROUP BY name")
def _(t):
    g = t.symbols.groupBy("name").agg(F.collect_set("id").alias("now"), F.collect_set(F.when(F.col("id") % 3 == 0, F.col("id"))).alias("was"))
    added = F.size(F.array_except("now", "was"))
    return g.select("name", F.size("was").cast("long").alias("accepted"), added.cast("long").alias("added"), (added == 0).alias("unchanged"))


@query("SET06", "SELECT 'holdout' AS part, count(*) AS n FROM recall_candidates WHERE holdout UNION ALL SELECT 'shown', count(*) FROM recall_candidates WHERE NOT holdout")
def _(t):
    return t.recall_candidates.groupBy(F.when(F.col("holdout"), "holdout").otherwise("shown").alias("part")).agg(F.count("*").alias("n"))
