"""Scalar functions on text, numbers, dates, arrays and JSON (STR, MTH, DAT, ARR, MAP, JSN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import porter, text as X
from ..functions.multi import held
from ..operators import memory as M, vectors as V
from .filters import glob_regex
from .catalog import query
from .relational import _FP, _SHINGLES, _SIG, _TOK, text_fingerprints
from .tables import DAY, NOW


@query("STR01", f"SELECT doc_id, array_to_string({_TOK.format('text')}, ' ') AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.content_tokens(F.col("text")), " ").alias("tokens"))


@query("STR02", f"""WITH w AS (SELECT doc_id, unnest({_TOK.format('text')}) AS w, generate_subscripts({_TOK.format('text')}, 1) AS i FROM documents), d AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY octet_length(encode(w)) DESC, i) AS n FROM d) SELECT doc_id, string_agg(w, ' OR ' ORDER BY i) AS expression FROM r WHERE n <= 32 GROUP BY doc_id""")
def _(t):
    terms = X.recall_terms(F.col("text"))
    return t.documents.select("doc_id", F.array_join(terms, " OR ").alias("expression")).where("expression <> ''")


@query("STR03", f"SELECT doc_id, list_has_all({_TOK.format('text')}, ['the', 'tion', 'ering']) AS every, list_has_any({_TOK.format('text')}, ['ering', 'thtion', 'leaux']) AS some FROM documents")
def _(t):
    toks = X.content_tokens(F.col("text"))
    has_all = F.size(F.array_intersect(F.array(*map(F.lit, ("the", "tion", "ering"))), toks)) == 3
    return t.documents.select("doc_id", has_all.alias("every"), F.arrays_overlap(toks, F.array(*map(F.lit, ("ering", "thtion", "leaux")))).alias("some"))


@query("STR04", "SELECT id, count(DISTINCT substr(name, i, 3)) AS trigrams FROM symbols, unnest(range(1, length(name) - 1)) AS u(i) GROUP BY id")
def _(t):
    from .filters import symbol_names

    return symbol_names(t).postings().select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("trigrams"))


@query("STR04_porter")
def _(t):
    words = t.documents.select(F.explode(X.content_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", porter.stem(F.col("word")).alias("stem"))


@query("STR05", r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')), lambda w: octet_length(encode(w)) >= 3 AND (regexp_matches(w, '[_.\p{N}]|::') OR (regexp_matches(w, '\p{Ll}') AND regexp_matches(w, '^.+\p{Lu}')))), lambda w: lower(w)), ' ') AS ids FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.identifiers(F.col("text")), " ").alias("ids"))


_COMPACT = r"CASE WHEN length(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))) > 3 AND suffix(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g')), 's') THEN lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))[:-2] ELSE lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g')) END"


@query("STR06", f"SELECT p_partkey, {_COMPACT.format('p_name')} AS compact, {_COMPACT.format('p_type')} AS kind FROM part")
def _(t):
    return t.part.select("p_partkey", X.compact_word(F.col("p_name")).alias("compact"), X.compact_word(F.col("p_type")).alias("kind"))


@query("STR07", "SELECT id, string_split(path, '/')[1] AS project, string_split(path, '/')[2] AS dir FROM docs WHERE len(string_split(path, '/')) >= 3")
def _(t):
    p = F.split("path", "/")
    return t.docs.where(F.size(p) >= 3).select("id", F.element_at(p, -3).alias("project"), F.element_at(p, -2).alias("dir"))


_IDENTIFIERS = r"list_transform(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')), lambda w: octet_length(encode(w)) >= 3 AND (regexp_matches(w, '[_.\p{N}]|::') OR (regexp_matches(w, '\p{Ll}') AND regexp_matches(w, '^.+\p{Lu}')))), lambda w: lower(w))"


@query("STR08", f"WITH q AS (SELECT item_id, {_TOK.format('text')} AS q, {_IDENTIFIERS} AS ids FROM benchmark), e AS (SELECT doc_id, {_TOK.format('text')} AS e, lower(text) AS low FROM documents) SELECT item_id, doc_id, coalesce(len(list_filter(ids, lambda w: contains(low, w))) > 0, false) OR coalesce(list_has_any({_SHINGLES.format('q')}, {_SHINGLES.format('e')}), false) OR coalesce(len(list_filter(list_distinct(list_intersect(q, e)), lambda w: octet_length(encode(w)) >= 7)) >= 2, false) AS strong FROM q, e")
def _(t):
    # evidence is met by equi-joins, identifiers by one automaton over each text, then told for each pair of a query and a document
    words = lambda df, key: df.select(key, X.content_tokens(F.col("text")).alias("w"))
    runs = lambda df, key: words(df, key).select(key, F.explode(F.array_distinct(X.shingles(F.col("w"), 3))).alias("s"))
    long = lambda df, key: words(df, key).select(key, F.explode(F.array_distinct("w")).alias("s")).where(F.octet_length("s") >= X.RARE_TERM_LEN)
    b, d = t.benchmark, t.documents
    phrase = runs(b, "item_id").join(runs(d, "doc_id"), "s").select("item_id", "doc_id").distinct()
    rare = long(b, "item_id").join(long(d, "doc_id"), "s").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= X.RARE_TERMS).select("item_id", "doc_id")
    named = b.select("item_id", F.explode(F.array_distinct(X.identifiers(F.col("text")))).alias("word"))
    written = named.join(held(d.select("doc_id", F.lower("text").alias("low")), "doc_id", "low", named.select("word")), "word").select("item_id", "doc_id").distinct()
    # a document's items are one row until its pairs are made
    strong = phrase.union(rare).union(written).groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    every = b.agg(F.collect_set("item_id").alias("every"))
    told = d.select("doc_id").join(strong, "doc_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<bigint>"))).crossJoin(F.broadcast(every))
    mark = lambda items, strong: F.transform(items, lambda i: F.struct(i.alias("item_id"), F.lit(strong).alias("strong")))
    return told.select("doc_id", F.inline(F.concat(mark(F.col("items"), True), mark(F.array_except("every", "items"), False)))).select("item_id", "doc_id", "strong")


_MD = "concat('see [[', title, '|shown]] and `[[code]]` or [[Note 7#part]]', chr(10), '```', chr(10), '[[fenced]]', chr(10), '```', chr(10), substr(body, 1, 20))"


@query("STR09", r"SELECT id, 1 AS line, title AS target, 'shown' AS display FROM docs UNION ALL SELECT id, 1, 'Note 7#part', NULL FROM docs")
def _(t):
    from ..functions.links import wiki_links

    md = t.docs.select("id", F.expr(_MD).alias("md"))
    return wiki_links(md, "id", "md").select("id", "line", "target", "display")


@query("STR10", r"SELECT id, CASE WHEN regexp_replace(trim(target_ref), '#.*$', '') = '' THEN '' WHEN suffix(regexp_replace(trim(target_ref), '#.*$', ''), '.md') THEN regexp_replace(trim(target_ref), '#.*$', '') ELSE concat(regexp_replace(trim(target_ref), '#.*$', ''), '.md') END AS target FROM edges")
def _(t):
    return t.edges.select("id", X.link_target(F.col("target_ref")).alias("target"))


@query("STR11", r"SELECT id, concat(regexp_replace(regexp_replace(target_ref, '^([.]/|/)+', ''), '[.]md$', ''), '.md') AS dotted, regexp_replace(regexp_replace(target_ref, '^([.]/|/)+', ''), '[.]md$', '') AS plain FROM edges")
def _(t):
    forms = X.ref_forms(F.col("target_ref"))
    return t.edges.select("id", F.filter(forms, lambda x: x.endswith(".md") & ~x.rlike(r"^(\./|/)"))[0].alias("dotted"), F.element_at(F.filter(forms, lambda x: ~x.endswith(".md") & ~x.rlike(r"^(\./|/)")), 1).alias("plain"))


@query("STR12", r"SELECT id, CASE WHEN id % 2 = 0 THEN concat('T', CAST(id AS STRING)) ELSE concat('Head ', title) END AS title FROM docs")
def _(t):
    md = F.concat(F.lit("intro\n# **Head** _"), F.col("title"), F.lit("_\n"), F.coalesce("body", F.lit("")))
    declared = F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"title": "T'), F.col("id").cast("string"), F.lit('"}')))
    first = F.regexp_replace(F.regexp_extract(md, r"(?m)^#\s+(.+)$", 1), r"[*_]{1,2}", "")
    return t.docs.select("id", F.coalesce(F.get_json_object(declared, "$.title"), F.nullif(first, F.lit(""))).alias("title"))


@query("STR13", "SELECT id, body AS snippet FROM docs")
def _(t):
    md = F.concat(F.lit("---\ntitle: x\ntags: [a]\n---\n"), "body")
    return t.docs.select("id", F.when(F.lit(True), F.regexp_replace(md, r"(?s)^---\n.*?\n---\n", "")).alias("snippet"))


@query("STR14", "SELECT id, concat(CASE WHEN entry_type = 'topic' THEN '' ELSE concat('[', entry_type, '] ') END, id, ': ', title, ' (', array_to_string(list_filter(string_split(tags, ','), lambda x: NOT starts_with(x, 'src')), ', '), ')') AS line FROM memory")
def _(t):
    tags = F.filter(F.split("tags", ","), lambda x: ~x.startswith("src"))
    label = F.when(F.col("entry_type") == "topic", "").otherwise(F.concat(F.lit("["), "entry_type", F.lit("] ")))
    return t.memory.select("id", F.concat(label, "id", F.lit(": "), "title", F.lit(" ("), F.array_join(tags, ", "), F.lit(")")).alias("line"))


def _redact_sql(x: str) -> str:
    for pattern, by in X.REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return x


@query("STR15", f"SELECT doc_id, md5({_redact_sql('text')}) AS redacted FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.redact(F.col("text")).cast("binary")).alias("redacted"))


@query("STR16", f"WITH k AS (SELECT id, {_SIG.format('error_signature')} AS k FROM clusters), e AS (SELECT list_sort({_SIG.format('signature')}) AS e, count(*) AS n FROM errors GROUP BY 1) SELECT id, coalesce(sum(n), 0)::BIGINT AS same FROM k LEFT JOIN e ON len(k) > 0 AND len(list_intersect(k, e)) / len(k) >= 0.6 GROUP BY id")
def _(t):
    # signatures of equal words are one; those that share a word are told apart, the others can't match
    words = lambda df, c, *n: df.groupBy(F.sort_array(X.signature_tokens(F.col(c))).alias(f"{c}_words")).agg(F.min(c).alias(c), *n)
    k, e = words(t.clusters, "error_signature"), words(t.errors, "signature", F.count("*").alias("n"))
    met = k.select("error_signature", F.explode("error_signature_words").alias("w")).join(e.select("signature", "n", F.explode("signature_words").alias("w")), "w").select("error_signature", "signature", "n").distinct()
    same = met.where(X.signatures_match(F.col("error_signature"), F.col("signature"))).groupBy("error_signature").agg(F.sum("n").alias("same")).join(k, "error_signature").select("error_signature_words", "same")
    known = t.clusters.select("id", F.sort_array(X.signature_tokens(F.col("error_signature"))).alias("error_signature_words"))
    return known.join(same, "error_signature_words", "left").groupBy("id").agg(F.coalesce(F.max("same"), F.lit(0)).alias("same"))


@query("STR17", f"SELECT conv_id, turn, list_has_any(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}'']+'), [{', '.join(repr(w) if chr(39) not in w else chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in X.CORRECTION_WORDS)}]) OR {' OR '.join(f'contains(lower(text), {p!r})' for p in X.CORRECTION_PHRASES)} AS correction FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", X.is_correction(F.col("text")).alias("correction"))


@query("STR18", "SELECT conv_id, turn, turn % 3 = 0 AS generated FROM conversations")
def _(t):
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  Stop hook feedback: "), "text")).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", X.is_hook_generated(said).alias("generated"))


@query("STR19", r"SELECT id, regexp_matches(lower(concat('who calls ', title)), '\b(who|what) calls\b|\bcallers? of\b|\bcall graph\b') AS wants FROM memory")
def _(t):
    from ..functions.commands import wants_call_graph

    return t.memory.select("id", wants_call_graph(F.concat(F.lit("who calls "), "title")).alias("wants"))


@query("STR20", r"SELECT id, CASE WHEN regexp_matches(concat('fn ', name), '^(fn|def|class|struct|func)\s+\w+') AND id % 3 = 0 THEN 'definition' WHEN id % 3 = 1 THEN 'call_site' ELSE 'identifier' END AS kind FROM symbols")
def _(t):
    from ..functions.commands import classify_pattern

    asked = F.when(F.col("id") % 3 == 0, F.concat(F.lit("fn "), "name")).when(F.col("id") % 3 == 1, F.concat("name", F.lit("\\("))).otherwise(F.col("name"))
    return t.symbols.select("id", classify_pattern(asked).alias("kind"))


@query("STR21", "SELECT id, name AS pattern FROM symbols")
def _(t):
    from ..functions.commands import grep_pattern

    cmd = F.concat(F.lit("cd src && bash -c \"cat x | grep -rn '"), "name", F.lit("' . | head -5\""))
    return t.symbols.select("id", grep_pattern(cmd).alias("pattern"))


@query("STR22", "SELECT id, file_path AS path FROM symbols")
def _(t):
    from ..functions.commands import path_tokens

    return t.symbols.select("id", F.explode(path_tokens(F.concat(F.lit("please look at `"), "file_path", F.lit("` and 3/4 of it"))))).withColumnRenamed("col", "path")


@query("STR23", "SELECT doc_id, CASE WHEN len(list_filter(string_split(lower(text), ' '), lambda w: list_contains(['the', 'of', 'and', 'is', 'in'], w))) > len(list_filter(string_split(lower(text), ' '), lambda w: list_contains(['il', 'la', 'di', 'che', 'per'], w))) THEN 'en' ELSE 'it' END AS language FROM documents")
def _(t):
    w = F.split(F.lower("text"), " ")
    n = lambda some: F.size(F.filter(w, lambda x: x.isin(*some)))
    return t.documents.select("doc_id", F.when(n(("the", "of", "and", "is", "in")) > n(("il", "la", "di", "che", "per")), "en").otherwise("it").alias("language"))


@query("STR24", "SELECT id, true AS whole, false AS part FROM memory")
def _(t):
    named = lambda text: F.rlike(text, F.concat(F.lit(r"(?<![\p{L}\p{N}._-])\Q"), F.col("id"), F.lit(r"\E(?![\p{L}\p{N}._-])")))
    return t.memory.select("id", named(F.concat(F.lit("used "), "id", F.lit(", then"))).alias("whole"), named(F.concat(F.lit("used "), "id", F.lit("-b"))).alias("part"))


@query("STR25", r"SELECT id, len(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 4))) AS words FROM memory")
def _(t):
    words = F.array_distinct(F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))
    return t.memory.select("id", F.size(words).cast("long").alias("words"))


@query("STR26", "SELECT id, file_path AS path, line_start AS line FROM symbols")
def _(t):
    said = F.concat(F.lit("see "), "file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit(" and ../secret/x.rs:3"))
    refs = F.filter(F.regexp_extract_all(said, F.lit(r"((?:\.\./)?[\w-]+(?:/[\w.-]+)+\.\w+(?::\d+)?)"), F.lit(1)), lambda r: ~F.contains(r, F.lit("..")))
    one = t.symbols.select("id", F.explode(refs).alias("r"))
    return one.select("id", F.regexp_replace("r", r":\d+$", "").alias("path"), F.regexp_extract("r", r":(\d+)$", 1).cast("long").alias("line"))


@query("STR27", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))).cast("long").alias("tokens"))


@query("STR28", r"SELECT item_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS plain FROM benchmark")
def _(t):
    normal = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return t.benchmark.select("item_id", F.sha2(normal, 256).alias("plain"))


@query("STR28_hmac")
def _(t):
    from ..functions.hashing import hmac_sha256

    normal = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return t.benchmark.select("item_id", hmac_sha256(b"key", normal.cast("binary")).alias("hmac"))


@query("STR29", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("STR30", "SELECT id, translate(concat('/root/', path), '/.', '--') AS encoded FROM docs")
def _(t):
    return t.docs.select("id", F.translate(F.concat(F.lit("/root/"), "path"), "/.", "--").alias("encoded"))


@query("STR31", "SELECT id, concat_ws(chr(10), concat(kind, ' ', name), signature, doc_comment) AS text FROM symbols")
def _(t):
    return t.symbols.select("id", F.left(F.concat_ws("\n", F.concat_ws(" ", "kind", "name"), "signature", "doc_comment"), F.lit(500)).alias("text"))


@query("STR32", r"SELECT id, right(regexp_replace(trim(signature), '\s+', ' ', 'g'), 12) AS receiver FROM symbols")
def _(t):
    return t.symbols.select("id", F.right(F.regexp_replace(F.trim("signature"), r"\s+", " "), F.lit(12)).alias("receiver"))


@query("STR33", "SELECT id, id % 4 = 0 AS conflict FROM docs")
def _(t):
    text = F.when(F.col("id") % 4 == 0, F.lit("a\n<<<<<<< ours\nb\n=======\nc\n>>>>>>> theirs")).otherwise(F.lit("a <<<<<<< b"))
    return t.docs.select("id", (text.rlike(r"(?m)^<{7} ") & text.rlike(r"(?m)^>{7} ")).alias("conflict"))


@query("STR34", "SELECT name, sha256(string_agg(concat(file_path, '#', CAST(id AS STRING)), chr(30) ORDER BY concat(file_path, '#', CAST(id AS STRING)))) AS cluster_hash FROM symbols GROUP BY name")
def _(t):
    key = F.concat("file_path", F.lit("#"), F.col("id").cast("string"))
    return t.symbols.groupBy("name").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(key)), "\x1e"), 256).alias("cluster_hash"))


@query("STR35", "SELECT id, regexp_full_match(id, '[a-z0-9][a-z0-9._-]{0,99}') AND octet_length(encode(content)) <= 100000 AND len(string_split(tags, ',')) <= 20 AND length(title) BETWEEN 1 AND 200 AS valid FROM memory")
def _(t):
    ok = F.col("id").rlike("^[a-z0-9][a-z0-9._-]{0,99}$") & (F.octet_length("content") <= 100_000) & (F.size(F.split("tags", ",")) <= 20) & F.length("title").between(1, 200)
    return t.memory.select("id", ok.alias("valid"))


# --- numbers ----------------------------------------------------------------------------------------------------


@query("MTH01", "SELECT id, round(1.0 / (60 + rank + 1) + 0.7 / (60 + rank * 2 + 1), 9)::DOUBLE AS s FROM (SELECT id, id % 40 AS rank FROM docs) AS r")
def _(t):
    r = F.col("id") % 40
    return t.docs.select("id", F.round(1.0 / (60 + r + 1) + 0.7 / (60 + r * 2 + 1), 9).alias("s"))


@query("MTH02", "SELECT prompt_id, rank, round(sqrt(2 * (1 - cosine)), 6) AS distance, round(1 - pow(sqrt(2 * (1 - cosine)), 2) / 2, 6) AS back FROM recall_candidates")
def _(t):
    d = F.sqrt(2 * (1 - F.col("cosine")))
    return t.recall_candidates.select("prompt_id", "rank", F.round(d, 6).alias("distance"), F.round(V.cosine_of_distance(d), 6).alias("back"))


@query("MTH03", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(V.cosine("embedding", "other"), 6).alias("cosine"), F.round(V.l2("embedding", "other"), 6).alias("l2"))


_CONF = f"""greatest(((1.0 + confirmations) / (2.0 + confirmations + 3.0 * corrections))::DOUBLE * CASE WHEN entry_type IN ('topic', 'problem', 'decision') THEN 1.0::DOUBLE ELSE exp(-greatest(({NOW} - coalesce(last_confirmed_at, created_at)) / 86400.0::DOUBLE, 0) / (90.0 * (1.0 + ln(1.0::DOUBLE + access_count)))) END
    * CASE source_type WHEN 'official_docs' THEN 1.0 WHEN 'user_statement' THEN 0.85 WHEN 'auto_extracted' THEN 0.70 ELSE 0.65 END::DOUBLE, 0.05)"""
_RECENCY = f"CASE WHEN access_count > 0 AND last_accessed IS NOT NULL THEN ln(1.0::DOUBLE + access_count) * pow(0.5::DOUBLE, greatest({NOW} - last_accessed, 0) / (14 * 86400.0::DOUBLE)) ELSE 0 END"


@query("MTH04", f"SELECT id, round({_CONF}, 6) AS confidence FROM memory")
def _(t):
    return t.memory.select("id", F.round(M.confidence(F.lit(NOW)), 6).alias("confidence"))


@query("MTH05", f"SELECT id, round({_RECENCY}, 6) AS recency FROM memory")
def _(t):
    return t.memory.select("id", F.round(M.access_recency(F.lit(NOW), 14 * DAY), 6).alias("recency"))


@query("MTH06", f"SELECT id, round(0.7 * (rowid % 10) / 10.0 + 0.3 * {_CONF}, 6) AS score FROM memory")
def _(t):
    return t.memory.select("id", F.round(M.final_score((F.col("rowid") % 10) / 10.0, M.confidence(F.lit(NOW))), 6).alias("score"))


_INJECT = f"""CASE WHEN distinct_sessions <= 0 THEN 0.0::DOUBLE ELSE distinct_sessions / (distinct_sessions + 1.0::DOUBLE) * exp(-greatest(({NOW} - greatest(coalesce(last_unrefuted_injection_at, last_seen_at), last_seen_at)) / 86400.0::DOUBLE, 0) / (90.0 * (1.0 + ln(1.0::DOUBLE + evidence_count))))
    * ((1.0::DOUBLE + confirmed_count) / (2.0 + confirmed_count + refuted_count)) * (distinct_sessions / (distinct_sessions + misfired_count)::DOUBLE) END"""


@query("MTH07", f"SELECT id, round({_INJECT}, 6) AS score, state = 'promoted' AND refuted_count <= confirmed_count AND {_INJECT} >= 0.3 AS injectable FROM clusters")
def _(t):
    from ..operators.priors import injectable, injection_score

    return t.clusters.select("id", F.round(injection_score(F.lit(NOW)), 6).alias("score"), injectable(F.lit(NOW)).alias("injectable"))


@query("MTH08", "SELECT doc_id, bit_count(xor(doc_id * 7919, doc_id * 104729))::INT AS distance FROM documents")
def _(t):
    return t.documents.select("doc_id", F.bit_count((F.col("doc_id") * 7919).bitwiseXOR(F.col("doc_id") * 104729)).alias("distance"))


@query("MTH09", f"SELECT id AS doc_id, fp AS fingerprint FROM {_FP} AS f")
def _(t):
    return text_fingerprints(t).select(F.col("id").alias("doc_id"), F.col("fp").alias("fingerprint"))


@query("MTH10", """WITH h AS (SELECT DISTINCT query_hash, sha256(concat('exp', query_hash)) AS h FROM query_events) SELECT query_hash, CASE WHEN ('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT::DOUBLE / 18446744073709551615.0 < 0.4 THEN 'A' ELSE 'B' END AS variant FROM h""")
def _(t):
    h = F.sha2(F.concat(F.lit("exp"), "query_hash"), 256)
    little = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)])
    share = F.conv(little, 16, 10).cast("decimal(20,0)").cast("double") / float(2**64 - 1)
    return t.query_events.select("query_hash").distinct().select("query_hash", F.when(share < 0.4, "A").otherwise("B").alias("variant"))


@query("MTH11", "SELECT id, round((1 + sign(x) * (1 - (0.254829592 * k - 0.284496736 * k ** 2 + 1.421413741 * k ** 3 - 1.453152027 * k ** 4 + 1.061405429 * k ** 5) * exp(-x * x))) / 2, 6) AS p FROM (SELECT id, x, 1 / (1 + 0.3275911 * abs(x)) AS k FROM (SELECT id, (top_score * 8 - 2) / sqrt(2) AS x FROM query_events) AS a) AS b")
def _(t):
    from ..operators.telemetry import normal_cdf

    return t.query_events.select("id", F.round(normal_cdf(F.col("top_score") * 8 - 2), 6).alias("p"))


@query("MTH12", "SELECT id, CASE visibility WHEN 'public' THEN 5 WHEN 'package' THEN 4 WHEN 'crate' THEN 3 WHEN 'module' THEN 2 WHEN 'restricted' THEN 1 ELSE 0 END AS reach FROM symbols")
def _(t):
    from ..operators.duplication import reach

    return t.symbols.select("id", reach(F.col("visibility")).alias("reach"))


@query("MTH13", "SELECT id, CASE WHEN id % 9 = 8 THEN 'cosine' WHEN id % 9 = 6 THEN 'at cut' WHEN id % 9 = 0 THEN '0' WHEN id % 9 <= 3 THEN '1-3' WHEN id % 9 = 4 THEN '4' WHEN id % 9 = 5 THEN '5' ELSE 'at cut' END AS bucket FROM symbols")
def _(t):
    from ..operators.duplication import bucket

    return t.symbols.select("id", bucket(F.when(F.col("id") % 9 < 8, F.col("id") % 9), 6).alias("bucket"))


# --- dates, arrays, maps, JSON ----------------------------------------------------------------------------------


@query("DAT01", f"SELECT id, (({NOW} - created_at) // 86400)::BIGINT AS age_days, expires_at IS NOT NULL AND expires_at <= {NOW} AS expired, created_at < {NOW} - 30 * 86400 AS past_retention FROM memory")
def _(t):
    return t.memory.select("id", F.floor((NOW - F.col("created_at")) / DAY).alias("age_days"), F.coalesce(F.col("expires_at") <= NOW, F.lit(False)).alias("expired"), (F.col("created_at") < NOW - 30 * DAY).alias("past_retention"))


@query("DAT02", "SELECT id, CASE id % 4 WHEN 0 THEN id * 3600 WHEN 1 THEN id * 86400 WHEN 2 THEN id * 604800 END AS secs FROM docs")
def _(t):
    from ..functions.dates import duration_seconds

    said = F.concat(F.col("id").cast("string"), F.element_at(F.array(*map(F.lit, ("h", "d", "w", "x"))), (F.col("id") % 4 + 1).cast("int")))
    return t.docs.select("id", duration_seconds(said).alias("secs"))


@query("DAT03", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events")
def _(t):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.events.select("event_id", F.unix_timestamp(F.try_to_timestamp(text)).alias("at_s"))


@query("DAT04", f"SELECT id, CASE WHEN due_at <= {NOW} THEN 'due' WHEN due_at <= {NOW} + 7 * 86400 THEN 'upcoming' ELSE 'later' END AS state FROM memory WHERE due_at IS NOT NULL")
def _(t):
    return t.memory.where("due_at is not null").select("id", F.when(F.col("due_at") <= NOW, "due").when(F.col("due_at") <= NOW + 7 * DAY, "upcoming").otherwise("later").alias("state"))


@query("ARR01", "SELECT id, unnest(string_split(tags, ',')) AS tag FROM memory")
def _(t):
    from ..functions.dates import tags_of

    said = F.when(F.col("rowid") % 2 == 0, F.replace("tags", F.lit(","), F.lit(" , "))).otherwise(F.to_json(F.split("tags", ",")))
    return t.memory.select("id", F.explode(tags_of(said)).alias("tag"))


@query("ARR02", "SELECT id, CASE WHEN id % 2 = 0 THEN target_ref ELSE concat(target_ref, '-', CAST(k AS STRING)) END AS ref FROM edges, (SELECT 0 AS k UNION ALL SELECT 1) AS ks WHERE id % 2 = 1 OR k = 0")
def _(t):
    from ..functions.dates import values_of

    ref = F.col("target_ref")
    raw = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(ref.alias("depends_on")))).otherwise(F.to_json(F.struct(F.array(F.concat(ref, F.lit("-0")), F.concat(ref, F.lit("-1"))).alias("depends_on"))))
    return t.edges.select("id", F.explode(values_of(raw, "depends_on")).alias("ref"))


@query("ARR03", "SELECT id, target_ref AS ref, CASE WHEN id % 3 = 2 THEN 'why' END AS reason FROM edges")
def _(t):
    from ..functions.dates import evolution_refs

    r = F.col("target_ref")
    raw = F.when(F.col("id") % 3 == 0, F.to_json(F.struct(r.alias("supersedes")))).when(F.col("id") % 3 == 1, F.to_json(F.struct(F.array(r).alias("supersedes")))).otherwise(F.to_json(F.struct(F.array(F.struct(r.alias("ref"), F.lit("why").alias("reason"))).alias("supersedes"))))
    return t.edges.select("id", F.explode(evolution_refs(raw, "supersedes")).alias("x")).select("id", "x.ref", "x.reason")


@query("ARR04", "SELECT src, string_agg(DISTINCT relation, ',' ORDER BY relation) AS via FROM doc_links GROUP BY src")
def _(t):
    return t.doc_links.groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("via"))


@query("MAP01", "SELECT event, 'docs' AS block, sum(docs_bytes)::BIGINT AS bytes FROM hook_events GROUP BY event UNION ALL SELECT event, 'memory', sum(memory_bytes)::BIGINT FROM hook_events GROUP BY event")
def _(t):
    blocks = F.create_map(F.lit("docs"), "docs_bytes", F.lit("memory"), "memory_bytes")
    return t.hook_events.select("event", F.explode(blocks).alias("block", "n")).groupBy("event", "block").agg(F.sum("n").alias("bytes"))


@query("JSN01")
def _(t):
    from ..functions.frontmatter import frontmatter

    md = F.concat(F.lit("---\ntitle: \""), "title", F.lit("\"\ntags: [a, b]\ndepends_on:\n  - x\n  - y\n---\n"), "body")
    return t.docs.select("id", frontmatter(md).alias("json"))


@query("JSN02", """SELECT id, sha256(concat('{"kind":"', trigger_kind, '","tool":"', coalesce(lower(tool), ''), '"}')) AS key FROM clusters""")
def _(t):
    canonical = F.to_json(F.struct(F.col("trigger_kind").alias("kind"), F.coalesce(F.lower("tool"), F.lit("")).alias("tool")))
    return t.clusters.select("id", F.sha2(canonical, 256).alias("key"))


@query("JSN03", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("JSN04", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) END AS k FROM events")
def _(t):
    raw = F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise(F.lit("{broken"))
    return t.events.select("event_id", F.from_json(raw, "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("JSN05", "SELECT event_id, props AS json FROM events")
def _(t):
    noisy = F.concat(F.lit("Sure:\n"), "props", F.lit("\nDone."))
    return t.events.select("event_id", F.regexp_extract(noisy, r"(?s)\{.*\}", 0).alias("json"))
