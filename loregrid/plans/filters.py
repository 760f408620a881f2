"""Filters, predicates and point lookups (FIL)."""

from __future__ import annotations

from pyspark.sql import Column, Window as W, functions as F

from ..functions import requests, text as X
from ..functions.multi import found
from ..operators.spans import innermost
from ..storage import commits
from ..storage.trigrams import TrigramIndex
from .catalog import query
from .tables import NOW


def current(include_superseded: bool = False) -> Column:
    """Documents that searches show: without status; archived ones only in the sessions collection."""
    return F.lit(True) if include_superseded else F.col("status").isNull() | ((F.col("collection") == "src3") & (F.col("status") == "archived"))


def visible(now: int = NOW) -> Column:
    """Entries that aren't expired, and reminders only once they are due."""
    return (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & ((F.col("entry_type") != "reminder") | F.col("due_at").isNull() | (F.col("due_at") <= now))


_CURRENT = "(status IS NULL OR (collection = 'src3' AND status = 'archived'))"
_VISIBLE = f"(expires_at IS NULL OR expires_at > {NOW}) AND (entry_type <> 'reminder' OR due_at IS NULL OR due_at <= {NOW})"


@query("FIL01", f"SELECT id, collection, status FROM docs WHERE {_CURRENT}")
def _(t):
    return t.docs.where(current()).select("id", "collection", "status")


@query("FIL02", "SELECT id, title FROM docs WHERE collection = 'src5'")
def _(t):
    return t.docs.where(F.col("collection") == "src5").select("id", "title")


@query("FIL03", "SELECT id, collection FROM docs WHERE collection <> 'src3'")
def _(t):
    return t.docs.where(F.col("collection") != "src3").select("id", "collection")


@query("FIL04", f"SELECT id, entry_type FROM memory WHERE {_VISIBLE}")
def _(t):
    return t.memory.where(visible()).select("id", "entry_type")


@query("FIL05", """SELECT 'popular' AS sort, id, access_count AS v FROM (SELECT * FROM memory WHERE status = 'active' AND entry_type <> 'prior' ORDER BY access_count DESC, id LIMIT 20) AS a
    UNION ALL SELECT 'recent', id, updated_at FROM (SELECT * FROM memory WHERE status = 'active' AND entry_type <> 'prior' ORDER BY updated_at DESC, id LIMIT 20) AS b
    UNION ALL SELECT 'newest', id, created_at FROM (SELECT * FROM memory WHERE status = 'active' AND entry_type <> 'prior' ORDER BY created_at DESC, id LIMIT 20) AS c""")
def _(t):
    live = t.memory.where("status = 'active' AND entry_type <> 'prior'")
    top = lambda sort, by: live.orderBy(F.desc(by), "id").limit(20).select(F.lit(sort).alias("sort"), "id", F.col(by).alias("v"))
    return top("popular", "access_count").unionByName(top("recent", "updated_at")).unionByName(top("newest", "created_at"))


def symbol_names(t) -> TrigramIndex:
    """The stored index of symbol names, written by the first query that needs it."""
    root = f"{commits.shared_dir(t.spark)}/corpora/symbols-{commits.fingerprint(t.spark, f'{t.sf_dir}/part.parquet')}"
    return TrigramIndex(t.spark, root).add(t.symbols.select("id", "name"), "all")


@query("FIL06", """SELECT id, name, count(*) OVER () AS total FROM symbols WHERE contains(name, 'fn1') AND kind = 'function' AND contains(file_path, 'm1/') QUALIFY row_number() OVER (ORDER BY name, id) <= 50""")
def _(t):
    """By the stored trigram index of names; the other conditions on what it finds."""
    named = symbol_names(t).search(t.spark.createDataFrame([(0, "fn1")], "query int, text string")).select("id")
    hit = commits.kept(t.symbols.join(named, "id", "left_semi").where((F.col("kind") == "function") & F.col("file_path").contains("m1/")).select("id", "name"), "hits")
    total = hit.agg(F.count("*").alias("total"))
    return hit.orderBy("name", "id").limit(50).select("id", "name").crossJoin(F.broadcast(total))


@query("FIL07", r"SELECT doc_id FROM documents WHERE contains(text, '%%%') AND NOT contains(text, '_')")
def _(t):
    return t.documents.where(F.expr(f"text LIKE r'{X.like_pattern('%%%')}'") & ~F.expr(f"text LIKE r'{X.like_pattern('_')}'")).select("doc_id")


@query("FIL08", "SELECT id, name, name = 'fn12' AS exact FROM symbols WHERE contains(name, 'fn12') ORDER BY name = 'fn12' DESC, file_path, line_start, id LIMIT 30")
def _(t):
    exact = F.col("name") == "fn12"
    named = symbol_names(t).search(t.spark.createDataFrame([(0, "fn12")], "query int, text string")).select("id")
    return t.symbols.join(named, "id", "left_semi").withColumn("exact", exact).orderBy(F.desc("exact"), "file_path", "line_start", "id").limit(30).select("id", "name", "exact")


@query("FIL09", """SELECT l.id AS literal_id, s.id AS symbol_id FROM literals l JOIN symbols s ON s.file_path = l.path AND l.line BETWEEN s.line_start AND coalesce(s.line_end, s.line_start)
    QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY s.line_end - s.line_start, s.id) = 1""")
def _(t):
    s = t.symbols.select("id", F.col("file_path").alias("path"), "line_start", F.coalesce("line_end", "line_start").alias("line_end"))
    return innermost(t.literals.select("id", "path", "line"), s).select(F.col("id").alias("literal_id"), F.col("span").alias("symbol_id"))


@query("FIL10", "SELECT id, name, line_start, col_start FROM symbols WHERE file_path = 'src/m3/f3.rs' ORDER BY line_start, col_start, id")
def _(t):
    return t.symbols.where(F.col("file_path") == "src/m3/f3.rs").orderBy("line_start", "col_start", "id").select("id", "name", "line_start", "col_start")


KINDS = ("function", "method", "struct", "enum", "trait", "class", "interface", "module", "constant", "variable", "field", "type", "macro", "property", "constructor", "namespace")


def parse_kind(kind: str | None) -> str | None:
    """The kind in lower case; None for no filter. Raises for kinds that don't exist."""
    if kind is None or not kind.strip():
        return None
    if (k := kind.strip().lower()) not in KINDS:
        raise ValueError(f"no symbol kind {kind!r}; one of {', '.join(KINDS)}")
    return k


@query("FIL11", "SELECT kind, count(*) AS n FROM symbols WHERE kind = 'method' GROUP BY kind")
def _(t):
    return t.symbols.where(F.col("kind") == parse_kind(" Method ")).groupBy("kind").agg(F.count("*").alias("n"))


@query("FIL12", """WITH asked AS (SELECT item_id AS q, CASE item_id % 3 WHEN 0 THEN CAST(item_id * 3 AS STRING) WHEN 1 THEN concat('src', CAST(item_id % 20 AS STRING), '/en/d', CAST(item_id AS STRING), '.md') ELSE concat('m-', CAST(item_id AS STRING)) END AS ref FROM benchmark),
    found AS (SELECT q, 1 AS p, CAST(id AS STRING) AS hit FROM asked JOIN docs ON ref = CAST(id AS STRING) UNION ALL SELECT q, 2, CAST(id AS STRING) FROM asked JOIN docs ON ref = path UNION ALL SELECT q, 3, id FROM asked JOIN memory ON ref = id)
    SELECT q, p, hit FROM found QUALIFY row_number() OVER (PARTITION BY q ORDER BY p, hit) = 1""")
def _(t):
    asked = t.benchmark.selectExpr("item_id AS q", "CASE item_id % 3 WHEN 0 THEN CAST(item_id * 3 AS STRING) WHEN 1 THEN concat('src', CAST(item_id % 20 AS STRING), '/en/d', CAST(item_id AS STRING), '.md') ELSE concat('m-', CAST(item_id AS STRING)) END AS ref")
    docs = t.docs.select(F.col("id").cast("string").alias("hit"), "path")
    by_id = asked.join(docs, asked.ref == docs.hit).select("q", F.lit(1).alias("p"), "hit")
    by_path = asked.join(docs, asked.ref == docs.path).select("q", F.lit(2).alias("p"), "hit")
    by_slug = asked.join(t.memory.select(F.col("id").alias("hit")), F.col("ref") == F.col("hit")).select("q", F.lit(3).alias("p"), "hit")
    best = by_id.unionByName(by_path).unionByName(by_slug).groupBy("q").agg(F.min(F.struct("p", "hit")).alias("m"))
    return best.select("q", "m.p", "m.hit")


def line_range(body: Column, start: int, end: int) -> Column:
    """Lines ``start`` to ``end`` (from 1, both included), clamped to the text."""
    ls = F.split(body, "\n")
    return F.array_join(F.slice(ls, max(1, start), max(0, end - max(1, start) + 1)), "\n")


@query("FIL13", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents")
def _(t):
    return t.documents.select("doc_id", line_range(F.col("text"), 2, 4).alias("part"))


def glob_regex(glob: str) -> str:
    """A path glob (``*``, ``**``, ``?``, ``[...]``, ``{a,b}``) as an anchored regular expression."""
    import re

    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
            continue
        if c == "{":
            depth += 1
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")" if depth else "\\}", ",": "|" if depth else ","}.get(c, re.escape(c))
        depth -= c == "}" and depth > 0
        i += 1
    return f"^{out}$"


@query("FIL14", "SELECT id, path, body FROM docs WHERE regexp_matches(path, '^src1[^/]*/(?:en|de)/d[^/]*5[.]md$')")
def _(t):
    return t.docs.where(F.col("path").rlike(glob_regex("src1*/{en,de}/d*5.md"))).select("id", "path", "body")


@query("FIL15", "SELECT id, path, status FROM docs WHERE id IN (SELECT item_id * 5 FROM benchmark)")
def _(t):
    return t.docs.join(t.benchmark.select((F.col("item_id") * 5).alias("id")).distinct(), "id", "left_semi").select("id", "path", "status")


@query("FIL16", """SELECT id, count(*) OVER () > 20 AS truncated FROM (SELECT id FROM literals WHERE contains(path, 'm1') AND contains(lower(value), 'the') ORDER BY path, line, id LIMIT 21) AS x QUALIFY row_number() OVER (ORDER BY id) <= 21""")
def _(t):
    hit = t.literals.where(F.col("path").contains("m1") & F.contains(F.lower("value"), F.lit("the"))).orderBy("path", "line", "id").limit(21).select("id")
    return hit.crossJoin(F.broadcast(hit.agg((F.count("*") > 20).alias("truncated"))))


_P = ["the", "le", "der", "que"]


@query("FIL17", f"SELECT id, array_to_string(list_filter([{', '.join(f'CASE WHEN contains(value, {p!r}) THEN {i} END' for i, p in enumerate(_P))}], lambda x: x IS NOT NULL), ',') AS matched FROM literals WHERE {' OR '.join(f'contains(value, {p!r})' for p in _P)}")
def _(t):
    hits = found(t.literals, "id", "value", _P).select("id", "pattern").distinct()
    return hits.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("pattern")), lambda p: p.cast("string")), ",").alias("matched"))  # the patterns at most


@query("FIL18", r"""SELECT doc_id, i AS line, length(encode(regexp_extract(ls[i], '^(.*?)(token|password)', 1))) + 1 AS col FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) AS d, unnest(range(1, len(ls) + 1)) AS u(i) WHERE regexp_matches(ls[i], 'token|password')""".replace("length(encode(", "octet_length(encode("))
def _(t):
    hits = found(t.documents, "doc_id", "text", ["token", "password"])
    return hits.groupBy("doc_id", "line").agg(F.min("col").alias("col"))


@query("FIL19", """WITH hits AS (SELECT source AS root, doc_id FROM documents WHERE contains(text, 'token')) SELECT root, count(*) AS hits, min(doc_id) AS first, (SELECT count(DISTINCT source) FROM documents) AS roots, (SELECT count(*) FROM hits) > 10 AS truncated FROM hits GROUP BY root""")
def _(t):
    hits = t.documents.where(F.col("text").contains("token")).select(F.col("source").alias("root"), "doc_id")
    cover = t.documents.agg(F.countDistinct("source").alias("roots"))
    return hits.groupBy("root").agg(F.count("*").alias("hits"), F.min("doc_id").alias("first")).crossJoin(F.broadcast(cover)).crossJoin(F.broadcast(hits.agg((F.count("*") > 10).alias("truncated"))))


@query("FIL20", "SELECT id, confirmations FROM memory WHERE (1.0 + confirmations) / (2.0 + confirmations + 3.0 * corrections) >= 0.6 ORDER BY rowid LIMIT 25")
def _(t):
    return t.memory.where((1.0 + F.col("confirmations")) / (2.0 + F.col("confirmations") + 3.0 * F.col("corrections")) >= 0.6).orderBy("rowid").limit(25).select("id", "confirmations")


_SCOPES = ["text", "strings", "code", "coupling", "docs", "memory", "symbols", "duplicates", "source", "literals", "semantic-code", "knowledge", "nowhere"]
_REQUESTS = f"""(SELECT event_id, CASE WHEN event_id % 14 < 13 THEN [{', '.join(f"'{s}'" for s in _SCOPES)}][event_id % 14 + 1] END AS scope, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN ' ' END AS query,
    CASE event_id % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [event_type] WHEN 2 THEN [event_type, ' '] END AS patterns, CASE WHEN event_id % 7 = 0 THEN 'src' END AS path, CASE WHEN event_id % 11 < 2 THEN 'f.rs' END AS file,
    event_id % 13 = 0 AS regex, event_id % 4 = 0 AS ignore_case, CASE event_id % 17 WHEN 0 THEN 'v2' WHEN 1 THEN 'v1' END AS contract FROM events)"""
_PURPOSE = "CASE " + " ".join(f"WHEN scope = '{s}' THEN '{p}'" for s, p in requests.PURPOSES.items()) + f" WHEN scope IS NULL THEN '{requests.DEFAULT}' END"


@query("FIL21", f"""WITH r AS (SELECT *, {_PURPOSE} AS p, coalesce(len(patterns), 0) AS n, coalesce(query, '') AS q FROM {_REQUESTS} AS x),
    e AS (SELECT event_id, p, CASE WHEN p IS NULL THEN 'unknown scope' WHEN patterns IS NOT NULL AND n = 0 THEN 'patterns are empty' WHEN n > 0 AND (p NOT IN ('source', 'literals') OR q <> '') THEN 'patterns are for source and literals, without a query'
      WHEN n > 64 OR len(list_filter(patterns, lambda x: trim(x) = '')) > 0 THEN '1 to 64 patterns, none blank' WHEN p IN ('source', 'literals', 'semantic_code', 'knowledge') AND n = 0 AND trim(q) = '' THEN 'a query or patterns are needed'
      WHEN regex AND p <> 'source' THEN 'regex is for source' WHEN path IS NOT NULL AND p NOT IN ('source', 'literals', 'symbols', 'duplicates') THEN 'no path for this scope' WHEN path IS NOT NULL AND file IS NOT NULL THEN 'path or file, not both'
      WHEN file IS NOT NULL AND p = 'source' THEN 'source takes a path' WHEN ignore_case AND p IN ('semantic_code', 'knowledge') THEN 'no ignore_case for this scope' WHEN contract IS NOT NULL AND (contract <> 'v2' OR p NOT IN ('symbols', 'docs', 'memory')) THEN 'no such contract for this scope' END AS error FROM r)
    SELECT event_id, CASE WHEN error IS NULL THEN p END AS purpose, error FROM e""")
def _(t):
    i = F.col("event_id")
    text, none = F.col("event_type"), F.lit(None).cast("string")
    asked = t.events.select(
        "event_id", F.when(i % 14 < 13, F.get(F.array(*map(F.lit, _SCOPES)), (i % 14).cast("int"))).alias("scope"), F.when(i % 3 == 0, text).when(i % 3 == 1, " ").alias("query"),
        F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 == 1, F.array(text)).when(i % 5 == 2, F.array(text, F.lit(" "))).alias("patterns"), F.when(i % 7 == 0, "src").otherwise(none).alias("path"), F.when(i % 11 < 2, "f.rs").otherwise(none).alias("file"),
        (i % 13 == 0).alias("regex"), (i % 4 == 0).alias("ignore_case"), F.when(i % 17 == 0, "v2").when(i % 17 == 1, "v1").alias("contract"),
    )
    return requests.validated(asked).select("event_id", "purpose", "error")


@query("FIL22", f"""SELECT id, entry_type FROM memory WHERE expires_at <= {NOW} OR (entry_type = 'handoff' AND updated_at < {NOW} - 10 * 86400 AND id IS DISTINCT FROM (SELECT id FROM memory WHERE entry_type = 'handoff' ORDER BY updated_at DESC, id DESC LIMIT 1))""")
def _(t):
    newest = t.memory.where("entry_type = 'handoff'").agg(F.max_by("id", F.struct("updated_at", "id")).alias("newest"))
    aged = (F.col("entry_type") == "handoff") & (F.col("updated_at") < NOW - 10 * 86400) & ~F.col("id").eqNullSafe(F.col("newest"))
    return t.memory.crossJoin(F.broadcast(newest)).where((F.col("expires_at") <= NOW) | aged).select("id", "entry_type")


@query("FIL23", f"SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active' AND {_VISIBLE}) AS visible, (SELECT count(*) FROM memory WHERE rowid NOT IN (SELECT vec_id FROM embeddings)) AS pending FROM memory")
def _(t):
    pending = t.memory.join(t.embeddings.select(F.col("vec_id").alias("rowid")), "rowid", "left_anti").agg(F.count("*").alias("pending"))
    return t.memory.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if((F.col("status") == "active") & visible()).alias("visible")).crossJoin(F.broadcast(pending))
