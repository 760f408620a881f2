"""Engine tables derived from the driver's tables.

The engine's own tables (documents with status, memory entries, code graph, telemetry) don't exist in the test
data, so they are derived from ids by arithmetic. Each is one SELECT in SQL that Spark and DuckDB both run:
queries and their SQL twins therefore start from the same rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import commits

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Moment that all derived ages refer to.
NOW = 1_705_000_000
DAY = 86_400

DERIVED: dict[str, str] = {
    "docs": """
        SELECT doc_id AS id, source AS collection, concat(source, '/', lang, '/d', CAST(doc_id AS STRING), '.md') AS path, text AS body, lang,
          concat('Note ', CAST(doc_id % 700 AS STRING)) AS title, n_chars,
          CASE doc_id % 11 WHEN 3 THEN 'superseded' WHEN 7 THEN 'archived' WHEN 9 THEN 'retracted' END AS status,
          CAST(1700000000 + doc_id * 600 AS BIGINT) AS indexed_at
        FROM documents""",
    "memory": """
        SELECT concat('m-', CAST(d.doc_id AS STRING)) AS id, d.doc_id AS rowid, concat('Note ', CAST(d.doc_id % 700 AS STRING)) AS title, d.text AS content,
          CASE d.doc_id % 6 WHEN 0 THEN 'topic' WHEN 1 THEN 'problem' WHEN 2 THEN 'decision' WHEN 3 THEN 'reminder' WHEN 4 THEN 'prior' ELSE 'handoff' END AS entry_type,
          CASE WHEN d.doc_id % 13 = 5 THEN 'archived' WHEN d.doc_id % 17 = 4 THEN 'superseded' ELSE 'active' END AS status,
          concat('lang-', d.lang, ',', d.source, ',t', CAST(d.doc_id % 9 AS STRING)) AS tags, d.lang, d.source,
          CAST(1700000000 + d.doc_id * 700 % 4000000 AS BIGINT) AS created_at, CAST(1700000000 + d.doc_id * 900 % 4500000 AS BIGINT) AS updated_at,
          CAST(d.doc_id % 7 AS BIGINT) AS access_count, CAST(CASE WHEN d.doc_id % 7 > 0 THEN 1704000000 + d.doc_id * 37 % 900000 END AS BIGINT) AS last_accessed,
          CAST(d.doc_id % 5 AS INT) AS confirmations, CAST(coalesce(1 - l.quality, 0) + coalesce(l.toxic, 0) AS INT) AS corrections,
          CAST(CASE WHEN d.doc_id % 5 > 0 THEN 1702000000 + d.doc_id * 53 % 2000000 END AS BIGINT) AS last_confirmed_at,
          CAST(CASE WHEN coalesce(l.quality, 1) = 0 OR coalesce(l.toxic, 0) = 1 THEN 1702500000 + d.doc_id * 29 % 1500000 END AS BIGINT) AS last_refuted_at,
          CASE d.doc_id % 4 WHEN 0 THEN 'official_docs' WHEN 1 THEN 'user_statement' WHEN 2 THEN 'auto_extracted' ELSE 'inference' END AS source_type,
          CAST(CASE WHEN d.doc_id % 10 = 1 THEN 1704900000 + d.doc_id * 400 END AS BIGINT) AS expires_at,
          CAST(CASE WHEN d.doc_id % 6 = 3 THEN 1704700000 + d.doc_id * 1000 END AS BIGINT) AS due_at
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "edges": """
        SELECT CAST(doc_id AS BIGINT) AS id, CAST(doc_id AS BIGINT) AS source_doc_id,
          CASE doc_id % 4 WHEN 0 THEN concat(source, '/', lang, '/d', CAST((doc_id * 7 + 3) % 1200 AS STRING))
            WHEN 1 THEN concat('alias-', CAST(doc_id % 40 AS STRING)) WHEN 2 THEN concat('./', source, '/', lang, '/d', CAST(CASE WHEN doc_id % 8 = 2 THEN doc_id ELSE (doc_id * 3 + 50) % 1100 END AS STRING), '.md')
            ELSE concat('missing-', CAST(doc_id AS STRING)) END AS target_ref,
          CASE doc_id % 3 WHEN 0 THEN 'relates_to' WHEN 1 THEN 'depends_on' ELSE 'mentions' END AS relation,
          CASE WHEN doc_id % 2 = 0 THEN 'frontmatter' ELSE 'wikilink' END AS source_kind, CAST(1700000000 + doc_id AS BIGINT) AS created_at
        FROM documents""",
    "aliases": "SELECT CAST(doc_id AS BIGINT) AS doc_id, concat('alias-', CAST(doc_id % 37 AS STRING)) AS alias FROM documents",
    "doc_links": """
        SELECT DISTINCT CAST(c_custkey % 211 AS BIGINT) AS src, CAST((c_custkey * 7 + c_nationkey * 31) % 400 + 100 AS BIGINT) AS dst,
          CASE (c_custkey + c_nationkey) % 3 WHEN 0 THEN 'relates_to' WHEN 1 THEN 'depends_on' ELSE 'mentions' END AS relation
        FROM customer""",
    "evolution": """
        SELECT CAST(doc_id AS BIGINT) AS id, CAST(doc_id AS BIGINT) AS source_doc_id, CAST(doc_id - 1 - doc_id % 3 AS BIGINT) AS target_doc_id,
          CASE doc_id % 5 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'updates' WHEN 2 THEN 'corrects' WHEN 3 THEN 'retracts' ELSE 'extends' END AS relationship,
          CAST(1700000000 + doc_id * 60 AS BIGINT) AS created_at
        FROM documents WHERE doc_id >= 4""",
    "memory_edges": """
        SELECT concat('m-', CAST(doc_id AS STRING)) AS source_id, concat('m-', CAST((doc_id * 13 + 7) % 1000 AS STRING)) AS target_ref, 'memory' AS target_kind,
          CASE doc_id % 5 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'relates_to' WHEN 2 THEN 'contradicts' WHEN 3 THEN 'supersedes' ELSE 'supports' END AS relation,
          CAST(1700000000 + doc_id * 11 AS BIGINT) AS created_at
        FROM documents""",
    "commits": "SELECT CAST(l_orderkey AS BIGINT) AS commit_id, concat('src/f', CAST(l_partkey % 500 AS STRING), '.rs') AS path FROM lineitem",
    "code_files": """
        SELECT DISTINCT CAST(p_partkey % 97 AS BIGINT) AS file_id, concat('src/m', CAST(p_partkey % 97 % 19 AS STRING), '/f', CAST(p_partkey % 97 AS STRING), '.rs') AS path,
          CASE p_partkey % 97 % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'rust' END AS language,
          CAST(1700000000 + p_partkey % 97 * 1000 AS BIGINT) AS mtime, CAST(100 + p_partkey % 97 * 3 AS BIGINT) AS token_estimate
        FROM part""",
    "symbols": """
        SELECT CAST(p_partkey AS BIGINT) AS id, concat('fn', CAST(p_partkey % 1555 AS STRING)) AS name,
          CASE p_partkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'struct' ELSE 'function' END AS kind,
          CAST(p_partkey % 97 AS BIGINT) AS file_id, concat('src/m', CAST(p_partkey % 97 % 19 AS STRING), '/f', CAST(p_partkey % 97 AS STRING), '.rs') AS file_path,
          CAST(p_partkey % 50 * 20 + 1 AS BIGINT) AS line_start, CAST(p_partkey % 50 * 20 + 1 + p_size AS BIGINT) AS line_end, CAST(p_partkey % 8 AS BIGINT) AS col_start,
          CASE WHEN p_partkey % 1555 % 3 = 0 THEN concat('app::Own', CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 1555 % 23 ELSE p_partkey % 23 END AS STRING)) END AS owner_name,
          CASE WHEN p_partkey % 5 <> 0 THEN concat('app::m', CAST(p_partkey % 97 % 19 AS STRING)) END AS module_path,
          CASE p_partkey % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'package' WHEN 2 THEN 'crate' WHEN 3 THEN 'module' WHEN 4 THEN 'restricted' ELSE 'private' END AS visibility,
          concat('fn ', p_name, '(', p_brand, ')') AS signature, p_type AS doc_comment, CAST(p_size AS BIGINT) AS nodes
        FROM part""",
    "relationships": """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, CAST(l_partkey AS BIGINT) AS from_symbol_id, CAST(l_partkey % 97 AS BIGINT) AS file_id, 'Calls' AS kind,
          concat('fn', CAST((l_suppkey * 7 + l_linenumber) % 1650 AS STRING)) AS to_name,
          CASE WHEN l_orderkey % 5 = 0 THEN concat('Own', CAST(l_suppkey % 23 AS STRING)) WHEN l_orderkey % 5 = 1 THEN concat('m', CAST(l_suppkey % 19 AS STRING)) END AS to_qualifier,
          CASE WHEN l_orderkey % 5 = 2 THEN concat('Own', CAST(l_suppkey % 23 AS STRING)) END AS to_receiver_type,
          CASE WHEN l_orderkey % 5 = 3 AND l_linenumber % 2 = 0 THEN concat('fn', CAST(l_suppkey * 17 % 2000 AS STRING)) END AS to_receiver_call
        FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) AS u""",
    "imports": "SELECT DISTINCT CAST(p_partkey % 97 AS BIGINT) AS file_id, concat('app::m', CAST((p_partkey % 97 * 5 + p_partkey % 3) % 19 AS STRING)) AS path FROM part",
    "literals": "SELECT CAST(doc_id AS BIGINT) AS id, concat('src/m', CAST(doc_id % 19 AS STRING), '/f', CAST(doc_id % 97 AS STRING), '.rs') AS path, CAST(doc_id % 300 + 1 AS BIGINT) AS line, text AS value FROM documents",
    "query_events": """
        SELECT event_id AS id, event_type AS search_type, concat('q', CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 25 * 150 + user_id AS STRING)) AS query_hash, user_id AS session_id,
          CAST(floor(value) AS BIGINT) AS latency_ms, CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS BIGINT) AS result_count,
          value / 500 AS top_score, EPOCH(ts) AS created_at
        FROM events""",
    "calls": """
        SELECT event_id AS id, user_id AS session_id, event_type AS tool, CAST(floor(value) AS BIGINT) AS tokens, CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS BIGINT) AS results,
          CAST(event_id % 23 = 0 AS INT) AS truncated, EPOCH(ts) AS at_s
        FROM events""",
    "hook_events": """
        SELECT event_id AS id, EPOCH(ts) AS at_s, CASE event_type WHEN 'click' THEN 'pre_tool' WHEN 'view' THEN 'user_prompt_submit' WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'mining' ELSE 'stop' END AS event,
          CASE event_id % 7 WHEN 0 THEN 'fired' WHEN 1 THEN 'deadline' WHEN 2 THEN 'invoked' WHEN 3 THEN 'failed' ELSE 'skipped' END AS outcome,
          CAST(floor(value) AS BIGINT) AS elapsed_ms, CAST(CASE WHEN event_id % 4 = 0 THEN CAST(regexp_extract(props, '[0-9]+', 0) AS INT) ELSE 0 END AS BIGINT) AS payload_bytes,
          CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 50 ELSE 0 END AS BIGINT) AS docs_bytes, CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 31 ELSE 0 END AS BIGINT) AS memory_bytes,
          concat('r', CAST(event_id % 12 AS STRING)) AS reason
        FROM events""",
    "recall_prompts": "SELECT event_id AS id, user_id AS session, CASE WHEN event_id % 3 = 0 THEN 'hybrid' WHEN event_id % 3 = 1 THEN 'bm25' ELSE 'embedding' END AS mode, EPOCH(ts) AS created_at FROM events WHERE event_type = 'view'",
    "recall_candidates": """
        SELECT event_id AS prompt_id, concat('m-', CAST((event_id * 31 + k) % 1000 AS STRING)) AS entry_id, k AS rank, CASE WHEN (event_id + k) % 9 > 0 THEN (event_id * 17 + k * 311) % 7000 / 10000e0 END AS cosine,
          CASE (event_id * 31 + k) % 6 WHEN 0 THEN 'topic' WHEN 1 THEN 'problem' WHEN 2 THEN 'decision' WHEN 3 THEN 'reminder' WHEN 4 THEN 'prior' ELSE 'handoff' END AS entry_type,
          (event_id + k) % 2 = 0 AS injected, event_id % 10 = 0 AS holdout,
          CASE WHEN (event_id * 7 + k) % 4 = 0 THEN CASE WHEN (event_id + k) % 2 = 1 THEN 'missed' WHEN event_id % 5 = 0 THEN 'refuted' WHEN event_id % 5 = 1 THEN 'corrected' WHEN event_id % 5 = 2 THEN 'confirmed' ELSE 'used' END END AS outcome
        FROM events, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS ks WHERE event_type = 'view'""",
    "clusters": """
        SELECT concat('c-', CAST(p_partkey AS STRING)) AS id, CAST(p_partkey AS BIGINT) AS n, CASE p_partkey % 3 WHEN 0 THEN 'pre_tool' WHEN 1 THEN 'post_tool' ELSE 'prompt' END AS trigger_kind,
          CASE WHEN p_partkey % 2 = 0 THEN CASE p_partkey % 5 WHEN 0 THEN 'Click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'SIGNUP' ELSE 'purchase' END END AS tool,
          CASE WHEN p_partkey % 3 = 1 THEN p_type END AS error_contains, concat('error ', p_name, ' ', p_type, ' line ', CAST(p_size AS STRING)) AS error_signature,
          CASE WHEN p_partkey % 4 < 3 THEN 'promoted' ELSE 'candidate' END AS state, CAST(p_size % 6 AS BIGINT) AS distinct_sessions, CAST(p_size AS BIGINT) AS evidence_count,
          CAST(p_partkey % 5 AS BIGINT) AS confirmed_count, CAST(p_partkey % 3 AS BIGINT) AS refuted_count, CAST(p_partkey % 4 AS BIGINT) AS misfired_count,
          CAST(1700000000 + p_partkey * 2000 AS BIGINT) AS last_seen_at, CAST(CASE WHEN p_partkey % 6 = 0 THEN 1701000000 + p_partkey * 1500 END AS BIGINT) AS last_unrefuted_injection_at
        FROM part""",
    "injections": "SELECT concat('c-', CAST(event_id % 200 AS STRING)) AS cluster_id, user_id AS session, EPOCH(ts) AS injected_at, CASE WHEN event_id % 3 = 0 THEN 'unrefuted' END AS outcome FROM events WHERE event_type = 'click'",
    "errors": "SELECT event_id AS id, user_id AS session, CASE WHEN event_id % 6 > 0 THEN EPOCH(ts) END AS at_s, concat('Error ', CASE event_id % 3 WHEN 0 THEN 'small ring' WHEN 1 THEN 'red widget' ELSE 'blue bolt' END, ' ECONOMY at ', CAST(event_id AS STRING)) AS signature FROM events WHERE event_type = 'error'",
    "candidates": "SELECT event_id AS id, concat('c-', CAST(event_id % 60 AS STRING)) AS cluster_id, user_id AS session, EPOCH(ts) AS created_at FROM events WHERE event_type = 'purchase'",
    "experiment_results": "SELECT event_id AS id, CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 3 AS BIGINT) AS experiment_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, value / 500 AS score, CAST(floor(value) AS BIGINT) AS latency_ms, CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 7 AS BIGINT) AS result_count FROM events",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
    "external": "SELECT source, CAST(doc_id % 60 AS STRING) AS id, CAST(doc_id AS BIGINT) AS revision, title, deleted FROM (SELECT doc_id, source, concat('Note ', CAST(doc_id AS STRING)) AS title, doc_id % 7 = 0 AS deleted FROM documents) AS e",
}

_NAMES = "|".join(sorted([*DERIVED], key=len, reverse=True))


def _uses(sql: str, among: str) -> list[str]:
    return list(dict.fromkeys(re.findall(rf"(?<![\w.'-])({among})(?![\w(.'-])", sql)))


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The engine table ``name`` over the driver's tables in ``sf_dir``."""
    sql = re.sub(r"EPOCH\((\w+)\)", r"CAST(CAST(\1 AS TIMESTAMP) AS BIGINT)", DERIVED[name])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _uses(sql, "|".join(BASE))}
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def with_derived(sql: str) -> str:
    """``sql`` for DuckDB with the engine tables that it names as common table expressions."""
    body = sql.strip()
    ctes = [f"{t} AS ({re.sub(r'EPOCH[(]([a-z]+)[)]', r'CAST(floor(epoch(\1)) AS BIGINT)', DERIVED[t]).strip()})" for t in DERIVED if re.search(rf"\b(FROM|JOIN|,)\s+{t}\b", body)]
    if not ctes:
        return body
    if m := re.match(r"WITH(\s+RECURSIVE)?\s", body):
        return f"WITH{m[1] or ''} {', '.join(ctes)}, {body[m.end():]}"
    return f"WITH {', '.join(ctes)} {body}"


class Tables:
    """Base and derived tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def once(self, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """The rows of ``build()``, written by the first query that needs them and read by the others, until the files of ``sources`` change."""
        root = f"{commits.shared_dir(self.spark)}/corpora/{name}-{commits.fingerprint(self.spark, *[f'{self.sf_dir}/{s}.parquet' for s in sources])}"
        version, content = commits.latest(self.spark, root)
        if not content:
            content = {"rows": uuid.uuid4().hex}
            build().write.option("compression", "zstd").parquet(f"{root}/{content['rows']}")
            commits.publish(self.spark, root, version + 1, content)
        return self.spark.read.parquet(f"{root}/{content['rows']}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in DERIVED:
            return derived(self.spark, self.sf_dir, name)
        raise AttributeError(name)
