"""Memory, priors, telemetry, experiments, streams, catalogue and sources (MEM, PRI, TEL, EXP, STM, CAT, SRC)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as X
from ..operators import memory as M, priors as P, relational as R, telemetry as T
from ..sources import ignore, logs as L
from ..storage import commits
from ..storage.snapshots import Snapshots
from ..streaming import streams as ST, watch as WT
from .filters import visible, _VISIBLE
from .catalog import query
from .relational import _SIG
from .tables import DAY, NOW


@query("MEM01", "SELECT id, entry_type, coalesce(expires_at, CASE WHEN entry_type = 'prior' THEN created_at + 30 * 86400 END) AS expires_at FROM memory WHERE length(title) BETWEEN 1 AND 200 QUALIFY row_number() OVER (PARTITION BY title ORDER BY created_at, rowid) = 1")
def _(t):
    """Two batches of entries into a store by title: the first one created counts, whichever batch brings it; the first batch comes twice."""
    valid = t.memory.where(F.length("title").between(1, 200))
    entries = valid.select("title", "id", "entry_type", F.coalesce("expires_at", F.when(F.col("entry_type") == "prior", F.col("created_at") + 30 * DAY)).alias("expires_at"), (-(F.col("created_at") * 1_000_000_000 + F.col("rowid"))).alias("earlier"), F.col("rowid"))
    store = Snapshots(t.spark, commits.fresh_dir(t.spark, "memory"), "title string, id string, entry_type string, expires_at long, earlier long", ["title"], "earlier", 8)
    for number in (0, 1, 0):
        store.merge(entries.where(F.col("rowid") % 2 == number), batch=number)
    return store.read().select("id", "entry_type", "expires_at")


@query("MEM02", "SELECT entry_id, count(*) FILTER (outcome = 'confirmed') AS confirmations, count(*) FILTER (outcome IN ('refuted', 'corrected')) AS corrections, max(prompt_id) FILTER (outcome = 'confirmed') AS last_confirmed FROM recall_candidates GROUP BY entry_id")
def _(t):
    o = F.col("outcome")
    return t.recall_candidates.groupBy("entry_id").agg(F.count_if(o == "confirmed").alias("confirmations"), F.count_if(o.isin("refuted", "corrected")).alias("corrections"), F.max(F.when(o == "confirmed", F.col("prompt_id"))).alias("last_confirmed"))


@query("MEM03", "SELECT id, last_refuted_at IS NOT NULL AND corrections > 0 AND (last_confirmed_at IS NULL OR last_refuted_at > last_confirmed_at) AS disputed FROM memory")
def _(t):
    return t.memory.select("id", M.disputed().alias("disputed"))


@query("MEM04")
def _(t):
    from ..functions.diffs import unified_diff

    return t.docs.select("id", unified_diff(F.col("title"), F.concat("title", F.lit("\nmore"))).alias("diff"))


@query("MEM05", f"SELECT id, CASE WHEN expires_at <= {NOW} THEN 'expire' WHEN status = 'archived' AND updated_at < {NOW} - 30 * 86400 THEN 'prune' ELSE 'keep' END AS action FROM memory")
def _(t):
    return t.memory.select("id", F.when(F.col("expires_at") <= NOW, "expire").when((F.col("status") == "archived") & (F.col("updated_at") < NOW - 30 * DAY), "prune").otherwise("keep").alias("action"))


@query("MEM06", f"""SELECT id, string_agg(signal, ',' ORDER BY signal) AS signals FROM (SELECT id, 'expired' AS signal FROM memory WHERE expires_at <= {NOW} UNION ALL SELECT id, 'disputed' FROM memory WHERE last_refuted_at IS NOT NULL AND corrections > 0 AND (last_confirmed_at IS NULL OR last_refuted_at > last_confirmed_at)
    UNION ALL SELECT DISTINCT source_id, 'contradiction' FROM memory_edges WHERE relation = 'contradicts' UNION ALL SELECT id, 'aged' FROM memory WHERE entry_type IN ('reminder', 'prior', 'handoff') AND created_at < {NOW} - 40 * 86400) AS s GROUP BY id""")
def _(t):
    s = lambda df, name, key="id": df.select(F.col(key).alias("id"), F.lit(name).alias("signal")).distinct()
    m = t.memory
    signals = s(m.where(F.col("expires_at") <= NOW), "expired").unionByName(s(m.where(M.disputed()), "disputed")).unionByName(s(t.memory_edges.where("relation = 'contradicts'"), "contradiction", "source_id")).unionByName(s(m.where(~F.col("entry_type").isin(*M.DURABLE) & (F.col("created_at") < NOW - 40 * DAY)), "aged"))
    return signals.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("signal")), ",").alias("signals"))


@query("MEM07", """WITH f AS (SELECT id, CASE WHEN rowid % 5 = 0 THEN 'new' ELSE 'h' END AS fh FROM memory WHERE rowid % 7 <> 3 UNION ALL SELECT concat('x-', CAST(item_id AS STRING)), 'h' FROM benchmark), r AS (SELECT id, CASE WHEN rowid % 4 = 0 THEN 'mine' ELSE 'h' END AS rh, 'h' AS ph, status FROM memory),
    a AS (SELECT coalesce(f.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'import' WHEN f.id IS NOT NULL AND status = 'archived' THEN 'revive' WHEN f.id IS NULL AND status = 'archived' THEN 'none' WHEN f.id IS NULL THEN 'archive' WHEN fh = rh THEN 'none' WHEN fh = ph THEN 'project' WHEN rh = ph THEN 'adopt' ELSE 'conflict' END AS action FROM f FULL JOIN r ON r.id = f.id)
    SELECT id, CASE WHEN action = 'archive' AND (SELECT count(*) FROM a WHERE action = 'archive') > 10 THEN 'held' ELSE action END AS action FROM a""")
def _(t):
    files = t.memory.where("rowid % 7 <> 3").select("id", F.when(F.col("rowid") % 5 == 0, "new").otherwise("h").alias("file_hash")).unionByName(t.benchmark.select(F.concat(F.lit("x-"), F.col("item_id").cast("string")).alias("id"), F.lit("h").alias("file_hash")))
    rows = t.memory.select("id", F.when(F.col("rowid") % 4 == 0, "mine").otherwise("h").alias("row_hash"), F.lit("h").alias("projected_hash"), "status")
    return M.reconcile(files, rows)


@query("MEM08", "SELECT source, count(*) AS n, md5(string_agg(title, chr(10) ORDER BY rowid)) AS digest FROM memory WHERE entry_type = 'problem' AND status = 'active' GROUP BY source")
def _(t):
    g = t.memory.where("entry_type = 'problem' AND status = 'active'").groupBy("source").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rowid", "title"))).alias("x"))
    return g.select("source", "n", F.md5(F.array_join(F.col("x.title"), "\n").cast("binary")).alias("digest"))


@query("MEM09", "SELECT DISTINCT cluster_id, session FROM injections")
def _(t):
    return ST.first_per_session(t.injections).select("cluster_id", "session")


@query("PRI01", "SELECT conv_id, count(*) FILTER (role = 'user') AS user_messages, count(*) AS records, arg_max(role, turn) = 'assistant' AS ended_clean FROM turns GROUP BY conv_id")
def _(t):
    return t.turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_messages"), F.count("*").alias("records"), (F.max_by("role", "turn") == "assistant").alias("ended_clean"))


@query("PRI02", "SELECT session, bool_or(outcome = 'failed') AND arg_max(outcome, id) <> 'failed' AS error_fixed FROM (SELECT id % 150 AS session, id, outcome FROM hook_events) AS h GROUP BY session")
def _(t):
    h = t.hook_events.select((F.col("id") % 150).alias("session"), "id", "outcome")
    return h.groupBy("session").agg((F.bool_or(F.col("outcome") == "failed") & (F.max_by("outcome", "id") != "failed")).alias("error_fixed"))


@query("PRI03", "SELECT n, n % 3 > 0 AND n % 5 > 0 AS valid FROM clusters")
def _(t):
    lesson = F.when(F.col("n") % 5 == 0, F.rpad(F.lit("x"), 200, "x")).otherwise(F.lit("Use the lock"))
    raw = F.when(F.col("n") % 3 == 0, F.lit("{bad")).otherwise(F.to_json(F.struct(F.lit(True).alias("is_reusable"), lesson.alias("lesson"), F.struct(F.col("trigger_kind").alias("kind"), F.lit("Edit").alias("tool")).alias("trigger"))))
    d = F.from_json(raw, "is_reusable boolean, lesson string, trigger struct<kind: string, tool: string>")
    ok = d["is_reusable"] & F.length(d["lesson"]).between(1, 160) & d["trigger"]["kind"].isin("pre_tool", "post_tool", "prompt") & d["trigger"]["tool"].isNotNull()
    return t.clusters.select("n", F.coalesce(ok, F.lit(False)).alias("valid"))


@query("PRI04")
def _(t):
    c = t.candidates.select((F.col("id") % 500).alias("vec_id"), "id", "created_at", F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"))
    return P.cluster_candidates(c.join(t.embeddings.select("vec_id", F.col("embedding").alias("v")), "vec_id"))


@query("PRI05", f"""WITH RECURSIVE c AS MATERIALIZED (SELECT k.id, k.id % 7 AS key, e.vec_id, e.embedding::DOUBLE[] AS v FROM candidates k JOIN embeddings e ON e.vec_id = k.id % 500),
    n AS MATERIALIZED (SELECT key, vec_id, any_value(v) AS v, min(id) AS id FROM c GROUP BY key, vec_id), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.key = b.key AND a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= {P.SAME_CLUSTER}),
    w AS (SELECT id, id AS r FROM n UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.r), g AS (SELECT id, min(r) AS cluster FROM w GROUP BY id)
    SELECT c.id, cluster FROM c JOIN n ON n.key = c.key AND n.vec_id = c.vec_id JOIN g ON g.id = n.id""")
def _(t):
    c = t.candidates.select((F.col("id") % 500).alias("vec_id"), "id", (F.col("id") % 7).alias("key"))
    return P.reclustered(c.join(t.embeddings.select("vec_id", F.col("embedding").alias("v")), "vec_id"))


@query("PRI06", "SELECT cluster_id FROM candidates GROUP BY cluster_id HAVING count(DISTINCT session) >= 2")
def _(t):
    return t.candidates.groupBy("cluster_id").agg(F.countDistinct("session").alias("s")).where(F.col("s") >= P.PROMOTE_SESSIONS).select("cluster_id")


@query("PRI07", "SELECT id, trigger_kind = 'pre_tool' AND (tool IS NOT NULL OR error_contains IS NOT NULL) AND coalesce(lower(tool) = 'click', tool IS NULL) AND error_contains IS NULL AS fires FROM clusters")
def _(t):
    none = F.lit(None).cast("string")
    c = t.clusters.withColumns({"path_regex": none, "command_contains": none, "prompt_contains": none})
    return c.select("id", P.trigger_matches(F.lit("pre_tool"), F.lit("CLICK"), none, F.lit("ls"), none, none).alias("fires"))


_SETTLED = f"""k AS (SELECT id, {_SIG.format('error_signature')} AS ks FROM clusters), e AS (SELECT session, at_s, {_SIG.format('signature')} AS es FROM errors), o AS (SELECT cluster_id, session, min(injected_at) AS injected_at FROM injections WHERE outcome IS NULL GROUP BY ALL),
    s AS (SELECT o.cluster_id, o.session, CASE WHEN coalesce(bool_or((e.at_s IS NULL OR e.at_s >= o.injected_at) AND len(list_intersect(ks, es)) / len(ks) >= 0.6), false) THEN 'refuted' ELSE 'unrefuted' END AS outcome FROM o JOIN k ON k.id = o.cluster_id LEFT JOIN e ON e.session = o.session GROUP BY ALL)"""


@query("PRI08", f"WITH {_SETTLED} SELECT * FROM s")
def _(t):
    return P.settle(t.injections, t.clusters, t.errors)


@query("PRI08_demoted", f"WITH {_SETTLED}, n AS (SELECT cluster_id AS id, count(*) AS new FROM s WHERE outcome = 'refuted' GROUP BY 1) SELECT c.id, (c.refuted_count + new)::BIGINT AS refuted_count FROM clusters c JOIN n ON n.id = c.id WHERE state = 'promoted' AND c.refuted_count + new > confirmed_count AND confirmed_count + c.refuted_count + new >= 3")
def _(t):
    return P.demoted(t.clusters, P.settle(t.injections, t.clusters, t.errors))


_OUT = ["used", "missed", "confirmed", "corrected", "refuted"]


@query("TEL01", "SELECT entry_id, max(CASE outcome WHEN 'used' THEN 1 WHEN 'missed' THEN 2 WHEN 'confirmed' THEN 3 WHEN 'corrected' THEN 4 WHEN 'refuted' THEN 5 ELSE 0 END) AS strongest FROM recall_candidates GROUP BY entry_id")
def _(t):
    rank = F.array_position(F.array(*map(F.lit, _OUT)), F.coalesce("outcome", F.lit("")))
    return t.recall_candidates.groupBy("entry_id").agg(F.max(rank).alias("strongest"))


@query("TEL02", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'prompt' WHEN contains(text, 'ein') THEN 'use' ELSE 'reply' END AS event FROM turns WHERE role <> 'system'")
def _(t):
    raw = t.turns.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("line"), F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message"))).alias("value"))
    r = L.parse_records(raw)
    return r.select(F.col("file").cast("long").alias("conv_id"), F.col("line").cast("long").alias("turn"), F.when(F.col("type") == "user", "prompt").when(F.contains("text", F.lit("ein")), "use").otherwise("reply").alias("event"))


@query("TEL03", "SELECT search_type, count(*) AS kept FROM query_events WHERE created_at >= (SELECT max(created_at) FROM query_events) - 10 * 86400 GROUP BY search_type")
def _(t):
    last = t.query_events.agg((F.max("created_at") - 10 * DAY).alias("cut"))
    return t.query_events.crossJoin(F.broadcast(last)).where("created_at >= cut").groupBy("search_type").agg(F.count("*").alias("kept"))


@query("EXP01", "SELECT experiment_id, count(*) AS results, min(n) >= 50 AS enough FROM (SELECT experiment_id, variant, count(*) AS n FROM experiment_results GROUP BY ALL) AS v GROUP BY experiment_id")
def _(t):
    return T.variant_stats(t.experiment_results).groupBy("experiment_id").agg(F.count("*").alias("results"), (F.min("n") >= 50).alias("enough"))


# --- streams: the result of a run over all that is there equals that of the table ---------------------------------


_CHANGES = "SELECT concat('src/f', CAST(event_id % 300 AS STRING), CASE event_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.rs' WHEN 2 THEN '.txt' ELSE '.bin' END) AS path, CASE event_type WHEN 'view' THEN 'accessed' WHEN 'click' THEN 'modified' WHEN 'signup' THEN 'created' WHEN 'error' THEN 'removed' ELSE 'modified' END AS kind, event_id AS at_s FROM events"


def _changed(events):
    kind = F.when(F.col("event_type") == "view", "accessed").when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "removed").otherwise("modified")
    end = F.element_at(F.array(*map(F.lit, (".md", ".rs", ".txt", ".bin"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(F.concat(F.lit("src/f"), (F.col("event_id") % 300).cast("string"), end).alias("path"), kind.alias("kind"), F.col("event_id").alias("at_s"))


def _changes(t):
    return _changed(t.events)


@query("STM01", f"SELECT path, arg_max(kind, CASE kind WHEN 'removed' THEN 3 WHEN 'created' THEN 2 ELSE 1 END::BIGINT * 1000000000 + at_s) AS kind, max(at_s) AS at_s FROM ({_CHANGES}) AS c WHERE kind <> 'accessed' GROUP BY path")
def _(t):
    return ST.collapsed_changes(_changes(t))


@query("STM02", f"SELECT path, at_s AS body FROM (SELECT path, max(at_s) AS at_s, arg_max(kind, at_s) AS kind FROM ({_CHANGES}) AS c WHERE kind <> 'accessed' GROUP BY path) AS l WHERE kind <> 'removed'")
def _(t):
    """The events as a stream of changes into a store, by the changed paths or, beyond the bound, by a rescan."""
    last = _changes(t).where("kind <> 'accessed'").groupBy("path").agg(F.max("at_s").alias("body"), F.max_by("kind", "at_s").alias("kind"))
    disk = commits.kept(last.where("kind <> 'removed'").select("path", "body"), "disk")
    store = Snapshots(t.spark, commits.fresh_dir(t.spark, "watched"), "path string, body long, seq long", ["path"], "seq", 8)
    ST.run(_changed(ST.table_stream(t.spark, t.sf_dir, "events")), WT.BoundedUpdates(store, lambda: disk), f"{store.root}/checkpoint")
    return store.read().select("path", "body")


@query("STM03", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
    e AS (SELECT user_id, b, max(ts) AS last FROM (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM x) AS g GROUP BY user_id, b)
    SELECT user_id, count(*) AS n FROM e WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY user_id""")
def _(t):
    """Each user's changes as a stream, flushed by timers once they were idle for half an hour; bursts that the watermark hasn't closed wait."""
    WT.with_timers(t.spark)
    changes = ST.table_stream(t.spark, t.sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("path"), F.lit("changed").alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    out = ST.run_once(WT.flushes(changes, WT.FlushTimers(idle=1_800, retry=600), "1 hour"), "flushes", "append")
    return out.groupBy(F.col("key").cast("long").alias("user_id")).agg(F.count("*").alias("n"))


@query("STM04", f"SELECT path, CASE WHEN suffix(path, '.md') OR suffix(path, '.txt') THEN 'doc' WHEN suffix(path, '.rs') THEN 'code' ELSE 'none' END AS route FROM (SELECT DISTINCT path FROM ({_CHANGES}) AS c) AS d")
def _(t):
    return _changes(t).select("path").distinct().select("path", ST.routes().alias("route"))


@query("STM05", "SELECT DISTINCT cluster_id, session FROM injections WHERE injected_at >= 1704067200 + 5 * 86400")
def _(t):
    return ST.first_per_session(t.injections.where(F.col("injected_at") >= 1704067200 + 5 * DAY)).select("cluster_id", "session")


@query("STM06", "SELECT session_id, tool, count(*) AS calls, sum(tokens)::BIGINT AS tokens FROM calls GROUP BY ALL")
def _(t):
    return ST.running_counts(t.calls)


_CUT = "(SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'error')) - INTERVAL 10 MINUTE - INTERVAL 2 DAY - INTERVAL 1 SECOND FROM events)"


@query("STM07", f"""WITH i AS (SELECT event_id AS id, user_id, ts, event_id % 3 AS g FROM events WHERE event_type = 'click' AND ts < {_CUT}), e AS (SELECT user_id, ts, event_id % 3 AS g FROM events WHERE event_type = 'error')
    SELECT id, bool_or(e.ts IS NOT NULL) AS refuted FROM i LEFT JOIN e ON e.user_id = i.user_id AND e.g = i.g AND e.ts >= i.ts AND e.ts <= i.ts + INTERVAL 2 DAY GROUP BY id""")
def _(t):
    """Clicks as injections and errors as two streams, settled two days after; every sixth error has no time of its own."""
    stream = lambda kind: ST.table_stream(t.spark, t.sf_dir, "events").where(F.col("event_type") == kind).withColumn("at", F.col("ts").cast("timestamp"))
    i = stream("click").select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.col("at").alias("injected_at"), (F.col("event_id") % 3).alias("signature"))
    e = stream("error").select(F.col("user_id").alias("error_session"), F.col("at").alias("seen_at"), F.when(F.col("event_id") % 6 > 0, F.col("at")).alias("at"), (F.col("event_id") % 3).alias("error_signature"))
    out = ST.run_once(WT.settled(i, e, F.col("signature") == F.col("error_signature"), "2 days"), "settled", "append")
    # clicks whose two days the watermark hasn't passed may still be refuted
    ends = t.events.where("event_type IN ('click', 'error')").groupBy("event_type").agg(F.max("ts").alias("ts")).agg(F.expr("min(ts) - interval 10 minutes - interval 2 days - interval 1 second").alias("cut"))
    due = t.events.join(F.broadcast(ends), F.col("ts") < F.col("cut")).select(F.col("event_id").alias("id"))
    return out.groupBy("id").agg(F.max("refuted").alias("refuted")).join(due, "id", "left_semi")


# --- catalogue --------------------------------------------------------------------------------------------------


@query("CAT01", "SELECT CASE WHEN collection = 'src1' THEN 'renamed' ELSE collection END AS collection, count(*) AS n FROM docs WHERE collection <> 'src2' GROUP BY 1")
def _(t):
    return t.docs.where("collection <> 'src2'").groupBy(F.when(F.col("collection") == "src1", "renamed").otherwise(F.col("collection")).alias("collection")).agg(F.count("*").alias("n"))


@query("CAT02", "SELECT DISTINCT collection, length(collection) BETWEEN 1 AND 100 AND regexp_full_match(collection, '[A-Za-z0-9._-]+') AS valid FROM docs")
def _(t):
    return t.docs.select("collection").distinct().select("collection", (F.length("collection").between(1, 100) & F.col("collection").rlike("^[A-Za-z0-9._-]+$")).alias("valid"))


@query("CAT03", "SELECT id, path FROM docs WHERE NOT starts_with(path, 'src4/') AND id <> 10")
def _(t):
    return t.docs.where(~F.col("path").startswith("src4/") & (F.col("id") != 10)).select("id", "path")


@query("CAT04", "SELECT item_id, d.id FROM benchmark b JOIN docs d ON d.id = b.item_id * 2 WHERE item_id % 2 = 0 UNION ALL SELECT item_id, d.id FROM benchmark b JOIN docs d ON d.path = concat('src', CAST(item_id % 20 AS STRING), '/en/d', CAST(item_id AS STRING), '.md') WHERE item_id % 2 = 1")
def _(t):
    ref = F.when(F.col("item_id") % 2 == 0, (F.col("item_id") * 2).cast("string")).otherwise(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit("/en/d"), F.col("item_id").cast("string"), F.lit(".md")))
    asked = t.benchmark.select("item_id", ref.alias("ref"))
    by_id = asked.select("item_id", F.col("ref").try_cast("long").alias("id")).join(t.docs.select("id"), "id").select("item_id", "id")
    return by_id.unionByName(asked.join(t.docs.select("id", F.col("path").alias("ref")), "ref").select("item_id", "id"))


@query("CAT05", "SELECT id, coalesce(status, 'current') AS status FROM docs WHERE id NOT IN (SELECT target_doc_id FROM evolution WHERE relationship = 'supersedes')")
def _(t):
    gone = t.evolution.where("relationship = 'supersedes'").select(F.col("target_doc_id").alias("id"))
    return t.docs.join(gone, "id", "left_anti").select("id", F.coalesce("status", F.lit("current")).alias("status"))


@query("CAT06", "SELECT relationship, count(*) AS n, max(created_at) AS last FROM evolution GROUP BY relationship")
def _(t):
    return t.evolution.groupBy("relationship").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))


@query("CAT07", "SELECT id, target_ref FROM edges WHERE source_kind <> 'wikilink'")
def _(t):
    return t.edges.where("source_kind <> 'wikilink'").select("id", "target_ref")


@query("CAT08", "SELECT relation AS key, count(*) AS hits FROM edges WHERE relation <> 'mentions' GROUP BY relation ORDER BY hits DESC, key")
def _(t):
    return t.edges.where("relation <> 'mentions'").groupBy(F.col("relation").alias("key")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "key")


@query("CAT09", "SELECT e.id, d.path FROM edges e JOIN docs d ON d.path = regexp_replace(e.target_ref, '^[.]/', '')")
def _(t):
    return t.edges.select("id", F.regexp_replace("target_ref", r"^\./", "").alias("path")).join(t.docs.select("path"), "path").select("id", "path")


@query("CAT10", "SELECT relation, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM doc_links GROUP BY relation")
def _(t):
    return t.doc_links.groupBy("relation").agg(F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("CAT11", "SELECT id, access_count + (SELECT count(*) FROM recall_candidates c WHERE c.entry_id = m.id AND c.injected) AS accesses FROM memory m WHERE starts_with(id, 'm-1')")
def _(t):
    used = t.recall_candidates.where("injected").groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("n"))
    return t.memory.where(F.col("id").startswith("m-1")).join(used, "id", "left").select("id", (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("accesses"))


@query("CAT12", "SELECT id, CASE WHEN rowid % 50 = 0 THEN 'superseded' ELSE status END AS status, CASE WHEN rowid % 50 = 0 THEN 2 ELSE 1 END AS version FROM memory")
def _(t):
    log = t.memory.select("id", "status", F.lit(1).alias("version")).unionByName(t.memory.where("rowid % 50 = 0").select("id", F.lit("superseded").alias("status"), F.lit(2).alias("version")))
    return log.groupBy("id").agg(F.max_by("status", "version").alias("status"), F.max("version").alias("version"))


@query("CAT13", "SELECT cluster_id, count(*) AS revisions, min(created_at) AS first, max(created_at) AS last FROM candidates GROUP BY cluster_id")
def _(t):
    return t.candidates.groupBy("cluster_id").agg(F.count("*").alias("revisions"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


@query("CAT14", "SELECT id, coalesce(tool, error_contains) IS NOT NULL AND trigger_kind IN ('pre_tool', 'post_tool', 'prompt') AS valid FROM clusters")
def _(t):
    return t.clusters.select("id", (F.coalesce("tool", "error_contains").isNotNull() & F.col("trigger_kind").isin("pre_tool", "post_tool", "prompt")).alias("valid"))


@query("CAT15", f"SELECT entry_type, status, count(*) AS n FROM memory WHERE {_VISIBLE} GROUP BY ALL")
def _(t):
    return t.memory.where(visible()).groupBy("entry_type", "status").agg(F.count("*").alias("n"))


@query("CAT16", "SELECT a.id, CASE WHEN EXISTS (SELECT 1 FROM memory b WHERE b.title = a.title AND b.rowid < a.rowid) THEN 'duplicate' ELSE 'new' END AS decision FROM memory a")
def _(t):
    first = t.memory.groupBy("title").agg(F.min("rowid").alias("first"))
    return t.memory.join(first, "title").select("id", F.when(F.col("first") < F.col("rowid"), "duplicate").otherwise("new").alias("decision"))


@query("CAT17", "SELECT count(*) FILTER (f IS NULL) AS unprojected, count(*) FILTER (r IS NULL) AS orphaned FROM (SELECT rowid AS r FROM memory) AS a FULL JOIN (SELECT vec_id * 2 AS f FROM embeddings) AS b ON r = f")
def _(t):
    both = t.memory.select(F.col("rowid").alias("k"), F.lit(1).alias("r")).join(t.embeddings.select((F.col("vec_id") * 2).alias("k"), F.lit(1).alias("f")), "k", "full")
    return both.agg(F.count_if(F.col("f").isNull()).alias("unprojected"), F.count_if(F.col("r").isNull()).alias("orphaned"))


@query("CAT18", f"SELECT id FROM memory WHERE status = 'active' AND entry_type <> 'handoff' AND (last_confirmed_at IS NULL OR last_confirmed_at < {NOW} - 20 * 86400)")
def _(t):
    return t.memory.where(f"status = 'active' AND entry_type <> 'handoff' AND (last_confirmed_at IS NULL OR last_confirmed_at < {NOW - 20 * DAY})").select("id")


@query("CAT19", "SELECT d.id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.id AND e.label < 5)")
def _(t):
    return t.docs.select("id").join(t.embeddings.where("label < 5").select(F.col("vec_id").alias("id")), "id", "left_anti")


@query("CAT20", "SELECT m.id, round(list_distance(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 9)), 6) AS distance FROM memory m JOIN embeddings e ON e.vec_id = m.rowid WHERE m.entry_type = 'topic' ORDER BY distance, m.id LIMIT 10")
def _(t):
    from ..operators.vectors import knn

    topics = t.memory.where("entry_type = 'topic'").select("id", F.col("rowid").alias("vec_id")).join(t.embeddings.select("vec_id", F.col("embedding").alias("v")), "vec_id").select("id", "v")
    q = t.embeddings.where("vec_id = 9").select(F.lit(0).alias("query"), F.col("embedding").alias("q"))
    return knn(topics, q, 10).select("id", "distance")


@query("CAT21", "SELECT rowid FROM memory WHERE status = 'active' AND rowid NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    return t.memory.where("status = 'active'").select("rowid").join(t.embeddings.select(F.col("vec_id").alias("rowid")), "rowid", "left_anti")


@query("CAT22", "SELECT cluster_id, arg_max(id, created_at * 100000 + id) AS latest FROM candidates GROUP BY cluster_id")
def _(t):
    return t.candidates.groupBy("cluster_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("latest"))


@query("CAT23", "SELECT cluster_id, session, min(injected_at) AS injected_at FROM injections GROUP BY ALL")
def _(t):
    return t.injections.groupBy("cluster_id", "session").agg(F.min("injected_at").alias("injected_at"))


@query("CAT24", "SELECT session_id, min(at_s) AS started, max(at_s) AS ended, count(*) AS calls FROM calls GROUP BY session_id ORDER BY ended DESC, session_id LIMIT 20")
def _(t):
    return t.calls.groupBy("session_id").agg(F.min("at_s").alias("started"), F.max("at_s").alias("ended"), F.count("*").alias("calls")).orderBy(F.desc("ended"), "session_id").limit(20)


@query("CAT25", "SELECT count(*) AS n, min(created_at) AS oldest, count(*) FILTER (created_at < 1704067200 + 2 * 86400) AS prunable FROM query_events")
def _(t):
    return t.query_events.agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.count_if(F.col("created_at") < 1704067200 + 2 * DAY).alias("prunable"))


@query("CAT26", "SELECT experiment_id, CASE experiment_id WHEN 0 THEN 'active' WHEN 1 THEN 'cancelled' ELSE 'ended' END AS state, count(*) AS n FROM experiment_results GROUP BY ALL")
def _(t):
    state = F.when(F.col("experiment_id") == 0, "active").when(F.col("experiment_id") == 1, "cancelled").otherwise("ended")
    return t.experiment_results.groupBy("experiment_id", state.alias("state")).agg(F.count("*").alias("n"))


@query("CAT27", "SELECT c.prompt_id, c.entry_id FROM recall_candidates c JOIN recall_prompts p ON p.id = c.prompt_id WHERE p.created_at >= 1704067200 + 25 * 86400")
def _(t):
    keep = t.recall_prompts.where(F.col("created_at") >= 1704067200 + 25 * DAY).select(F.col("id").alias("prompt_id"))
    return t.recall_candidates.join(keep, "prompt_id", "left_semi").select("prompt_id", "entry_id")


@query("CAT28", "SELECT file_id, count(*) AS symbols FROM symbols WHERE file_id NOT IN (3, 4) GROUP BY file_id")
def _(t):
    return t.symbols.where(~F.col("file_id").isin(3, 4)).groupBy("file_id").agg(F.count("*").alias("symbols"))


@query("CAT29", "SELECT s.id, f.token_estimate, f.mtime FROM symbols s JOIN code_files f ON f.file_id = s.file_id WHERE s.name IN ('fn1', 'fn2', 'fn3')")
def _(t):
    return t.symbols.where(F.col("name").isin("fn1", "fn2", "fn3")).select("id", "file_id").join(t.code_files.select("file_id", "token_estimate", "mtime"), "file_id").select("id", "token_estimate", "mtime")


@query("CAT30", "SELECT language, count(*) AS files, sum(token_estimate)::BIGINT AS tokens FROM code_files GROUP BY language")
def _(t):
    return t.code_files.groupBy("language").agg(F.count("*").alias("files"), F.sum("token_estimate").alias("tokens"))


@query("CAT31", "SELECT path, CASE WHEN file_id % 5 = 0 THEN 'updated' WHEN file_id % 7 = 0 THEN 'removed' ELSE 'unchanged' END AS change FROM code_files")
def _(t):
    """Given files against the stored table of files: only what changed is merged."""
    store = Snapshots(t.spark, commits.fresh_dir(t.spark, "code"), "path string, hash string, scan long", ["path"], "scan", 4)
    first = store.merge(t.code_files.select("path", F.lit("h").alias("hash"), F.lit(1).alias("scan")), batch=1)
    new = t.code_files.where("file_id % 5 = 0 OR file_id % 7 <> 0").select("path", F.when(F.col("file_id") % 5 == 0, "x").otherwise("h").alias("hash"))
    diff = L.snapshot_diff(store.read().select("path", "hash"), new).where("change <> 'unchanged'")
    store.merge(diff.join(new, "path", "left").select("path", "hash", F.lit(2).alias("scan"), (F.col("change") == "removed").alias("gone")), batch=2, deleted="gone")
    return store.read(first).select("path").join(store.changes(first), "path", "left").select("path", F.coalesce("change", F.lit("unchanged")).alias("change"))


@query("CAT32", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT id FROM symbols WHERE kind <> 'struct')")
def _(t):
    return t.embeddings.select("vec_id").join(t.symbols.where("kind <> 'struct'").select(F.col("id").alias("vec_id")), "vec_id", "left_semi")


@query("CAT33", "SELECT name, count(*) AS members FROM symbols WHERE kind IN ('function', 'method') GROUP BY name HAVING count(*) > 1 AND name NOT IN ('fn0', 'fn1')")
def _(t):
    return t.symbols.where("kind IN ('function', 'method')").groupBy("name").agg(F.count("*").alias("members")).where("members > 1 AND name NOT IN ('fn0', 'fn1')")


@query("CAT34", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS body FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def _(t):
    ls = F.split("text", "\n")
    return t.documents.where(F.size(ls) >= 2).select("doc_id", F.array_join(F.slice(ls, 1, 2), "\n").alias("body"))


@query("CAT35", "SELECT sha256(text) AS hash, min(doc_id) AS id FROM documents GROUP BY text HAVING min(doc_id) NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    first = t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("id"))
    return first.join(t.embeddings.select(F.col("vec_id").alias("id")), "id", "left_anti").select("hash", "id")


@query("CAT36", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') >= 3 AS indexed FROM turns GROUP BY conv_id")
def _(t):
    return t.turns.groupBy("conv_id").agg(F.count("*").alias("turns"), (F.count_if(F.col("role") == "user") >= 3).alias("indexed"))


@query("CAT37", "SELECT id, path FROM docs WHERE status = 'archived' AND indexed_at <= 1700300000 ORDER BY indexed_at, id")
def _(t):
    return t.docs.where("status = 'archived' AND indexed_at <= 1700300000").orderBy("indexed_at", "id").select("id", "path")


@query("CAT38", "SELECT id, search_type, latency_ms FROM query_events ORDER BY created_at DESC, id LIMIT 100")
def _(t):
    return t.query_events.orderBy(F.desc("created_at"), "id").limit(100).select("id", "search_type", "latency_ms")


@query("CAT39", "SELECT max(commit_id) AS head, count(DISTINCT commit_id) AS commits FROM commits")
def _(t):
    return t.commits.agg(F.max("commit_id").alias("head"), F.countDistinct("commit_id").alias("commits"))


@query("CAT40", "SELECT f.finding, f.n FROM (SELECT 'retired documents' AS finding, count(*) AS n FROM docs WHERE status IS NOT NULL UNION ALL SELECT 'expired entries', count(*) FROM memory WHERE expires_at <= 1705000000 UNION ALL SELECT 'slow hooks', count(*) FROM hook_events WHERE elapsed_ms > 200 UNION ALL SELECT 'none', count(*) FROM memory WHERE id IS NULL) AS f WHERE n > 0")
def _(t):
    facts = [("retired documents", t.docs.where("status is not null")), ("expired entries", t.memory.where(F.col("expires_at") <= NOW)), ("slow hooks", t.hook_events.where("elapsed_ms > 200")), ("none", t.memory.where("id is null"))]
    out = None
    for name, df in facts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
        out = row if out is None else out.unionByName(row)
    return out.where("n > 0")


@query("CAT41", "SELECT collection AS repo, count(*) AS documents, max(indexed_at) AS fresh FROM docs GROUP BY collection")
def _(t):
    return t.docs.groupBy(F.col("collection").alias("repo")).agg(F.count("*").alias("documents"), F.max("indexed_at").alias("fresh"))


@query("CAT42", "SELECT path, CASE WHEN starts_with(path, 'src1/en/') THEN 'en' WHEN starts_with(path, 'src1/') THEN 'one' ELSE 'all' END AS collection FROM docs")
def _(t):
    roots = t.spark.createDataFrame([("one", "src1"), ("en", "src1/en")], "collection string, root string")
    files = t.docs.select("path").distinct()
    return files.join(L.owned(files, roots), "path", "left").select("path", F.coalesce("collection", F.lit("all")).alias("collection"))


@query("CAT43", "SELECT path, max(commit_id) AS last_commit FROM commits GROUP BY path")
def _(t):
    return t.commits.groupBy("path").agg(F.max("commit_id").alias("last_commit"))


@query("CAT44", "SELECT conv_id, count(*) FILTER (turn % 4 = 3) AS broken FROM turns GROUP BY conv_id")
def _(t):
    raw = F.when(F.col("turn") % 4 == 3, F.lit('{"type": "user", ')).otherwise(F.to_json(F.struct(F.col("role").alias("type"))))
    return t.turns.groupBy("conv_id").agg(F.count_if(F.from_json(raw, "type string", {"mode": "PERMISSIVE"})["type"].isNull() & raw.isNotNull()).alias("broken"))


@query("CAT45", "SELECT count(*) = 0 AS empty FROM docs")
def _(t):
    return t.docs.limit(1).agg((F.count("*") == 0).alias("empty"))


@query("CAT46", "SELECT id, name AS symbol FROM symbols WHERE id % 2 = 0")
def _(t):
    from ..functions.commands import grep_pattern

    cmd = F.when(F.col("id") % 2 == 0, F.concat(F.lit("rg -n 'fn "), "name", F.lit("' src | head"))).otherwise(F.lit("ls -la"))
    found = t.symbols.select("id", grep_pattern(cmd).alias("p"))
    return found.select("id", F.nullif(F.regexp_extract("p", r"^(?:fn|def|class|struct|func)\s+(\w+)$", 1), F.lit("")).alias("symbol")).where("symbol is not null")


# --- sources ----------------------------------------------------------------------------------------------------


@query("SRC01", "SELECT path, CASE WHEN starts_with(path, 'src2/de/') THEN 'german' ELSE 'two' END AS collection FROM docs WHERE starts_with(path, 'src2/')")
def _(t):
    roots = t.spark.createDataFrame([("two", "src2"), ("german", "src2/de")], "collection string, root string")
    return L.owned(t.docs.select("path").distinct(), roots)


@query("SRC02", "SELECT CASE WHEN id % 9 = 0 THEN 'removed' WHEN id % 4 = 1 THEN 'updated' ELSE 'unchanged' END AS change, count(*) AS n FROM docs GROUP BY 1")
def _(t):
    """Two scans into a store by path: the second finds what is new, changed and gone."""
    hashes = t.docs.select("path", F.sha2("body", 256).alias("hash"), F.lit(1).cast("long").alias("scan"), F.lit(False).alias("gone"))
    store = Snapshots(t.spark, commits.fresh_dir(t.spark, "scans"), "path string, hash string, scan long", ["path"], "scan", 8)
    first = store.merge(hashes, batch=1, deleted="gone")
    now = t.docs.where("id % 9 > 0").select("path", F.when(F.col("id") % 4 == 1, F.lit("x")).otherwise(F.sha2("body", 256)).alias("hash"))
    diff = commits.kept(L.snapshot_diff(store.read().select("path", "hash"), now), "diff")
    moved = diff.where("change <> 'unchanged'").join(now, "path", "left").select("path", "hash", F.lit(2).cast("long").alias("scan"), (F.col("change") == "removed").alias("gone"))
    store.merge(moved, batch=2, deleted="gone")
    changed = store.changes(first).groupBy("change").agg(F.count("*").alias("n"))
    same = store.read().where("scan = 1").agg(F.count("*").alias("n")).select(F.lit("unchanged").alias("change"), "n")
    return changed.unionByName(same.where("n > 0"))


@query("SRC03", "SELECT id FROM docs WHERE id IN (SELECT item_id FROM benchmark) AND status IS NULL")
def _(t):
    return t.docs.where("status is null").join(t.benchmark.select(F.col("item_id").alias("id")), "id", "left_semi").select("id")


@query("SRC04", "SELECT path FROM code_files WHERE NOT regexp_matches(path, '/m1[0-9]?/') AND NOT (starts_with(path, 'src/m3/') AND NOT regexp_matches(path, '/f[0-9]*3[.]rs$')) AND path <> 'src/m4/f4.rs'")
def _(t):
    """The tree of code files with ignore files at its root and in a folder; an extra pattern besides."""
    tree = t.code_files.select("path", F.lit("").alias("content"))
    rules = t.spark.createDataFrame([(".gitignore", "# generated\n/src/m1*/\n!/src/m10/f10.rs\n"), ("src/m3/.gitignore", "*.rs\n!f*3.rs\n")], "path string, content string")
    return ignore.visible(tree.unionByName(rules), ["/src/m4/f4.rs"]).where("path NOT LIKE '%.gitignore'").select("path")


@query("SRC05", "SELECT doc_id, sha256(text) AS hash, octet_length(encode(text)) AS bytes, ceil(octet_length(encode(text)) / 4)::BIGINT AS tokens FROM documents WHERE octet_length(encode(text)) <= 1048576")
def _(t):
    n = F.octet_length("text")
    return t.documents.where(n <= 1 << 20).select("doc_id", F.sha2("text", 256).alias("hash"), n.cast("long").alias("bytes"), F.ceil(n / 4).alias("tokens"))


@query("SRC06", "SELECT conv_id, turn, text FROM turns WHERE role IN ('user', 'assistant') AND turn % 5 < 4")
def _(t):
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    good = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(blocks).alias("content")).alias("message")))
    raw = t.turns.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("line"), F.when(F.col("turn") % 5 < 4, good).otherwise(F.lit("{broken")).alias("value"))
    return L.parse_records(raw).select(F.col("file").cast("long").alias("conv_id"), F.col("line").cast("long").alias("turn"), "text")


@query("SRC07", "SELECT event, count(*) AS n, min(at_s) AS oldest FROM hook_events WHERE at_s >= 1704067200 + 22 * 86400 GROUP BY event")
def _(t):
    return t.hook_events.where(F.col("at_s") >= 1704067200 + 22 * DAY).groupBy("event").agg(F.count("*").alias("n"), F.min("at_s").alias("oldest"))


@query("SRC08", "SELECT CAST(commit_id AS STRING) AS commit, path FROM commits")
def _(t):
    c = t.commits
    lines = c.select((F.col("commit_id") % 8).alias("log"), F.struct("commit_id", F.lit(0), F.lit("")).alias("o"), F.concat(F.lit("commit "), F.col("commit_id").cast("string")).alias("value")).distinct().union(c.select((F.col("commit_id") % 8).alias("log"), F.struct("commit_id", F.lit(1), "path").alias("o"), F.col("path").alias("value")))
    # a line's place in its log is its order: numbering the lines would sort each log in one task
    return L.parse_commit_log(lines.select("log", F.struct("o", "value").alias("n"), "value")).select("commit", "path")


@query("SRC09", "SELECT path, max(commit_id) AS newest FROM commits WHERE commit_id >= 10000 GROUP BY path")
def _(t):
    return t.commits.where("commit_id >= 10000").groupBy("path").agg(F.max("commit_id").alias("newest"))


@query("SRC10", "SELECT s.id FROM symbols s WHERE s.file_path IN (SELECT path FROM code_files WHERE file_id < 5)")
def _(t):
    return t.symbols.join(t.code_files.where("file_id < 5").select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")


@query("SRC11", "SELECT source, id, revision, title FROM (SELECT * FROM external QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY revision DESC) = 1) AS l WHERE NOT deleted")
def _(t):
    """Revisions in two batches, the later one first, and one of them twice; removed records stay removed."""
    store = Snapshots(t.spark, commits.fresh_dir(t.spark, "external"), "source string, id string, revision long, title string", ["source", "id"], "revision", 8)
    for batch, odd in enumerate((1, 0, 1)):
        store.merge(t.external.where(F.col("revision") % 2 == odd), batch=batch, deleted="deleted")
    return store.read()


@query("SRC12", "SELECT id, title, entry_type, CASE WHEN rowid % 11 = 0 THEN 'conflict markers' END AS error FROM memory WHERE NOT contains(content, chr(10) || 'id: ')")
def _(t):
    md = F.concat(L.to_markdown(), F.when(F.col("rowid") % 11 == 0, F.lit("\n<<<<<<< ours\n")).otherwise(F.lit("")))
    return t.memory.where(~F.contains("content", F.lit("\nid: "))).select(L.from_markdown(md).alias("e")).select("e.id", "e.title", "e.entry_type", "e.error")


@query("SRC13", """SELECT id, md5(concat('---', chr(10), 'id: ', id, chr(10), 'status: ', status, chr(10), 'tags: [', replace(tags, ',', ', '), ']', chr(10), 'title: "', title, '"', chr(10), 'type: ', entry_type, chr(10), '---', chr(10), content)) AS file FROM memory""")
def _(t):
    return t.memory.select("id", F.md5(L.to_markdown().cast("binary")).alias("file"))


@query("SRC14", "SELECT id, title FROM memory WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY title ORDER BY rowid) = 1")
def _(t):
    back = t.memory.where("status = 'active'").select("rowid", F.from_json(F.to_json(F.struct("id", "title")), "id string, title string").alias("e")).select("rowid", "e.*")
    return R.latest(back, ["title"], F.col("rowid")).select("id", "title")


@query("SRC15", "SELECT id, '2024-01-05' AS date, 'Decisions' AS section, title AS bullet FROM docs UNION ALL SELECT id, '2024-01-05', 'Next', 'second' FROM docs")
def _(t):
    j = t.docs.select("id", F.concat(F.lit("# Log 2024-01-05\n## Decisions\n- "), "title", F.lit("\ntext\n## Next\n* second\n")).alias("text"))
    return L.parse_journal(j).select("id", "date", "section", "bullet")


@query("SRC16", "SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS uses FROM documents GROUP BY text")
def _(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first"), F.count("*").alias("uses"))


@query("SRC17", "SELECT d.id, e.vec_id IS NULL OR d.id % 6 = 0 AS embed FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.id")
def _(t):
    """Documents by collection and path, twice: a vector stays where the second merge left the content alone."""
    rows = lambda h, n: t.docs.select("collection", "path", "id", h.alias("hash"), F.lit(n).cast("long").alias("seq"))
    store = Snapshots(t.spark, commits.fresh_dir(t.spark, "documents"), "collection string, path string, id long, hash string, seq long", ["collection", "path"], "seq", 8)
    first = store.merge(rows(F.sha2("body", 256), 1), batch=1)
    now = rows(F.when(F.col("id") % 6 == 0, F.lit("new")).otherwise(F.sha2("body", 256)), 2)
    was = store.read().select("collection", "path", "hash")
    store.merge(now.join(was, ["collection", "path", "hash"], "left_anti"), batch=2)
    changed = store.changes(first).select("collection", "path", F.lit(True).alias("changed"))
    has = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(True).alias("has"))
    return store.read().join(changed, ["collection", "path"], "left").join(has, "id", "left").select("id", (F.col("has").isNull() | F.col("changed").isNotNull()).alias("embed"))


@query("SRC18", "SELECT repo, count(*) AS n FROM (SELECT 'docs' AS repo FROM docs UNION ALL SELECT 'memory' FROM memory UNION ALL SELECT 'code' FROM symbols) AS u GROUP BY repo")
def _(t):
    each = [t.docs.select(F.lit("docs").alias("repo"), "title"), t.memory.select(F.lit("memory").alias("repo"), "title"), t.symbols.select(F.lit("code").alias("repo"), "name")]
    return each[0].unionByName(each[1]).unionByName(each[2], allowMissingColumns=True).groupBy("repo").agg(F.count("*").alias("n"))


@query("SRC19", """SELECT n_nationkey, concat(n_nationkey, ',"', replace(n_name, '"', '""'), '"') AS csv, concat('| ', n_nationkey, ' | ', n_name, ' |') AS markdown FROM nation""")
def _(t):
    from ..sources.render import csv_field, markdown_row

    return t.nation.select("n_nationkey", F.concat_ws(",", F.col("n_nationkey").cast("string"), csv_field(F.col("n_name"), True)).alias("csv"), markdown_row("n_nationkey", "n_name").alias("markdown"))


@query("SRC20", "SELECT id, CASE WHEN id % 5 = 0 AND status IS NULL THEN 'archived' ELSE status END AS status FROM docs WHERE collection = 'src3'")
def _(t):
    present = t.docs.where("id % 5 > 0").select("path")
    s = t.docs.where("collection = 'src3'")
    gone = s.join(present, "path", "left_anti").select("id", F.lit(True).alias("gone"))
    return s.join(gone, "id", "left").select("id", F.when(F.col("gone") & F.col("status").isNull(), "archived").otherwise(F.col("status")).alias("status"))


@query("SRC21", "SELECT DISTINCT lang AS name FROM docs WHERE collection NOT IN ('src0') AND lang NOT IN ('en')")
def _(t):
    have = t.spark.createDataFrame([("en",)], "name string")
    return t.docs.where("collection <> 'src0'").select(F.col("lang").alias("name")).distinct().join(have, "name", "left_anti")
