"""Behavioural priors: scores, matching, clustering, settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import signatures_match
from ..storage import commits
from . import vectors
from .duplication import components

# The injection threshold, sessions for promotion, similarity of one cluster, verdicts before demotion.
INJECT_THRESHOLD, PROMOTE_SESSIONS, SAME_CLUSTER, MIN_SETTLEMENTS = 0.3, 2, 0.70, 3
DAY = 86_400


def injection_score(now: Column) -> Column:
    """Recurrence times freshness times belief times fit to the context; 0 without sessions."""
    s = F.greatest("distinct_sessions", F.lit(0)).cast("double")
    fresh_at = F.greatest(F.coalesce("last_unrefuted_injection_at", "last_seen_at"), F.col("last_seen_at"))
    days = F.greatest((now - fresh_at) / float(DAY), F.lit(0.0))
    freshness = F.exp(-days / (90.0 * (1.0 + F.log(1.0 + F.greatest("evidence_count", F.lit(0))))))
    belief = (1.0 + F.col("confirmed_count")) / (2.0 + F.col("confirmed_count") + F.col("refuted_count"))
    return F.when(s <= 0, 0.0).otherwise(s / (s + 1.0) * freshness * belief * (s / (s + F.greatest("misfired_count", F.lit(0)))))


def injectable(now: Column) -> Column:
    return (F.col("state") == "promoted") & (F.col("refuted_count") <= F.col("confirmed_count")) & (injection_score(now) >= INJECT_THRESHOLD)


def trigger_matches(kind: Column, tool: Column, path: Column, command: Column, error: Column, prompt: Column) -> Column:
    """Whether a matcher (``trigger_kind``, ``tool``, ``path_regex``, ``command_contains``, ``error_contains``, ``prompt_contains``) fits a context.

    Selectors that are set must all hold; one that the context can't supply fails; none set never fits.
    Tool and prompt are compared without regard to case.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = [("tool", lambda w: F.lower(tool) == F.lower(w)), ("path_regex", lambda w: F.rlike(path, w)), ("command_contains", lambda w: F.contains(command, w)), ("error_contains", lambda w: F.contains(error, w)), ("prompt_contains", lambda w: F.contains(F.lower(prompt), F.lower(w)))]
    ok, some = F.col("trigger_kind") == kind, F.lit(False)
    for name, holds in checks:
        ok = ok & (blank(F.col(name)) | F.coalesce(holds(F.trim(F.col(name))), F.lit(False)))
        some = some | ~blank(F.col(name))
    return ok & some


def settle(injections: DataFrame, clusters: DataFrame, errors: DataFrame) -> DataFrame:
    """``(cluster_id, session, outcome)`` of open injections: refuted if the cluster's error came again at or after the injection.

    unobservable: the cluster has no signature; errors without time count as later.
    """
    known = clusters.select(F.col("id").alias("cluster_id"), "error_signature")
    open_ = injections.where("outcome is null").groupBy("cluster_id", "session").agg(F.min("injected_at").alias("injected_at")).join(known, "cluster_id")
    per = errors.groupBy("session", "signature").agg(F.max("at_s").alias("last"), F.count_if(F.col("at_s").isNull()).alias("undated"))
    hit = F.coalesce(signatures_match(F.col("error_signature"), F.col("signature")) & ((F.col("undated") > 0) | (F.col("last") >= F.col("injected_at"))), F.lit(False))
    out = open_.join(per, "session", "left").groupBy("cluster_id", "session", "error_signature").agg(F.bool_or(hit).alias("again"))
    return out.select("cluster_id", "session", F.when(F.coalesce(F.trim("error_signature"), F.lit("")) == "", "unobservable").when(F.col("again"), "refuted").otherwise("unrefuted").alias("outcome"))


def demoted(clusters: DataFrame, settled: DataFrame) -> DataFrame:
    """Promoted clusters that are refuted more often than confirmed, over enough verdicts, counting ``settled``."""
    n = settled.where("outcome = 'refuted'").groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("new"))
    c = clusters.join(n, "id").withColumn("refuted_count", F.col("refuted_count") + F.col("new"))
    return c.where((F.col("state") == "promoted") & (F.col("refuted_count") > F.col("confirmed_count")) & (F.col("confirmed_count") + F.col("refuted_count") >= MIN_SETTLEMENTS)).select("id", "refuted_count")


def leaders(order: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored ``(id)``: of ``order(id, place)`` the rows that a pass in order of place makes leaders: those without an earlier leader among ``pairs(a, b)``.

    In rounds instead of one pass: a row none of whose earlier neighbours is undecided or a leader is a leader; one
    with an earlier leader is none, and stops nobody. Each round decides the first undecided row of every
    neighbourhood, so the rounds are as many as the longest run of rows that wait for each other.
    """
    place = order.select("id", "place")
    both = pairs.join(place.toDF("a", "pa"), "a").join(place.toDF("b", "pb"), "b").where("a <> b")
    first = F.col("pa") < F.col("pb")
    edges = commits.kept(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late")).distinct(), "edges")
    out = commits.kept(order.select("id").join(edges.select(F.col("late").alias("id")).distinct(), "id", "left_anti"), "leaders")
    new = out
    while not edges.isEmpty():
        out_of = commits.kept(edges.join(new.select(F.col("id").alias("early")), "early", "left_semi").select(F.col("late").alias("id")).distinct(), "followers")
        waiting = edges.join(out_of.select(F.col("id").alias("late")), "late", "left_anti")
        rest = commits.kept(waiting.join(out_of.select(F.col("id").alias("early")), "early", "left_anti"), "edges")
        new = commits.kept(waiting.select(F.col("late").alias("id")).distinct().join(rest.select(F.col("late").alias("id")).distinct(), "id", "left_anti"), "leaders")
        out, edges = out.union(new), rest
    return out


def cluster_candidates(candidates: DataFrame, least: float = SAME_CLUSTER) -> DataFrame:
    """``(key, id, cluster)``: candidates in order of creation join the nearest cluster of their error key whose first member is similar enough, ties to the smaller id.

    The order is kept by rounds over the pairs of similar candidates (``leaders``), so a key isn't a task. Of equal vectors
    of a key only the first can lead a cluster, and only it makes pairs. Null and zero vectors are clusters of their own.
    """
    rows = candidates.select("key", "id", F.struct("created_at", "id").alias("place"), F.col("v").cast("array<double>").alias("v"), F.xxhash64("key", "v").alias("class"))
    rows = commits.kept(rows.withColumn("sound", F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))), "candidates")
    once = rows.where("sound").groupBy("key", "v", "class").agg(F.min_by("id", "place").alias("id"), F.min("place").alias("place"))
    once = commits.kept(once, "classes")
    pairs = commits.kept(vectors.cosine_pairs(once.select("id", "v", "key"), least, within="key"), "pairs")
    led = commits.kept(leaders(once, pairs).join(once, "id").select("key", F.col("id").alias("leader"), F.col("place").alias("since"), F.col("class").alias("lc")), "led")
    # each class with the leaders near it, itself among them; a row joins the nearest of those that were there before it
    ends = pairs.select("a", "b", "score").union(pairs.select("b", "a", "score")).join(once.select(F.col("id").alias("b"), "class", "key"), "b")
    near = ends.join(led.select(F.col("leader").alias("a"), "since"), "a").select("key", "class", F.col("a").alias("leader"), "since", "score").union(led.select("key", F.col("lc").alias("class"), "leader", "since", F.lit(1.0).alias("score")))
    best = rows.where("sound").join(near, ["key", "class"]).where(F.col("since") <= F.col("place")).groupBy("key", "id").agg(F.max_by("leader", F.struct("score", -F.col("leader"))).alias("cluster"))
    return best.unionByName(rows.where("NOT sound").select("key", "id", F.col("id").alias("cluster")))


def reclustered(candidates: DataFrame, least: float = SAME_CLUSTER) -> DataFrame:
    """``(id, cluster)``: candidates of ``candidates(key, id, v)`` by single link: those of one key that a chain of similar vectors joins, under the smallest id.

    Groups that a candidate bridges are one. Equal vectors of a key are one node of the chain.
    """
    rows = candidates.select("key", "id", F.col("v").cast("array<double>").alias("v"))
    once = commits.kept(rows.groupBy("key", "v").agg(F.min("id").alias("first")), "classes")
    pairs = commits.kept(vectors.cosine_pairs(once.select(F.col("first").alias("id"), "v", "key"), least, within="key").select("a", "b"), "pairs")
    root = components(pairs).toDF("first", "root")
    classes = once.join(root, "first", "left").select("key", "v", F.coalesce("root", "first").alias("cluster"))
    same = rows["key"].eqNullSafe(classes["key"]) & rows["v"].eqNullSafe(classes["v"])
    return rows.join(classes, same).select("id", "cluster")
