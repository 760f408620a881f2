"""Structural duplicates: Hamming joins, fingerprints, components, dense groups, reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import commits
from .relational import numbered

# Trust buckets in their order, and the ladder of visibilities.
BUCKETS = ["0", "1-3", "4", "5", "at cut", "cosine"]
REACH = {"public": 5, "package": 4, "crate": 3, "module": 2, "restricted": 1, "private": 0}


def hamming_join(df: DataFrame, most: int) -> DataFrame:
    """``(a, b, distance)``, a < b: pairs of ``df(id, fp)`` whose longs differ in at most ``most`` bits.

    Exact by pigeonhole: of ``most + 2`` bands of bits at least two are equal, so fingerprints meet by two bands at once. Each
    fingerprint is posted once, whatever its copies; a pair leaves the join only by the first two bands that it
    shares, and the ids of its fingerprints follow. Nothing is broadcast: a table of fingerprints is small by its files, but
    each stands under as many keys as there are two bands, which no estimate counts and the driver would have to hold.
    """
    cuts = [round(64 * k / (most + 2)) for k in range(most + 3)]
    bands = list(zip(cuts, cuts[1:], strict=False))
    part = lambda x, k: F.shiftrightunsigned(x, bands[k][0]).bitwiseAND(F.lit((1 << (bands[k][1] - bands[k][0])) - 1))
    twos = [(i, j) for j in range(len(bands)) for i in range(j)]
    keys = F.array(*[F.struct(F.lit(1 << i | 1 << j).alias("two"), F.shiftleft(part(F.col("fp"), i), bands[j][1] - bands[j][0]).bitwiseOR(part(F.col("fp"), j)).alias("v")) for i, j in twos])
    posted = df.select("fp").where("fp IS NOT NULL").distinct().select("fp", F.inline(keys))
    l, r = posted.toDF("fa", "two", "v"), posted.toDF("fb", "two2", "v2")
    x = F.col("fa").bitwiseXOR(F.col("fb"))
    shared = reduce(Column.bitwiseOR, (F.when(part(x, k) == 0, 1 << k).otherwise(0) for k in range(len(bands))))
    above = shared.bitwiseAND(shared - 1)  # without the lowest bit
    on = (F.col("two") == F.col("two2")) & (F.col("v") == F.col("v2")) & (F.col("fa") < F.col("fb")) & (F.bit_count(x) <= most) & (shared.bitwiseXOR(above.bitwiseAND(above - 1)) == F.col("two"))
    near = l.join(r.hint("merge"), on).select("fa", "fb", F.bit_count(x).alias("distance"))
    a, b = df.select(F.col("id").alias("a"), F.col("fp").alias("fa")), df.select(F.col("id").alias("b"), F.col("fp").alias("fb"))
    others = near.join(a.hint("merge"), "fa").join(b.hint("merge"), "fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").where("a < b")
    return others.unionByName(a.join(b.hint("merge"), (F.col("fa") == F.col("fb")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(0).alias("distance")))


def md5_60(text: Column) -> Column:
    """The leading 60 bits of a text's MD5, for fingerprints that SQL engines without xxHash can make too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def fingerprinted(df: DataFrame, text: str, tokens: Callable[[Column], Column], hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``df`` with ``fp``: a 64-bit fingerprint of the tokens, the majority of bits over the hashes of their 3-token shingles; 0 without any.

    Tokens and hashes are columns of their own before the bits are counted, so each shingle is hashed once.
    """
    n = F.size("_tokens")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: hashed(F.array_join(F.slice("_tokens", i, 3), " ")))
    held = df.withColumn("_tokens", tokens(F.col(text))).withColumn("_hashes", F.when(n > 0, grams).otherwise(F.array().cast("array<long>")))
    return held.withColumn("fp", majority_bits(F.col("_hashes"))).drop("_tokens", "_hashes")


def majority_bits(hashes: Column) -> Column:
    """The long whose bits are set where more than half of the array's longs have them; 0 for none.

    Counts of four bits ride in one long, 16 bits each, so the array is passed over 16 times; longer arrays are counted
    in chunks, so that none runs over. The 16 sums are made once and named, whatever reads them.
    """
    chunk, zero = 32_767, F.lit(0).cast("long")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(hashes), F.lit(1)) - 1) / chunk).cast("int")), lambda i: F.slice(hashes, i * chunk + 1, chunk))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  a name for a value within an expression

    def sums(parts: Column, k: int) -> Column:
        """Per chunk the counts of bits k, k + 16, k + 32 and k + 48."""
        return F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(0x0001_0001_0001_0001))))

    def bits(counted: Column) -> Column:
        out = zero
        for bit in range(64):
            count = F.aggregate(counted[bit % 16], zero, lambda a, s: a + F.shiftrightunsigned(s, bit // 16 * 16).bitwiseAND(F.lit(0xFFFF)))
            out = out.bitwiseOR(F.when(count * 2 > F.size(hashes), F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(zero))
        return out

    return once(once(parts, lambda p: F.array(*[sums(p, k) for k in range(16)])), bits)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``(node, root)``: root is the smallest node reachable; label propagation with pointer jumping, checkpointed."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        nxt = label.join(near, "node", "left").join(up, "root", "left").select("node", F.col("root").alias("was"), F.least("root", "near", "up").alias("root"))
        nxt = _cut(nxt)
        label = nxt.select("node", "root")
        if nxt.where("was <> root").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that the session names; a local folder only where none is set in local mode."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(commits.shared_dir(df.sparkSession))
    return df.checkpoint()


#: Rounds in which groups are formed side by side; what waits longer is finished component by component.
MOST_ROUNDS = 24
#: Pairs of candidates of one group that a round may look up; more where there are more links.
LOOKED_UP = 4_000_000


def dense_groups(pairs: DataFrame, comps: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``(root, grp, node)``: complete-linkage groups (``linked_groups``) with the components that they lie in."""
    return linked_groups(pairs, most_rounds).join(comps.toDF("node", "root"), "node").select("root", "grp", "node")


def linked_groups(pairs: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``(node, grp)``: complete-linkage groups, greedy in node order; a group is named by its founder, its least node.

    Each node joins the first group all of whose members it is linked with, else it founds one. A candidate is a node with
    a smaller one that it is linked with, whose group it may still join; a node without any is a founder. In a round,
    candidates of a founder are safe if they are linked with all smaller ones of it: they join it if it is their
    first choice, and found nothing in any case. So a node doesn't wait for all that is two links away, only for what can
    still change its choice. A round looks at so many candidates of each founder that their pairs stay within
    ``LOOKED_UP`` or twice the links, so a clique is done in one round and the work of a round doesn't outgrow the links.

    A chain of nodes in order waits along its length: what is undecided after ``most_rounds`` is finished by one task for
    each component of what is left.
    """
    links = commits.kept(pairs.where("a <> b").select(F.least("a", "b").alias("f"), F.greatest("a", "b").alias("v")).distinct(), "links")
    wait, joined, allowed = links, [], max(LOOKED_UP, 2 * links.count())
    for _ in range(most_rounds):
        choice = wait.groupBy("v").agg(F.min("f").alias("choice"))
        founded = wait.join(choice.select(F.col("v").alias("f")), "f", "left_anti")
        looked_up = founded.groupBy("f").count().agg(*[F.sum(F.pow(F.least("count", F.lit(2**k)), 2) / 2) for k in range(1, 24)]).first()
        if looked_up[0] is None:
            break
        most = 2 ** max(k for k in range(1, 24) if k == 1 or looked_up[k - 1] <= allowed)
        top = founded.withColumn("k", F.row_number().over(W.partitionBy("f").orderBy("v"))).where(F.col("k") <= most).select("f", "v")
        unlike = top.join(top.toDF("f", "w"), "f").where("w < v").join(links.toDF("w", "v"), ["w", "v"], "left_anti").select("f", "v").distinct()
        safe = commits.kept(top.join(unlike, ["f", "v"], "left_anti").join(choice, "v").select("v", "f", (F.col("f") == F.col("choice")).alias("joins")), "safe")
        new = safe.where("joins").select("v", "f")
        joined.append(new)
        left = wait.join(new.select("v"), "v", "left_anti").join(safe.select(F.col("v").alias("f")).distinct(), "f", "left_anti")
        # of a group's new members a candidate must be linked with all smaller ones
        members = new.groupBy("f").agg(F.collect_list("v").alias("members"))
        met = links.toDF("m", "v").join(new.toDF("m", "f"), "m").groupBy("v", "f").agg(F.count("*").alias("met"))
        left = left.join(members, "f", "left").join(met, ["v", "f"], "left")
        wait = commits.kept(left.where(F.col("members").isNull() | (F.size(F.filter("members", lambda m: m < F.col("v"))) == F.coalesce("met", F.lit(0)))).select("f", "v"), "wait")
    else:
        if not wait.isEmpty():
            joined.append(_finished(wait, links))
    nodes = links.select(F.explode(F.array("f", "v")).alias("node")).distinct()
    if not joined:
        return nodes.select("node", F.col("node").alias("grp"))
    return nodes.join(reduce(DataFrame.unionByName, joined).toDF("node", "grp"), "node", "left").select("node", F.coalesce("grp", "node").alias("grp"))


def structural_groups(bodies: DataFrame, called: DataFrame, most: int) -> DataFrame:
    """``(id, grp, hamming)``: groups of two or more ``bodies(id, fp, owner)`` of which every two are admissible, by greedy complete linkage in the order of (fp, id).

    Admissible: at most ``most`` bits apart, not of one owner, and not among the pairs ``called(a, b)``. ``grp`` is the id of
    the founder, ``hamming`` the widest distance in the group. Bodies without owner and such calls that are copies
    are one node: whatever admits one admits all.
    """
    fps = bodies.select("id", "fp")
    called = called.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    called = called.join(fps.toDF("a", "fa"), "a").join(fps.toDF("b", "fb"), "b").where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= most)
    called = commits.kept(called.select("a", "b"), "called")
    bound = called.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("bound", F.lit(True))
    own = bodies.join(bound, "id", "left").withColumn("alone", F.when(F.col("owner").isNotNull() | F.col("bound").isNotNull(), F.col("id")))
    nodes = own.groupBy("fp", "alone").agg(F.min("id").alias("id"), F.max("owner").alias("owner"), F.count("*").alias("copies"))
    # the order of founders is of contents: fingerprints as unsigned numbers, then ids
    nodes = commits.kept(numbered(nodes, F.col("fp") < 0, F.col("fp"), F.col("id"), name="n"), "nodes")
    end = lambda a: nodes.select(F.col("id").alias(a), F.col("owner").alias(f"owner_{a}"), F.col("n").alias(f"n_{a}"))
    pairs = hamming_join(nodes.select("id", "fp"), most).join(called, ["a", "b"], "left_anti").join(end("a"), "a").join(end("b"), "b")
    pairs = commits.kept(pairs.where("NOT coalesce(owner_a = owner_b, false)").select(F.least("n_a", "n_b").alias("a"), F.greatest("n_a", "n_b").alias("b"), "distance"), "pairs")
    home = commits.kept(linked_groups(pairs.select("a", "b")), "home")
    widest = pairs.join(home.toDF("a", "grp"), "a").join(home.toDF("b", "grp"), ["b", "grp"]).groupBy("grp").agg(F.max("distance").alias("hamming"))
    placed = nodes.join(home.toDF("n", "grp"), "n", "left").withColumn("grp", F.coalesce("grp", "n")).join(widest, "grp", "left").where("hamming IS NOT NULL OR copies > 1")
    placed = placed.join(nodes.select(F.col("n").alias("grp"), F.col("id").alias("founder")), "grp")
    keys = placed.select("fp", F.coalesce(F.col("alone").cast("string"), F.lit("")).alias("key"), F.col("founder").alias("grp"), F.coalesce("hamming", F.lit(0)).alias("hamming"))
    return own.select("id", "fp", F.coalesce(F.col("alone").cast("string"), F.lit("")).alias("key")).join(keys, ["fp", "key"]).select("id", "grp", "hamming")


def verdicts(members: DataFrame, accepted: DataFrame) -> DataFrame:
    """``(cluster, verdict)`` of ``members(cluster, id)`` by the standing decisions ``accepted(entry, id)``, each with what was reviewed.

    accepted: all members were in one decision; changed: one was reviewed and has grown since; report: neither.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    seen = accepted.groupBy("entry").agg(F.count("*").alias("reviewed"))
    met = members.join(accepted, "id").groupBy("cluster", "entry").agg(F.count("*").alias("both")).join(sizes, "cluster").join(seen, "entry")
    told = met.groupBy("cluster").agg(F.bool_or(F.col("both") == F.col("size")).alias("all"), F.bool_or(F.col("both") == F.col("reviewed")).alias("grown"))
    return sizes.join(told, "cluster", "left").select("cluster", F.when(F.col("all"), "accepted").when(F.col("grown"), "changed").otherwise("report").alias("verdict"))


def _finished(wait: DataFrame, links: DataFrame) -> DataFrame:
    """``(v, f)`` of the waiting nodes that join a group, by one pass in order for each component of what waits."""
    comps = commits.kept(components(wait.toDF("a", "b")), "comps")
    mine = wait.join(comps.toDF("v", "root"), "v").select("root", "v", "f", F.lit(True).alias("waits"))
    nodes = comps.join(wait.select(F.col("v").alias("node")).distinct(), "node", "left_semi")
    near = links.join(nodes.toDF("v", "root"), "v").join(nodes.toDF("f", "root"), ["f", "root"]).select("root", "v", "f", F.lit(False).alias("waits"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        choices: dict = {}
        linked = set()
        for v, f, waits in zip(pdf["v"].tolist(), pdf["f"].tolist(), pdf["waits"].tolist(), strict=True):
            choices.setdefault(v, []).append(f) if waits else linked.add((f, v))
        home: dict = {}
        members: dict = {}
        for v in sorted(choices):
            f = next((f for f in sorted(choices[v]) if f not in home and all((m, v) in linked for m in members.get(f, []))), None)
            if f is not None:
                home[v] = f
                members.setdefault(f, []).append(v)
        return pd.DataFrame(sorted(home.items()), columns=["v", "f"])

    kind = dict(wait.dtypes)["v"]
    return mine.unionByName(near).groupBy("root").applyInPandas(run, f"v {kind}, f {kind}")


def bucket(hamming: Column, cut: int) -> Column:
    """Trust bucket of a distance; null is evidence by cosine."""
    return F.when(hamming.isNull(), "cosine").when(hamming == cut, "at cut").when(hamming == 0, "0").when(hamming.between(1, 3), "1-3").when(hamming == 4, "4").when(hamming == 5, "5").otherwise("at cut")


def reach(visibility: Column) -> Column:
    out = F.lit(0)
    for v, n in REACH.items():
        out = F.when(visibility == v, n).otherwise(out)
    return out


def cluster_report(members: DataFrame, cut: int) -> DataFrame:
    """One row for each cluster of ``members(cluster, hamming, file_path, module_path, visibility, lines)``: its bucket, spreads, reach and duplicated lines."""
    return members.groupBy("cluster", "hamming").agg(
        (F.sum("lines") - F.max("lines")).alias("duplicated"), F.countDistinct(F.coalesce("module_path", "file_path")).alias("module_spread"),
        F.countDistinct("file_path").alias("file_spread"), F.max(reach(F.col("visibility"))).alias("reach"),
    ).withColumn("bucket", bucket(F.col("hamming"), cut))


def ranking() -> list[Column]:
    """Order of clusters: bucket, then spread over modules and files, reach and lines, each largest first."""
    return [F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")), F.desc("module_spread"), F.desc("file_spread"), F.desc("reach"), F.desc("duplicated")]
