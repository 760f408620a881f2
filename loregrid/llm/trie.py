"""Prefix trie of conversations by Patricia construction.

Conversations are rows of turn hashes. Equal ones become one sequence, sequences are sorted over all partitions, and
neighbours in that order share what branches: the points of the compressed tree are the ends of sequences and the
longest common prefixes of neighbours, at most two for each sequence, however long it is. One pass over each sorted
partition links the points by edges; what its first and last sequences share with other partitions is looked up
beforehand. Sums over subtrees are made on the points by pointer doubling, and unary nodes come last, from the
suffix sums of their edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import bounded, discard, read, stored

#: Conversations of the same ids' range whose ids are joined to one text before a node's ids are hashed.
BLOCK = 4_096
#: Steps of pointer doubling: enough for 2**40 points on a path.
_STEPS = 40


def _prefix(fps: str, depth: str | Column) -> Column:
    """Key of the node at a depth of a sequence."""
    return F.md5(F.array_join(F.slice(fps, F.lit(1), F.col(depth) if isinstance(depth, str) else depth), "").cast("binary"))


def _common(a: str, b: str) -> Column:
    """Number of leading elements that two different arrays share."""
    return (F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1).cast("int")


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, fps, bytes)``: each conversation's turns in order, as MD5 hashes of role and text and as bytes of text.

    Null roles and texts are empty; turns come in order, null ones first, ties by hash; rows without conv_id are
    left out; repeated rows are turns of their own. A conversation is one row, of 40 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    fp = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), fp.alias("fp"), F.octet_length(text).cast("long").alias("b")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return own.select("conv_id", F.col("ts.fp").alias("fps"), F.col("ts.b").alias("bytes"))


def shared_starts(sequences: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``sequences`` in which the first h turns of conversation c are those of conversation c - c % every, h being crc32(c) % most.

    As many as it has, if that one has fewer, and none if there is none; c's own turns follow after its first h.
    """
    c = F.col("conv_id")
    mine = sequences.withColumns({"base": c - c % every, "h": (F.crc32(c.cast("string").cast("binary")) % most).cast("int")})
    heads = sequences.select(c.alias("base"), F.slice("fps", 1, most - 1).alias("f"), F.slice("bytes", 1, most - 1).alias("g"))
    cut = lambda head, own: F.concat(F.slice(F.coalesce(head, F.array().cast(f"array<{'string' if own == 'fps' else 'bigint'}>")), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.size(own)))
    return mine.join(heads, "base", "left").select("conv_id", cut(F.col("f"), "fps").alias("fps"), cut(F.col("g"), "bytes").alias("bytes"))


_POINT = "key string, depth int, up string, above int, edge array<bigint>, conv_id long, n long"
_POINTS = pa.schema([("key", pa.string()), ("depth", pa.int32()), ("up", pa.string()), ("above", pa.int32()), ("edge", pa.list_(pa.int64())), ("conv_id", pa.int64()), ("n", pa.int64())])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points with their parents from rows sorted by (part, fps); holds one path at a time.

    The first row of a part names the points above it that other parts know (``left``), its last row likewise
    (``right``); a point of which several parts hold members leaves each of them, with the same parent.
    """
    part, path, state, stack, right, out = None, [], [], [], [], []

    def leave(x: list, up: list | None) -> None:
        above = up[0] if up else -1
        edge, total = [], 0
        for b in reversed(path[above:x[0]] if up else [0]):
            total += b
            edge.append(total)
        out.append((x[1], x[0], up[1] if up else None, above, edge[::-1], x[2], x[3]))

    def point(depth: int) -> list:
        return [depth, state[depth].hexdigest(), None, None]

    def close() -> None:
        known = {x[0]: x for x in stack}
        chain = [known.get(d) or point(d) for d in sorted({*known, *right})]
        for up, x in zip([None, *chain], chain):
            leave(x, up)

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({f.name: pa.array([r[k] for r in out], f.type) for k, f in enumerate(_POINTS)}, schema=_POINTS)
        out.clear()
        return made

    for rows in batches:
        for p, fps, sizes, conv, n, common, left, last in zip(*(rows.column(c).to_pylist() for c in ("part", "fps", "bytes", "conv_id", "n", "common", "left", "right")), strict=True):
            if p != part:
                if part is not None:
                    close()
                part, state, path, common = p, [hashlib.md5(b"")], sizes, 0
                for f in fps:
                    state.append(state[-1].copy())
                    state[-1].update(f.encode())
                stack[:] = [point(d) for d in sorted({0, *(left or ())})]
            else:
                while stack[-1][0] > common:
                    x = stack.pop()
                    if stack[-1][0] < common:
                        stack.append(point(common))
                    leave(x, stack[-1])
                del state[common + 1 :]
                for f in fps[common:]:
                    state.append(state[-1].copy())
                    state[-1].update(f.encode())
                path = sizes
            if stack[-1][0] < len(fps):
                stack.append(point(len(fps)))
            stack[-1][2:] = conv, n
            right = last or []
            if len(out) >= 4_096:
                yield batch()
    if part is not None:
        close()
    if out:
        yield batch()


def points(sequences: DataFrame, parts: int | None = None) -> DataFrame:
    """The compressed tree of distinct ``sequences(key, fps, bytes, conv_id, n)``: a row for each branch, end and leaf point, and the root.

    up, above: key and depth of the point above; edge: for each node of the edge between, the point included, the bytes from
    it to the edge's end; conv_id, n: what ends here. ``parts``: range partitions of the sort, Spark's own number by default.
    """
    dealt = sequences.repartitionByRange(parts, "fps") if parts else sequences.repartitionByRange("fps")
    placed = stored(dealt.withColumn("part", F.spark_partition_id()), "sorted")
    near = placed.withColumn("before", F.lag("fps").over(W.partitionBy("part").orderBy("fps"))).withColumn("common", _common("before", "fps")).drop("before")
    near = stored(near, "neighbours")
    # a row for each range partition: what its ends share with the partitions beside it
    bounds = near.groupBy("part").agg(F.min("fps").alias("lo"), F.max("fps").alias("hi"))
    along = W.orderBy("part")
    bounds = stored(bounds.withColumns({"prev": F.lag("hi").over(along), "next": F.lead("lo").over(along)}).select("part", "lo", "hi", _common("prev", "lo").alias("before"), _common("hi", "next").alias("after")), "bounds")
    ends = bounds.select("part", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("lo").alias("fps"), F.col("before").alias("common")), F.struct(F.lit("right").alias("side"), F.col("hi").alias("fps"), F.col("after").alias("common")))).alias("e")).select("part", "e.*")
    spine = ends.where("common > 0").select("part", "side", "fps", F.explode(F.sequence(F.lit(1), F.col("common"))).alias("depth")).select("part", "side", "depth", _prefix("fps", "depth").alias("key"))
    spine = stored(spine, "spine")
    keys = spine.select("key").distinct()
    every = near.select("key").union(near.where("common > 0").select(_prefix("fps", "common"))).union(ends.where("common > 0").select(_prefix("fps", "common")))
    held = every.join(bounded(keys, spine.count(), 48), "key", "left_semi").distinct()
    sides = spine.join(held, "key", "left_semi").groupBy("part", "side").agg(F.collect_list("depth").alias("at"))
    ends = ends.join(sides, ["part", "side"]).select(_prefix("fps", F.size("fps")).alias("key"), "side", "at")
    ends = stored(ends.groupBy("key").agg(F.first(F.when(F.col("side") == "left", F.col("at")), True).alias("left"), F.first(F.when(F.col("side") == "right", F.col("at")), True).alias("right")), "ends")
    ready = near.join(bounded(ends, ends.count(), 1_024), "key", "left").select("part", "fps", "bytes", "conv_id", "n", "common", "left", "right")
    found = ready.repartition("part").sortWithinPartitions("part", "fps").mapInArrow(_linked, _POINT)
    first = [F.max(c).alias(c) for c in ("depth", "up", "above")]
    out = stored(found.groupBy("key").agg(*first, F.first("edge").alias("edge"), F.max("conv_id").alias("conv_id"), F.max("n").alias("n")), "points")
    discard(placed, near, bounds, spine, ends)
    return out


def _doubled(points: DataFrame) -> list[DataFrame]:
    """Stored ``(key, anc)`` for the ancestors 1, 2, 4, ... points above."""
    ups = [stored(points.where("up is not null").select("key", F.col("up").alias("anc")), "above")]
    for _ in range(_STEPS):
        higher = stored(ups[-1].join(ups[-1].select(F.col("key").alias("anc"), F.col("anc").alias("higher")), "anc").select("key", F.col("higher").alias("anc")), "above")
        if higher.isEmpty():
            break
        ups.append(higher)
    return ups


def _rolled(values: DataFrame, ups: list[DataFrame], sums: list[str], least: list[str] = []) -> DataFrame:
    """``values(key, ...)`` summed (or their least taken) over each point's subtree, itself included."""
    for k, up in enumerate(ups):
        add = up.join(values, "key").groupBy("anc").agg(*[F.sum(c).alias(f"_{c}") for c in sums], *[F.min(c).alias(f"_{c}") for c in least]).withColumnRenamed("anc", "key")
        both = values.join(add, "key", "left")
        nxt = stored(both.select("key", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums], *[F.least(c, f"_{c}").alias(c) for c in least]), "rolled")
        if k:
            discard(values)
        values = nxt
    return values


_ENDS = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's texts, comma-joined, from rows sorted by key and block; holds one text at a time."""
    key, state, out = None, None, []
    for rows in batches:
        for k, text in zip(*(rows.column(c).to_pylist() for c in ("key", "ids")), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(_ENDS.names, zip(*out), strict=True)), schema=_ENDS)
            out = []
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]}, schema=_ENDS)


def end_hashes(members: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of ``members(key, conv_id)``: the hash of a node's decimal ids, ascending and comma-joined.

    Ids are joined to texts by ranges of ``BLOCK`` ids first, so that a node at which a third of all conversations
    end is hashed from a stream of short texts.
    """
    blocks = members.groupBy("key", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(_hashed, "key string, ends_sha256 string")


def prefix_trie(sequences: DataFrame, parts: int | None = None) -> DataFrame:
    """Every node of the trie of ``sequences(conv_id, fps, bytes)``, conv_id unique: the columns of ``op11_prefix_trie``.

    Equal sequences are members of the same nodes; empty ones are members of the root alone; no sequences, no nodes.
    """
    rows = stored(sequences.withColumn("key", _prefix("fps", F.size("fps"))), "rebuilt")
    once = stored(rows.groupBy("key").agg(F.first("fps").alias("fps"), F.first("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "sequences")
    tree = points(once, parts)
    ups = _doubled(tree)
    kids = tree.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    start = stored(tree.join(kids, "key", "left").select("key", "conv_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("n_children").isNull().cast("long").alias("n_leaves"), F.coalesce("n_children", F.lit(0)).alias("n_children")), "points")
    sizes = _rolled(start.select("key", "n", "n_leaves", "conv_id"), ups, ["n", "n_leaves"], ["conv_id"])
    known = stored(tree.select("key", "depth", "up", "above", "edge").join(sizes, "key").join(start.select("key", "n_children"), "key"), "known")
    saved = _rolled(known.select("key", ((F.col("n") - 1) * F.get("edge", F.lit(0))).alias("saved")), ups, ["saved"])
    ends = end_hashes(rows.select("key", "conv_id"))
    parents = known.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))
    whole = known.join(saved, "key").join(ends, "key", "left").join(parents, "up", "left")
    # of an edge's nodes the last is the point; the others are unary and share its members
    node = whole.select("*", F.posexplode("edge").alias("i", "suffix")).withColumn("at", F.col("above") + 1 + F.col("i"))
    last = F.col("at") == F.col("depth")
    return node.select(
        "conv_id", F.col("at").cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n") - 1) * (F.get("edge", F.lit(0)) - F.col("suffix"))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prefix_trie`` of all conversations with ``shared_starts``; nulls, ties and repeats as in ``sequences``."""
    return prefix_trie(shared_starts(sequences(read(spark, sf_dir, "conversations"))))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
SQL = f"""
WITH t AS MATERIALIZED (SELECT conv_id AS c, md5(concat(strlen(coalesce(role, '')), ':', role, text)) AS fp, strlen(coalesce(text, '')) AS b, turn FROM conversations WHERE conv_id IS NOT NULL),
p AS MATERIALIZED (SELECT c, fp, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, fp) AS p FROM t),
cs AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t) AS d),
r AS (SELECT cs.c, p.p, fp, b FROM cs JOIN p ON p.c = cs.base AND p.p <= h UNION ALL SELECT cs.c, 1000000 + p.p, fp, b FROM cs JOIN p ON p.c = cs.c AND p.p > h),
s AS MATERIALIZED (
  SELECT c, row_number() OVER w AS d, b, md5(array_to_string(list(fp) OVER w, '')) AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT c, 0, 0, 'root' FROM cs),
l AS MATERIALIZED (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM s),
n AS MATERIALIZED (SELECT k, min(c) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(b) AS b, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS ids FROM l GROUP BY k),
kids AS MATERIALIZED (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
sub AS (SELECT l.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.b) AS saved_tokens FROM n JOIN l ON l.c = n.conv_id AND l.d <= n.depth LEFT JOIN kids ON kids.k = n.k GROUP BY l.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM n LEFT JOIN n AS q ON q.k = n.up LEFT JOIN kids ON kids.k = n.k JOIN sub ON sub.k = n.k
"""
