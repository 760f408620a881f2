"""Chat formatting by quotation linking: quoted lines are joined to the messages that first said them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LOWER, UPPER, read, stored

#: Start of a quoted line, its levels being the marks; and a line that names the author of the quote that follows it.
QUOTE = r"^[ \t]*((?:>[ \t]*)+)"
ATTRIBUTION = r"^On .+ wrote:[ \t\r]*$"
_BLANK = r"[ \t\r\x0B\f]+"
#: Steps of pointer doubling: enough for reply chains of 2**40 messages.
_STEPS = 40


def _normal(line):
    """ASCII lower case, blanks as one space, none at the ends: what is hashed."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), _BLANK, " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Each row with ``own`` (its lines without quotes and attributions) and ``quoted`` (array of level and content)."""
    q, a = QUOTE.replace("\\", "\\\\"), ATTRIBUTION.replace("\\", "\\\\")
    return messages.withColumn("ls", F.split(F.coalesce("text", F.lit("")), "\n")).select(
        "conv_id", "turn", "role",
        F.expr(f"filter(ls, (x, i) -> NOT x RLIKE '{q}' AND NOT (x RLIKE '{a}' AND coalesce(get(ls, i + 1) RLIKE '{q}', false)))").alias("own"),
        F.expr(f"transform(filter(ls, x -> x RLIKE '{q}'), x -> named_struct('level', length(regexp_extract(x, '{q}', 1)) - length(replace(regexp_extract(x, '{q}', 1), '>', '')), 'content', regexp_replace(x, '{q}', '')))").alias("quoted"),
    )


def linked(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages(conv_id, turn, role, text)``, without quotes and with its place in the reply order.

    reply_to: the earlier turn of the conversation that most of the message's first-level quoted lines
    come from (ties: the later turn). quoted_conv, quoted_turn: else the first message of another
    conversation that said the first of them. thread: the turn at the root of its chain of replies; a
    conversation is read in the order of (thread, turn). A quoted line comes from the first message that has
    it among its own lines, so a line that thousands share has one origin for a conversation and one in all.
    Null texts are empty; rows with null conv_id or turn are kept and never linked; repeated rows are kept.
    """
    rows = stored(parsed(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")), "parsed")
    keyed = rows.where("conv_id is not null and turn is not null")
    said = keyed.select("conv_id", "turn", F.explode("own").alias("line")).select("conv_id", "turn", _normal(F.col("line")).alias("n")).where("n <> ''").select("conv_id", "turn", F.md5(F.col("n").cast("binary")).alias("h"))
    asked = keyed.where("size(quoted) > 0").select("conv_id", "turn", F.posexplode("quoted").alias("i", "q")).select("conv_id", "turn", "i", "q.level", _normal(F.col("q.content")).alias("n"))
    asked = stored(asked.where("n <> ''").select("conv_id", "turn", "i", "level", F.md5(F.col("n").cast("binary")).alias("h")), "asked")
    wanted = asked.select("h").distinct()
    # one row for each line of a conversation goes into the join, however often it is said there
    said = stored(said.groupBy("conv_id", "h").agg(F.min("turn").alias("origin")).join(wanted, "h", "left_semi"), "said")
    inside = asked.join(said, ["conv_id", "h"]).where("origin < turn")
    votes = inside.groupBy("conv_id", "turn").agg(F.count_if(F.col("level") == 1).alias("first"), F.countDistinct("i").alias("n_linked"))
    chosen = inside.where("level = 1").groupBy("conv_id", "turn", "origin").agg(F.countDistinct("i").alias("v")).groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct("v", "origin")).alias("reply_to"))
    links = stored(votes.join(chosen, ["conv_id", "turn"], "left").select("conv_id", "turn", "n_linked", "reply_to"), "links")
    ever = said.groupBy("h").agg(F.min(F.struct("conv_id", "origin")).alias("o"))
    abroad = asked.where("level = 1").join(links.where("reply_to is not null").select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").join(ever, "h").where(F.col("o.conv_id") != F.col("conv_id"))
    abroad = abroad.groupBy("conv_id", "turn").agg(F.min_by("o", "i").alias("o")).select("conv_id", "turn", F.col("o.conv_id").alias("quoted_conv"), F.col("o.origin").alias("quoted_turn"))
    up = stored(links.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("thread")), "threads")
    for _ in range(_STEPS):
        above = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"))
        nxt = stored(up.join(above, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("higher", "thread").alias("thread"), F.col("higher").isNotNull().alias("moved")), "threads")
        up = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    text = F.regexp_replace(F.array_join("own", "\n"), r"^\s+|\s+$", "")
    out = rows.join(links, ["conv_id", "turn"], "left").join(abroad, ["conv_id", "turn"], "left").join(up, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", text.alias("text"), F.size("quoted").cast("long").alias("n_quoted"), F.coalesce(F.array_max(F.col("quoted.level")), F.lit(0)).cast("long").alias("max_level"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", "quoted_conv", "quoted_turn", F.coalesce("thread", "turn").alias("thread"),
    )


def formatted(messages: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """``linked`` with the column ``message``: role and text between the marks. Order a conversation by (thread, turn)."""
    return linked(messages).withColumn("message", F.concat(F.lit(start), F.coalesce("role", F.lit("user")), F.lit("\n"), "text", F.lit(f"{end}\n")))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``formatted`` of all conversations; nulls, repeats and ties as in ``linked``."""
    return formatted(read(spark, sf_dir, "conversations"))


_N = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\x0B\\f]+', ' ', 'g'))"
SQL = f"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
p AS MATERIALIZED (
  SELECT rid, conv_id, turn, role,
    list_filter(ls, lambda x, i: NOT regexp_matches(x, '{QUOTE}') AND NOT (regexp_matches(x, '{ATTRIBUTION}') AND coalesce(regexp_matches(ls[i + 1], '{QUOTE}'), false))) AS own,
    list_filter(ls, lambda x: regexp_matches(x, '{QUOTE}')) AS quoted
  FROM m
),
said AS (SELECT conv_id, h, min(turn) AS origin FROM (SELECT conv_id, turn, {_N.format("line")} AS h FROM p, unnest(own) AS u(line)) WHERE h <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
asked AS MATERIALIZED (
  SELECT DISTINCT conv_id, turn, i, length(regexp_replace(regexp_extract(quoted[i], '{QUOTE}', 1), '[^>]', '', 'g')) AS level, {_N.format(f"regexp_replace(quoted[i], '{QUOTE}', '')")} AS h
  FROM p, unnest(range(1, len(quoted) + 1)) AS u(i)
),
inside AS (SELECT a.*, origin FROM asked a JOIN said s ON a.conv_id = s.conv_id AND a.h = s.h WHERE a.h <> '' AND origin < turn),
linked AS (SELECT conv_id, turn, count(DISTINCT i) AS n_linked FROM inside GROUP BY ALL),
chosen AS (SELECT conv_id, turn, arg_max(origin, v * 1000000000000 + origin) AS reply_to FROM (SELECT conv_id, turn, origin, count(DISTINCT i) AS v FROM inside WHERE level = 1 GROUP BY ALL) GROUP BY ALL),
ever AS (SELECT h, arg_min(conv_id, (conv_id, origin)) AS c, arg_min(origin, (conv_id, origin)) AS t FROM said GROUP BY h),
abroad AS (
  SELECT a.conv_id, a.turn, arg_min(c, i) AS quoted_conv, arg_min(t, i) AS quoted_turn FROM asked a JOIN ever ON a.h = ever.h AND ever.c <> a.conv_id
  WHERE a.level = 1 AND a.h <> '' AND NOT EXISTS (SELECT 1 FROM chosen k WHERE k.conv_id = a.conv_id AND k.turn = a.turn) GROUP BY ALL
),
up AS (SELECT conv_id, turn, reply_to AS t FROM chosen UNION SELECT up.conv_id, up.turn, k.reply_to FROM up JOIN chosen k ON k.conv_id = up.conv_id AND k.turn = up.t),
root AS (SELECT conv_id, turn, min(t) AS thread FROM up GROUP BY ALL)
SELECT p.conv_id, p.turn, p.role, regexp_replace(array_to_string(own, chr(10)), '^\\s+|\\s+$', '', 'g') AS text, len(quoted)::BIGINT AS n_quoted,
  coalesce(list_max(list_transform(quoted, lambda x: length(regexp_replace(regexp_extract(x, '{QUOTE}', 1), '[^>]', '', 'g')))), 0)::BIGINT AS max_level,
  coalesce(n_linked, 0)::BIGINT AS n_linked, reply_to, quoted_conv, quoted_turn, coalesce(thread, p.turn) AS thread,
  '<|im_start|>' || coalesce(p.role, 'user') || chr(10) || regexp_replace(array_to_string(own, chr(10)), '^\\s+|\\s+$', '', 'g') || '<|im_end|>' || chr(10) AS message
FROM p LEFT JOIN linked l ON l.conv_id = p.conv_id AND l.turn = p.turn LEFT JOIN chosen c ON c.conv_id = p.conv_id AND c.turn = p.turn
  LEFT JOIN abroad a ON a.conv_id = p.conv_id AND a.turn = p.turn LEFT JOIN root r ON r.conv_id = p.conv_id AND r.turn = p.turn
"""
