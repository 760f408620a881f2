"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read, stored, words

#: Label and words of the base phrases.
PHRASES = [("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])]

#: Label and text of the templates, sentences by which the usual licenses are granted, and words that a block must hold
#: besides: where a sentence is short, the share of its words alone doesn't tell which license it names.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", ""),
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu general public 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public 2 0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike"),
    ("public-domain", "This work has been released into the public domain", "public domain"),
    ("warranty", "The software is provided as is, without warranty of any kind, express or implied", "warranty"),
]
#: Share of a template's distinct words that a block has to hold.
CONTAINMENT = 0.8
#: A block is so many times as long as the template, in words, and starts at every multiple of the template's length:
#: whole lines and paragraphs play no part, and a template of wrapped lines stands whole in one block.
BLOCK = 2


def _rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[lit(v).alias(k) for k, v in r.items()]) for r in rows])))


def template_words(spark: SparkSession, templates: list[tuple[str, ...]]) -> list[tuple[str, list[str], int, list[str]]]:
    """Label, distinct words, number of words and mandatory words of each template that has any."""
    got = _rows(spark, [{"n": n, "label": label, "text": text, "must": " ".join(must)} for n, (label, text, *must) in enumerate(templates)])
    got = got.select("n", "label", words(F.col("text")).alias("w"), words(F.col("must")).alias("must")).orderBy("n").collect()
    return [(r.label, sorted(set(r.w)), len(r.w), sorted(set(r.must))) for r in got if r.w]


def similar_blocks(docs: DataFrame, templates: list[tuple[str, ...]] = TEMPLATES, least: float = CONTAINMENT) -> DataFrame:
    """Stored ``(d, th, block, label, containment)``: every block that holds ``least`` of a template's distinct words.

    A block of a template of m words is a run of ``BLOCK`` * m words of the text that starts at a multiple of m;
    block is its number. Words are ordered by their count over all documents, rare first. A template of n
    distinct words needs a = ceil(least * n) of them in the block, so one of its n - a + 1 rarest is there, and
    one of the block's |b| - a + 1 rarest is in the template: only those prefixes are joined. Pairs whose
    positions leave fewer than a shared words go (positional filter), as do blocks with fewer than a
    template words (length filter). The rest is counted exactly, and a block without one of the template's
    mandatory words (a third element, none by default) isn't that license. Words of no template can't be
    shared, so blocks are reduced to the templates' words, a bounded list.
    """
    spark = docs.sparkSession
    known = template_words(spark, templates)
    if not known:
        raise ValueError("no template has words")
    vocabulary = sorted({w for _, ws, _, must in known for w in (*ws, *must)})
    counts = docs.select(F.explode(words(F.col("text"))).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    count = {r["w"]: r["count"] for r in counts.collect()}  # at most one row for each template word
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    lists, full = [], []
    for n, (label, ws, m, must) in enumerate(known):
        ws, need = sorted(ws, key=place.get), ceil(least * len(ws) - 1e-9)
        full.append({"n": n, "label": label, "need": need, "ws": ws, "must": must})
        lists += [{"w": w, "m": m, "n": n, "i": i, "size": len(ws), "need": need} for i, w in enumerate(ws[: len(ws) - need + 1])]
    fewest = {m: min(x["need"] for x in lists if x["m"] == m) for m in {x["m"] for x in lists}}
    prefix = sorted({x["w"] for x in lists})
    held = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words(F.col("text")).alias("w"))
    held = held.where(F.arrays_overlap("w", F.array(*map(F.lit, prefix))))
    sizes = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(few).alias("few")) for m, few in sorted(fewest.items())])).alias("x")
    blocks = held.select("d", "th", "w", sizes).select("d", "th", "w", "x.m", "x.few", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / F.col("x.m")).cast("int"))).alias("block"))
    run = F.slice("w", F.col("block") * F.col("m") + 1, F.col("m") * BLOCK)
    blocks = blocks.select("d", "th", "m", "few", "block", F.array_intersect(F.array(*map(F.lit, order)), run).alias("b")).where("size(b) >= few")
    tokens = blocks.select("d", "th", "m", "block", "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - F.col("few") + 1)).alias("j", "w"))
    near = tokens.join(F.broadcast(_rows(spark, lists)), ["m", "w"])
    near = near.where("size(b) >= need AND 1 + least(size - i - 1, size(b) - j - 1) >= need").select("d", "th", "block", "n", "b").distinct()
    near = near.join(F.broadcast(_rows(spark, full)), "n").withColumn("shared", F.size(F.array_intersect("ws", "b"))).where("shared >= need AND size(array_except(must, b)) = 0")
    return stored(near.select("d", "th", "block", "label", (F.col("shared") / F.size("ws")).alias("containment")), "blocks")


def scan(docs: DataFrame, templates: list[tuple[str, ...]] = TEMPLATES, least: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts count as empty. The score is 1 where a base phrase stands, else the best containment of a
    template in a block, or 0. Repeated rows each get their row. Other columns are not looked at.
    """
    found = similar_blocks(docs, templates, least).groupBy("d", "th").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    found = stored(found, "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "d", "th", "w", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("s"))
    none = F.array().cast("array<int>")

    def places(ws: list[str]) -> Column:
        same = " AND ".join(f"get(w, i + {k}) = '{w}'" for k, w in enumerate(ws))
        return F.when(F.contains("s", F.lit(f" {' '.join(ws)} ")), F.expr(f"filter(sequence(0, size(w) - {len(ws)}), i -> {same})")).otherwise(none)

    rows = rows.select("doc_id", "d", "th", F.size("w").cast("long").alias("n_words"), *[places(ws).alias(f"p{n}") for n, (_, ws) in enumerate(PHRASES)])
    at = F.concat(*[F.col(f"p{n}") for n in range(len(PHRASES))])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"p{n}") > 0, F.lit(label)) for n, (label, _) in enumerate(PHRASES)])))
    rows = rows.select("doc_id", "d", "th", "n_words", at.alias("at"), base.alias("base")).join(found, ["d", "th"], "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return rows.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan`` of all documents; nulls, repeats and empty texts as there."""
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    w = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    phrases = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS pos, '{label}' AS label FROM d, unnest(range(1, len(w) + 1)) AS u(i) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(ws)) for label, ws in PHRASES
    )
    templates = ", ".join(f"('{label}', '{text}', '{must}')" for label, text, must in TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {w.format("coalesce(text, '')")} AS w FROM documents),
p AS ({phrases}),
t AS (SELECT label, list_distinct({w.format("x")}) AS ws, len({w.format("x")}) AS m, {w.format("y")} AS must FROM (VALUES {templates}) AS v(label, x, y)),
l AS (SELECT rid, m, list_distinct(w[o + 1:o + {BLOCK} * m]) AS b FROM d, (SELECT DISTINCT m FROM t) AS ms, unnest(range(0, len(w), m)) AS u(o)),
s AS (SELECT rid, label, len(list_intersect(ws, b)) / len(ws) AS c FROM l JOIN t USING (m) WHERE len(list_intersect(ws, b)) >= ceil({CONTAINMENT} * len(ws) - 1e-9) AND list_has_all(b, must)),
g AS (SELECT rid, count(*) AS n, min(pos) AS a, max(pos) AS z FROM p GROUP BY rid),
bl AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS x FROM (SELECT DISTINCT rid, label FROM p) GROUP BY rid),
al AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS x FROM (SELECT rid, label FROM p UNION SELECT rid, label FROM s) GROUP BY rid),
b AS (SELECT rid, max(c) AS c FROM s GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(bl.x, '') AS base_labels, coalesce(al.x, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(b.c, 0)::DOUBLE END AS score
FROM d LEFT JOIN g USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid) LEFT JOIN b USING (rid)
"""


SQL = _sql()
