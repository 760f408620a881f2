"""Durations, and the loosely typed values of frontmatter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def duration_seconds(text: Column) -> Column:
    """Seconds of ``Nh``, ``Nd`` or ``Nw``; null for anything else and for what a long can't hold."""
    n = F.regexp_extract(text, r"^\s*(\d{1,12})\s*[hdw]\s*$", 1)
    unit = F.regexp_extract(text, r"([hdw])\s*$", 1)
    per = F.when(unit == "h", 3600).when(unit == "d", 86_400).when(unit == "w", 604_800)
    return F.when(n != "", n.try_cast("long") * per)


def tags_of(raw: Column) -> Column:
    """Tags of a JSON list or of a comma-separated text, trimmed, without empty ones."""
    listed = F.from_json(raw, "array<string>")
    split = F.when(raw.rlike(r"^\s*\["), listed).otherwise(F.split(raw, ","))
    return F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")


def values_of(raw: Column, key: str) -> Column:
    """Values of a key in a JSON object: those of a list, or a single text as a list of one."""
    v = F.get_json_object(raw, f"$.{key}")
    return F.when(v.isNull(), F.array().cast("array<string>")).when(v.rlike(r"^\s*\["), F.from_json(v, "array<string>")).otherwise(F.array(v))


def evolution_refs(raw: Column, key: str) -> Column:
    """References with their reasons: from a text, a list of texts or a list of objects with ref and reason."""
    v = F.get_json_object(raw, f"$.{key}")
    none = F.lit(None).cast("string").alias("reason")
    objects = F.from_json(v, "array<struct<ref: string, reason: string>>")
    texts = F.transform(F.from_json(v, "array<string>"), lambda x: F.struct(x.alias("ref"), none))
    return F.when(v.isNull(), F.array().cast("array<struct<ref: string, reason: string>>")).when(v.rlike(r"^\s*\[\s*\{"), objects).when(v.rlike(r"^\s*\["), texts).otherwise(F.array(F.struct(v.alias("ref"), none)))
