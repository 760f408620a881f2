"""Frontmatter: the YAML subset of Markdown headers as JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F


def _scalar(v: str):
    v = v.strip()
    if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'":
        return v[1:-1]
    if v.startswith("[") and v.endswith("]"):
        return [_scalar(x) for x in re.split(r",(?=(?:[^\"']*[\"'][^\"']*[\"'])*[^\"']*$)", v[1:-1]) if x.strip()]
    if v in ("true", "false"):
        return v == "true"
    if re.fullmatch(r"-?\d{1,18}", v):
        return int(v)
    return None if v in ("", "null", "~") else v


def parse(text: str | None) -> str | None:
    """The header as a JSON object with sorted keys; null without header; ``{"_error": ...}`` if it isn't a mapping."""
    m = re.match(r"---\r?\n(.*?)\r?\n---(?:\r?\n|$)", text or "", re.S)
    if not m:
        return None
    out: dict = {}
    key = None
    for line in m[1].splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if (item := re.match(r"\s*-\s+(.*)", line)) and key is not None:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(_scalar(item[1]))
        elif pair := re.match(r"([\w.-]+):(?:\s+(.*))?$", line):
            key = pair[1]
            out[key] = _scalar(pair[2] or "")
        else:
            return json.dumps({"_error": "not a mapping"})
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


def frontmatter(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(parse)

    return run(text)
