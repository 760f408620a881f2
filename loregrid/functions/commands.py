"""Prompts and shell commands: what a search asks for."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column, functions as F


def wants_call_graph(prompt: Column) -> Column:
    return F.lower(prompt).rlike(r"\b(who|what) calls\b|\bcallers? of\b|\bcall graph\b")


def classify_pattern(pattern: Column) -> Column:
    """definition, call_site or identifier; null for anything else."""
    return F.when(pattern.rlike(r"^(fn|def|class|struct|func)\s+\w+"), "definition").when(pattern.rlike(r"^\w+\\?\($"), "call_site").when(pattern.rlike(r"^[A-Za-z_][\w:.]*$"), "identifier")


def path_tokens(prompt: Column) -> Column:
    """Tokens that look like paths: a slash and a file ending, quotes and backticks taken off."""
    words = F.transform(F.split(F.coalesce(prompt, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"^[`'\"(\[]+|[`'\")\],.;:]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"^[\w.@~-]*(/[\w.@-]+)+\.[A-Za-z]\w*$")))


def _stages(command: str) -> list[list[str]]:
    lex = shlex.shlex(command, posix=True, punctuation_chars="|&;")
    lex.whitespace_split = True
    out: list[list[str]] = [[]]
    for token in lex:
        if set(token) <= set("|&;"):
            out.append([])
        else:
            out[-1].append(token)
    return out


def find_pattern(command: str | None, depth: int = 0) -> str | None:
    """The pattern of the first grep or rg in a command line; looks into ``sh -c``; null without one."""
    try:
        stages = _stages(command or "")
    except ValueError:
        return None
    for words in stages:
        while words and re.fullmatch(r"\w+=.*|sudo|env", words[0]):
            words = words[1:]
        if not words:
            continue
        name = words[0].rsplit("/", 1)[-1]
        if name in ("sh", "bash", "zsh") and "-c" in words[:-1] and depth < 4:
            if (found := find_pattern(words[words.index("-c") + 1], depth + 1)) is not None:
                return found
        if name in ("grep", "egrep", "fgrep", "rg"):
            rest = words[1:]
            if "-e" in rest[:-1]:
                return rest[rest.index("-e") + 1]
            return next((w for w in rest if not w.startswith("-")), None)
    return None


def grep_pattern(command: Column) -> Column:
    """``find_pattern`` as a pandas UDF."""

    @F.pandas_udf("string")
    def run(commands: pd.Series) -> pd.Series:
        return commands.map(find_pattern)

    return run(command)
