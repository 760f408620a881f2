"""Validation of search requests as rows: what each scope stands for, and the first rule that a request breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The scopes, what they stand for, and the number of alternatives of one request.
PURPOSES = {
    "text": "legacy_text", "strings": "legacy_text", "code": "legacy_code", "coupling": "coupling", "docs": "docs", "memory": "memory",
    "symbols": "symbols", "duplicates": "duplicates", "source": "source", "literals": "literals", "semantic-code": "semantic_code", "knowledge": "knowledge",
}
DEFAULT, MOST_PATTERNS, CONTRACT = "legacy_default", 64, "v2"
#: What a request may use, by purpose.
ALLOWS = {
    "patterns": ("source", "literals"), "regex": ("source",), "path": ("source", "literals", "symbols", "duplicates"),
    "contract": ("symbols", "docs", "memory"), "needs_query": ("source", "literals", "semantic_code", "knowledge"), "strict_case": ("semantic_code", "knowledge"),
}


def purpose(scope: Column) -> Column:
    """What a scope stands for; no scope is the default, an unknown one is null."""
    known = F.create_map(*[F.lit(x) for pair in PURPOSES.items() for x in pair])
    return F.when(scope.isNull(), F.lit(DEFAULT)).otherwise(F.try_element_at(known, scope))


def validated(requests: DataFrame) -> DataFrame:
    """``requests(scope, query, patterns, path, file, regex, ignore_case, contract)`` with ``purpose`` and ``error``, one of which is null.

    The rules are tried in order, the first that a request breaks names its error. Null flags are false, a null query is empty.
    """
    p = purpose(F.col("scope"))
    among = lambda what: F.coalesce(p.isin(*ALLOWS[what]), F.lit(False))
    query, patterns = F.coalesce("query", F.lit("")), F.coalesce("patterns", F.array().cast("array<string>"))
    some, flag = F.size(patterns) > 0, lambda c: F.coalesce(F.col(c), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = [
        (p.isNull(), "unknown scope"),
        (F.col("patterns").isNotNull() & ~some, "patterns are empty"),
        (some & (~among("patterns") | (query != "")), "patterns are for source and literals, without a query"),
        (some & ((F.size(patterns) > MOST_PATTERNS) | F.exists(patterns, blank)), "1 to 64 patterns, none blank"),
        (among("needs_query") & ~some & blank(query), "a query or patterns are needed"),
        (flag("regex") & ~among("regex"), "regex is for source"),
        (F.col("path").isNotNull() & ~among("path"), "no path for this scope"),
        (F.col("path").isNotNull() & F.col("file").isNotNull(), "path or file, not both"),
        (F.col("file").isNotNull() & F.coalesce(p == "source", F.lit(False)), "source takes a path"),
        (flag("ignore_case") & among("strict_case"), "no ignore_case for this scope"),
        (F.col("contract").isNotNull() & ((F.col("contract") != CONTRACT) | ~among("contract")), "no such contract for this scope"),
    ]
    error = F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in rules])
    return requests.withColumn("error", error).withColumn("purpose", F.when(F.col("error").isNull(), p))


def checked(limit: int, most: int = 1_000, **shares: float) -> None:
    """Raises for a limit outside 1 to ``most`` and for shares (floors, confidences) outside 0 to 1."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}, not {limit}")
    for name, value in shares.items():
        if not 0 <= value <= 1:
            raise ValueError(f"{name} must be 0 to 1, not {value}")
