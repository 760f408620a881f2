"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, policies and ablations are bitwise.

``ledger`` measures each text once and stores the measurements with one long in which bit k says that rule k of
``RULES`` failed. A policy is a mask over these bits: ``judged`` applies it, ``ablations`` tells what each of its
rules does alone, both without a look at the texts. A policy that changes therefore costs a scan of longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, read, stored

_BLANKS, _SYMBOLS, _DIGITS, _INNER = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"0123456789", bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits")
#: Rules by bit: name, and the condition over the measurements under which a text fails. Append only: stored ledgers keep their bits.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("digits", "2 * n_digits > word_chars"),
)
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "short_words", "long_words"),
    "v2": tuple(name for name, _ in RULES),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def repeated(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more, the first occurrence included; exact, whatever the number of words."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    _, pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    twice = n[window] > 1
    held = np.zeros(len(words), dtype=bool)
    for k in range(3):
        held[k : k + len(twice)] |= twice
    return int(held.sum())


def measured(text: bytes | None) -> tuple[int, ...]:
    """``MEASURES`` of a UTF-8 text (null: empty)."""
    raw = text or b""
    words = raw.split()  # at ASCII blanks only, for these are bytes
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dense = raw.translate(None, _BLANKS)
    return (
        len(words), len(dense.translate(None, _INNER)), len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), repeated(words), len(lines), len(raw) - len(raw.translate(None, _DIGITS)),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ``MEASURES`` (long) and ``failed`` (long: bit k is set if rule k failed).

    One row for each row, repeated ones too; a null text is an empty one, of no words; a text is measured whole by
    one task, row by row. Measurements or ``failed`` whose name is taken get underscores in front; an empty table gives
    an empty ledger.
    """
    rest = [c for c in docs.columns if c.lower() != text.lower()]
    names = {m: fresh(docs.select(*rest), m) for m in MEASURES}
    raw = fresh(docs, "_raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measured(x.as_py()) for x in batch.column(len(rest))], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *(pa.array(found[:, k]) for k in range(len(MEASURES)))], names=[*rest, *names.values()])

    shape = docs.select(*rest, *[F.lit(0).cast("long").alias(n) for n in names.values()]).schema
    out = docs.select(*rest, F.col(text).cast("binary").alias(raw)).mapInArrow(run, shape)
    bits = F.lit(0).cast("long")
    measure = out.select(*[F.col(n).alias(m) for m, n in names.items()]).columns
    for k, (_, fails) in enumerate(RULES):
        for m in measure:
            fails = fails.replace(m, f"`{names[m]}`") if names[m] != m else fails
        bits = bits + F.when(F.expr(fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.withColumn(fresh(out, "failed"), bits)


def judged(rows: DataFrame, policy: str, failed: str = "failed") -> DataFrame:
    """A ledger with ``kept`` (no rule of the policy failed) and ``only_rule`` (the rule without which the text would be kept; else null)."""
    left = F.col(failed).bitwiseAND(F.lit(mask(policy)))
    only = F.lit(None).cast("string")
    for k, (name, _) in enumerate(RULES):
        only = F.when(left == 1 << k, F.lit(name)).otherwise(only)
    return rows.withColumns({fresh(rows, "kept"): left == 0, fresh(rows, "only_rule"): only})


def ablations(rows: DataFrame, policy: str, failed: str = "failed") -> DataFrame:
    """``(rule, n_failed, n_only)`` for each rule of the policy: texts that fail it, and texts that would be kept without it.

    Texts are counted by their bits within the policy first, so that what meets the rules is a row for each
    combination of failures, at most 2 to the number of rules, however many texts there are and however many share one.
    """
    combos = rows.groupBy(F.col(failed).bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    named = [F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    each = combos.select("bits", "n", F.explode(F.array(*named)).alias("r"))
    part = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(part, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger of all documents under policy ``v2``; ``n_only``: what the document's ``only_rule`` rejects alone.

    One row for each row of documents, repeated or null doc_id included.
    """
    rows = stored(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")), "ledger")
    alone = ablations(rows, "v2").select(F.col("rule").alias("only_rule"), "n_only")  # a row for each rule
    out = judged(rows, "v2").join(F.broadcast(alone), "only_rule", "left")
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed", "only_rule", "n_only")


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FAILED = " + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(RULES))
_ONLY = "CASE failed " + " ".join(f"WHEN {1 << k} THEN '{name}'" for k, (name, _) in enumerate(RULES)) + " END"
SQL = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_W} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM win WHERE n > 1) AS x GROUP BY rid),
m AS (SELECT t.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits FROM t LEFT JOIN rep ON rep.rid = t.rid),
l AS (SELECT *, ({_FAILED})::BIGINT AS failed FROM m), o AS (SELECT *, {_ONLY} AS only_rule FROM l)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept, failed, only_rule, CASE WHEN only_rule IS NOT NULL THEN count(*) OVER (PARTITION BY only_rule) END AS n_only
FROM o
"""
