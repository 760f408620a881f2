"""Secret scan: Boolean trigram queries from each rule's regex, postings intersected, candidates verified."""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read, stored

#: Noncharacter set around matches; texts that hold it have it replaced by the next one, which no rule matches either.
MARK, OTHER = "﷐", "﷑"
#: Exact alternatives that one literal run may have before it is split.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    base: bool = False
    group: int = 0
    least: int = 0
    """Matches whose ``group`` has fewer characters are dropped after matching."""


RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", base=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", base=True, least=20),
    Rule("hex", r"[0-9a-f]{24,}", base=True, least=24),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("live_key", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z]{2,20}://[A-Za-z0-9._-]+:[A-Za-z0-9._~-]+@"),
]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Disjunction of trigram conjunctions, in lower case, that every match of ``pattern`` satisfies.

    ``[frozenset()]``: no trigram is mandatory and the rule has to scan all texts.
    """

    def both(x: list[frozenset], y: list[frozenset]) -> list[frozenset]:
        made = {a | b for a in x for b in y}
        return list(made) if len(made) <= 4 * MOST_ALTERNATIVES else x

    def of_run(run: set[str]) -> list[frozenset]:
        return list({frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in run})

    def exact(tokens) -> set[str] | None:
        """All strings that the tokens match, if these are few."""
        out = {""}
        for op, arg in tokens:
            if op is C.LITERAL:
                one = {chr(arg)}
            elif op is C.SUBPATTERN:
                one = exact(arg[-1])
            elif op is C.BRANCH:
                each = [exact(x) for x in arg[1]]
                one = None if None in each else set().union(*each)
            elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 6:
                one = {chr(v) for _, v in arg}
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 2 and (inner := exact(arg[2])) is not None:
                one = {""} if arg[0] == 0 else set()
                power = {""}
                for n in range(1, int(arg[1]) + 1):
                    power = {a + b for a in power for b in inner}
                    one |= power if n >= arg[0] else set()
            else:
                one = None
            if one is None or len(out) * len(one) > MOST_ALTERNATIVES:
                return None
            out = {a + b for a in out for b in one}
        return out

    def walk(tokens) -> list[frozenset]:
        query, run = [frozenset()], {""}
        for token in tokens:
            one = exact([token])
            if one is not None and len(run) * len(one) <= MOST_ALTERNATIVES:
                run = {a + b for a in run for b in one}
                continue
            query, run = both(query, of_run(run)), {""}
            op, arg = token
            if one is not None:
                run = one
            elif op is C.SUBPATTERN:
                query = both(query, walk(arg[-1]))
            elif op is C.BRANCH:
                query = both(query, [c for x in arg[1] for c in walk(x)])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                query = both(query, walk(arg[2]))
        query = both(query, of_run(run))
        return [frozenset()] if frozenset() in query else [c for c in query if not any(o < c for o in query)]

    return walk(P.parse(pattern))


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]


def trigram_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Stored inverted index ``(trigram, d, th)`` over whole texts in lower case, of the trigrams that rules ask for."""
    text = F.lower(F.coalesce("text", F.lit("")))
    held = docs.select(*_key(), text.alias("t")).select("d", "th", F.array(*[F.when(F.contains("t", F.lit(x)), F.lit(x)) for x in trigrams]).alias("x"))
    return stored(held.select(F.explode(F.array_compact("x")).alias("trigram"), "d", "th"), "trigrams")


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Stored ``(d, th, kinds)``: documents whose postings satisfy a rule's query, with the rules' kinds."""
    wanted = [(r.kind, n, t, len(c)) for r in rules for n, c in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for t in c]
    asked = docs.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n"), F.lit(t).alias("trigram"), F.lit(size).alias("size")) for k, n, t, size in wanted])).alias("q")).select("q.*")
    postings = trigram_postings(docs, sorted({t for _, _, t, _ in wanted})).distinct()
    met = postings.join(F.broadcast(asked), "trigram").groupBy("d", "th", "kind", "n", "size").count().where("count = size")
    return stored(met.groupBy("d", "th").agg(F.collect_set("kind").alias("kinds")), "candidates")


def _spans(rules: list[Rule], n: int, text: str) -> str:
    """SQL for the spans of rule ``n`` in column ``text``: array<struct<start,n,end>> in code points."""
    rule = rules[n]
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    keep = "true"
    if rule.group:
        keep = f"length(regexp_extract(x, '{pattern}', {rule.group})) >= {rule.least}"
    elif rule.least:
        keep = f"length(x) >= {rule.least}"
    parts = f"split(regexp_replace(replace({text}, '{MARK}', '{OTHER}'), '{pattern}', '{MARK}$0{MARK}'), '{MARK}')"
    start = "named_struct('at', 0, 'odd', false, 'out', cast(array() AS array<struct<start:int,n:int,end:int>>))"
    span = f"named_struct('start', a.at, 'n', {n}, 'end', a.at + length(x))"
    step = f"named_struct('at', a.at + length(x), 'odd', NOT a.odd, 'out', if(a.odd AND {keep}, concat(a.out, array({span})), a.out))"
    return f"aggregate({parts}, {start}, (a, x) -> {step}, a -> a.out)"


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> of the base kinds, base_sha256, spans, and n_spans.

    Null texts count as empty and have no spans. Matches of a kind are leftmost and don't overlap;
    spans of different kinds may. Repeated rows each get their row. Other columns are not looked at.
    """
    gated = [r for r in rules if trigram_query(r.pattern) != [frozenset()]]
    found = candidates(docs, gated)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(), F.coalesce("text", F.lit("")).alias("text")).join(found, ["d", "th"], "left")
    none = F.expr("cast(array() AS array<struct<start:int,n:int,end:int>>)")
    each = [F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if r in gated else F.col("text").rlike(r.pattern), F.expr(_spans(rules, n, "text"))).otherwise(none) for n, r in enumerate(rules)]
    rows = rows.select("doc_id", F.sort_array(F.concat(*each)).alias("s"))
    name = F.array(*[F.lit(r.kind) for r in rules])

    def told(only_base: bool) -> Column:
        s = F.filter("s", lambda x: x["n"].isin([n for n, r in enumerate(rules) if r.base])) if only_base else F.col("s")
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(name, x["n"]), x["start"], x["end"])), ",")

    return rows.select(
        "doc_id",
        *[F.size(F.expr(f"filter(s, x -> x.n = {n})")).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(rules) if r.base],
        F.sha2(told(True), 256).alias("base_sha256"), told(False).alias("spans"), F.size("s").cast("long").alias("n_spans"),
    )


def redacted(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every span that ``scan`` would report replaced by ``<kind>``, rules in their order; a later rule sees what earlier ones left.

    Matches that a rule's length drops stay. Null texts stay null; other columns pass through.
    """
    def told(r: Rule, text: Column) -> Column:
        marked = F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), r.pattern, f"{MARK}$0{MARK}"), MARK)

        def part(x: Column, i: Column) -> Column:
            size = F.length(F.regexp_extract(x, r.pattern, r.group)) if r.group else F.length(x)
            return F.when((i % 2 == 1) & (size >= r.least), F.lit(f"<{r.kind}>")).otherwise(x)

        return F.array_join(F.transform(marked, part), "")  # names the text once: rules nest

    text = F.col("text")
    for r in rules:
        text = told(r, text)
    return docs.withColumn("text", text)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan`` of all documents; nulls, repeats and empty texts as there."""
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    each = []
    for n, r in enumerate(RULES):
        keep = f"length(regexp_extract(p[i], '{quote(r.pattern)}', {r.group})) >= {r.least}" if r.group else f"length(p[i]) >= {r.least}"
        each.append(
            f"SELECT rid, {n} AS n, '{r.kind}' AS kind, list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::BIGINT AS s, length(p[i]) AS len FROM "
            f"(SELECT rid, string_split(regexp_replace(replace(text, chr(64976), chr(64977)), '{quote(r.pattern)}', chr(64976) || '\\0' || chr(64976), 'g'), chr(64976)) AS p FROM d), "
            f"unnest(range(2, len(p) + 1, 2)) AS u(i) WHERE {keep}"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(each)}),
g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) AS n_spans,
    string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, n) FILTER (n < 3) AS base, string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, n) AS spans
  FROM m GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN g USING (rid)
"""


SQL = _sql()
