"""Text expressions: one tokenizer and the matchers built on it, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The stop words (English and Italian) that the content tokenizer drops.
STOPWORDS = """
a an and or but the of to in on at by for with as
is are was were be been being have has had do does did
will would could should may might can shall we you i he
she it they them us my your our their this that these
those how what why when where who which so if then than
about into from up down out over under not no yes il la
le lo gli un uno una di da del della che e o ma se
ci si mi ti per con su come quando perche cosa dove chi
quale non sono era stato
""".split()
# Bounds of the tokenizer, the recall query and the lexical gate.
MIN_TOKEN_BYTES, MAX_RECALL_TERMS = 3, 32
RARE_TERM_LEN, RARE_TERMS, PHRASE_LEN = 7, 2, 3


def content_tokens(text: Column) -> Column:
    """Words in lower case, at least 3 bytes long, stop words dropped, in order, repeats kept."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: (F.octet_length(w) >= MIN_TOKEN_BYTES) & ~w.isin(STOPWORDS))


def recall_terms(text: Column) -> Column:
    """Distinct content words; above 32 the longest ones (earlier first among equals), in text order."""
    words = F.array_distinct(content_tokens(text))
    placed = F.transform(words, lambda w, i: F.struct((-F.octet_length(w)).alias("n"), i.alias("i"), w.alias("w")))
    kept = F.slice(F.sort_array(placed), 1, MAX_RECALL_TERMS)
    back = F.sort_array(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"))))
    return F.when(F.size(words) <= MAX_RECALL_TERMS, words).otherwise(F.transform(back, lambda x: x["w"]))


def shingles(words: Column, n: int, sep: str = " ") -> Column:
    """All runs of ``n`` neighbouring elements, joined; fewer elements: none."""
    some = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), sep))
    return F.when(F.size(words) >= n, some).otherwise(F.array().cast("array<string>"))


def identifiers(text: Column) -> Column:
    """Tokens that look like code: underscore, ``::``, dot, digit or camel case; in lower case."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    looks = lambda w: (F.octet_length(w) >= 3) & (w.rlike(r"[_.\p{N}]|::") | (w.rlike(r"\p{Ll}") & w.rlike(r"^.+\p{Lu}")))
    return F.transform(F.filter(bare, looks), F.lower)


def strong_lexical(query: Column, entry: Column) -> Column:
    """An identifier of the query in the entry, a shared run of 3 content words, or 2 shared words of 7 bytes or more."""
    return strong_tokens(content_tokens(query), content_tokens(entry), identifiers(query), entry)


def strong_tokens(q: Column, e: Column, ids: Column, entry: Column) -> Column:
    """``strong_lexical`` from content words and identifiers that are columns already."""
    rare = F.filter(F.array_intersect(q, e), lambda w: F.octet_length(w) >= RARE_TERM_LEN)
    return F.exists(ids, lambda w: F.contains(F.lower(entry), w)) | F.arrays_overlap(shingles(q, PHRASE_LEN), shingles(e, PHRASE_LEN)) | (F.size(rare) >= RARE_TERMS)


def compact_word(word: Column) -> Column:
    """Letters and digits in lower case; one plural s goes if more than 3 characters are there."""
    w = F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))
    return F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def names_file_stem(query: Column, path: Column, least: int = 8) -> Column:
    stem = compact_word(file_stem(path))
    return (F.length(stem) >= least) & F.array_contains(F.transform(words_of(query), compact_word), stem)


def ref_forms(reference: Column) -> Column:
    """Ways to write a reference, in the order in which they are tried: as is, without ./ or /, with and without .md."""
    bare = F.regexp_replace(reference, r"^(\./|/)+", "")
    plain = F.regexp_replace(bare, r"\.md$", "")
    return F.array_distinct(F.array(reference, bare, F.concat(plain, F.lit(".md")), plain))


def link_target(target: Column) -> Column:
    """A link's target without its anchor and with .md."""
    bare = F.regexp_replace(F.trim(target), "#.*$", "")
    return F.when(bare == "", bare).when(bare.endswith(".md"), bare).otherwise(F.concat(bare, F.lit(".md")))


def like_pattern(text: str) -> str:
    """``text`` as a LIKE pattern that contains it literally (escape character: backslash)."""
    return "%" + "".join(f"\\{c}" if c in "\\%_" else c for c in text) + "%"


# Credential patterns and what replaces them, in the order in which they are applied.
REDACTIONS = [
    (r"(?i)(password|passwd|secret|api[_-]?key|access[_-]?key|token)\s*[=:]\s*\S+", "$1=[REDACTED]"),
    (r"(?i)bearer\s+[A-Za-z0-9._\-]+", "Bearer [REDACTED]"),
    (r"\b(?:sk|ghp|gho|ghs|ghr|pk|rk)[-_][A-Za-z0-9]{16,}\b", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"://[^/\s:@]+:[^/\s@]+@", "://[REDACTED]@"),
    (r"\b[A-Fa-f0-9]{32,}\b", "[REDACTED]"),
    (r"(?:/Users|/home)/[^/\s]+", "~"),
    (r"(?i)[A-Z]:\\Users\\[^\\\s]+", "%USERPROFILE%"),
]


def redact(text: Column) -> Column:
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


# Words and phrases that mark a correction by the user, and headers of generated prompts.
CORRECTION_WORDS = ["no", "nope", "wrong", "instead", "don't", "dont", "actually", "stop", "revert", "undo"]
CORRECTION_PHRASES = ["next time", "remember", "should have", "do not"]
HOOK_HEADERS = ["stop hook violation:", "stop hook feedback:", "<system-reminder>"]


def is_correction(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    said = F.arrays_overlap(F.split(low, r"[^\p{L}\p{N}']+"), F.array(*map(F.lit, CORRECTION_WORDS)))
    for p in CORRECTION_PHRASES:
        said = said | F.contains(low, F.lit(p))
    return said


def is_hook_generated(text: Column) -> Column:
    low = F.lower(F.ltrim(F.coalesce(text, F.lit(""))))
    found = F.lit(False)
    for h in HOOK_HEADERS:
        found = found | low.startswith(h)
    return found


def signature_tokens(signature: Column) -> Column:
    """Distinct words of an error signature in lower case: longer than a byte, not only digits."""
    parts = F.split(F.coalesce(signature, F.lit("")), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda w: (F.octet_length(w) > 1) & ~w.rlike("^[0-9]+$")), F.lower))


#: Fixed value: share of the known signature's words that an error has to repeat.
SIGNATURE_RATIO = 0.6


def signatures_match(known: Column, observed: Column) -> Column:
    k = signature_tokens(known)
    return (F.size(k) > 0) & (F.size(F.array_intersect(k, signature_tokens(observed))) / F.size(k) >= SIGNATURE_RATIO)
