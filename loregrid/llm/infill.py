"""Fill-in-middle: texts cut at two random units into prefix, middle and suffix, by relational units.

The units of a text are rows (ordinal, length), a running sum over them gives where each one ends, and the two cuts
of a document are requests for ordinals that meet these rows by a join. Only numbers travel; the text itself is
cut by substring once its two offsets are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import bounded, fresh, read, stored

#: A unit: a word with the blanks before it, or the blanks at a text's end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Per cent of the texts that are cut, and of those, that put the suffix first.
CUT, SUFFIX_FIRST = 50, 80
SEED = "42"


def _drawn(doc_id: Column, k: int, seed: str) -> Column:
    """The k-th group of 8 hexadecimal digits of the hash of seed and doc_id, as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 8 * k - 7, 8), 16, 10).cast("long")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def rebuilt(output: Column, form: Column) -> Column:
    """The text from an output and its form. Cut texts hold no mark, so the first ones found are the form's own."""
    parts = F.split(output, "|".join(MARKS), 4)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def offsets(units: DataFrame, requests: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, first, last)``: the code points before the smallest and the largest cut of each document that has a cut after some unit.

    ``units(*key, ordinal, length)``, ordinals from 1, each once; ``requests(*key, cuts)``: a row for each document, a cut
    being the number of units before it. A document's units are summed in order as they stream by, never gathered.
    """
    ends = units.withColumn("end", F.sum("length").over(W.partitionBy(*key).orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.currentRow)))
    # the join's key is the document alone, by which units are partitioned already; the ordinal is met within it
    met = ends.join(requests.hint("merge"), key).where(F.array_contains("cuts", F.col("ordinal")))
    return met.groupBy(*key).agg(F.min(F.struct("ordinal", "end")).alias("low"), F.max(F.struct("ordinal", "end")).alias("high"), F.first("cuts").alias("cuts")).select(
        *key, F.when(F.array_min("cuts") == F.col("low.ordinal"), F.col("low.end")).otherwise(0).alias("first"), F.col("high.end").alias("last")
    )


def transformed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """Each row of ``docs`` with ``n`` units, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    Plain are empty texts, texts that hold a mark, and those that aren't drawn. Null texts are empty, a null doc_id
    is drawn as an empty one; rows that repeat doc_id and text are cut alike, rows that repeat only doc_id by their own units.
    Added columns whose name is taken get underscores in front; an empty table stays empty.
    """
    n, form, pc, mc, out, d, th = (fresh(docs, c) for c in ("n", "form", "prefix_chars", "middle_chars", "output", "_d", "_th"))
    whole, units_of = F.coalesce(F.col(text), F.lit("")), lambda t: F.regexp_extract_all(t, F.lit(UNIT), F.lit(0))
    marked = F.contains(whole, F.lit(MARKS[0])) | F.contains(whole, F.lit(MARKS[1])) | F.contains(whole, F.lit(MARKS[2]))
    drawn = F.when(_drawn(F.col(doc_id), 3, seed) % 100 >= CUT, "plain").when(_drawn(F.col(doc_id), 4, seed) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    keyed = docs.withColumn(form, F.when((whole == "") | marked, "plain").otherwise(drawn))
    plain = keyed.where(F.col(form) == "plain").withColumns({n: F.size(units_of(whole)).cast("long"), pc: F.lit(None).cast("long"), mc: F.lit(None).cast("long"), out: whole})
    # the hash tells a null doc_id from the number that stands for it
    cut = keyed.where(F.col(form) != "plain").withColumns({d: F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), th: F.xxhash64(whole, F.col(doc_id).isNull())})
    found = cut.select(F.col(d).alias("d"), F.col(th).alias("th"), F.transform(units_of(whole), lambda u: F.length(u)).alias("ls"), _drawn(F.col(doc_id), 1, seed).alias("h1"), _drawn(F.col(doc_id), 2, seed).alias("h2"))
    found = found.withColumns({"n": F.size("ls"), "c1": (F.col("h1") % (F.size("ls") + 1)).cast("int"), "c2": (F.col("h2") % (F.size("ls") + 1)).cast("int")})
    # units behind the last cut aren't needed; rows that repeat a document have one set of units
    found = stored(found.select("d", "th", "n", F.array("c1", "c2").alias("cuts"), F.slice("ls", F.lit(1), F.greatest("c1", "c2")).alias("ls")), "units")
    once = found.dropDuplicates(["d", "th"])
    units = once.select("d", "th", F.posexplode("ls").alias("p", "length")).select("d", "th", (F.col("p") + 1).alias("ordinal"), "length")
    requests = found.groupBy("d", "th").agg(F.first("cuts").alias("cuts"), F.first("n").alias("n"))
    at = requests.join(offsets(units, requests.drop("n"), ["d", "th"]), ["d", "th"], "left")
    at = stored(at.select(F.col("d").alias(d), F.col("th").alias(th), F.col("n").cast("long").alias(n), F.coalesce("first", F.lit(0)).alias("_first"), F.coalesce("last", F.lit(0)).alias("_last")), "offsets")
    first, last = (fresh(docs, c) for c in ("_first", "_last"))
    at = at.withColumnsRenamed({"_first": first, "_last": last})
    # offsets are broadcast behind a bound in bytes; beyond it the cut texts, and only these, move once
    placed = cut.join(bounded(at, at.count(), 40), [d, th])
    p, m, s = F.substring(whole, F.lit(1), F.col(first)), F.substring(whole, F.col(first) + 1, F.col(last) - F.col(first)), F.substring(whole, F.col(last) + 1, F.length(whole))
    psm, spm = (F.concat(F.lit(MARKS[0]), p, F.lit(MARKS[1]), s, F.lit(MARKS[2]), m), F.concat(F.lit(MARKS[1]), s, F.lit(MARKS[0]), p, F.lit(MARKS[2]), m))
    placed = placed.withColumns({pc: F.col(first).cast("long"), mc: (F.col(last) - F.col(first)).cast("long"), out: F.when(F.col(form) == "psm", psm).otherwise(spm)})
    shown = [*docs.columns, n, form, pc, mc, out]
    return placed.select(*shown).unionByName(plain.select(*shown))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``transformed`` of all documents, with digests of the output and of the text rebuilt from it; nulls and repeats as there."""
    out = transformed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _digest(F.col("output")).alias("output_sha256"), _digest(rebuilt(F.col("output"), F.col("form"))).alias("restored_sha256"))


_H = "('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), {}, 8))::BIGINT"
SQL = f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(coalesce(text, ''), '{UNIT}'), lambda x: length(x)) AS u,
  {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(17)} AS h3, {_H.format(25)} AS h4 FROM documents),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
  coalesce(list_sum(u[1:least(h1 % (len(u) + 1), h2 % (len(u) + 1))]), 0)::BIGINT AS a, coalesce(list_sum(u[1:greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))]), 0)::BIGINT AS b FROM t)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
    ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""
