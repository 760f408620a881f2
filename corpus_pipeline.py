"""Corpus pipeline: raw documents to a training mix, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, where docs has the columns of documents, and returns a DataFrame;
what it returns is written and read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loregrid.llm import decontaminate, lines, mixing, quality, simhash
from loregrid.llm.common import read, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the classifier rejects go.

    Null and empty texts are judged by their shape like any other; repeated rows share their fate, rows that repeat only
    doc_id are judged by their own texts; labels of unknown documents have no effect; without labels all documents
    stay; an empty table stays empty. Columns keep their names whatever they are.
    """
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of similar lines the first stays; the texts lose the others.

    First is by doc_id (null before all), then line, then the text's hash; rows that repeat doc_id and text lose the same
    lines. A null text stays null, an empty one empty; a text may lose all its lines and stays as an empty one; an
    empty table stays empty. n_chars follows the text, other columns pass through.
    """
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of documents with near fingerprints the one with the smallest doc_id stays.

    Null doc_ids come last, ties go to one of the rows by the text's hash, so of repeated rows one stays. Texts
    without words (null ones too) have one fingerprint and are near each other; an empty table stays empty.
    Columns pass through, whatever their names.
    """
    return simhash.deduplicated(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: contaminated documents go.

    Null and empty texts have no words and stay; repeated rows share their fate; null benchmark items and items
    without words hit nothing; without a benchmark all documents stay; an empty table stays empty. Columns pass through.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: a sample by calibrated probabilities that holds a set share of the tokens; adds the column weight (``_weight`` if taken).

    Documents without words (null or empty texts) have probability 0; repeated rows share their fate; an empty table stays empty.
    """
    return mixing.sample(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_filter", benchmark_filter),
    ("source_mix", source_mix),
]
#: SQL can't express the fitted classifier or the hashed signatures; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
