"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontaminate, infill, licenses, lines, mixing, quality, rules, secrets, simhash, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_nearest_neighbours": ann.op2_nearest_neighbours,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_warc": warc.op9_warc,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_quality_rules": rules.op12_quality_rules,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op1_secret_scan": secrets.SQL,
    "op3_source_mixing": mixing.SQL,
    "op4_license_scan": licenses.SQL,
    "op6_chat_formatting": chat.SQL,
    "op9_warc": warc.SQL,
    "op10_benchmark_decontamination": decontaminate.SQL,
    "op11_prefix_trie": trie.SQL,
    "op12_quality_rules": rules.SQL,
    "op13_fill_in_middle": infill.SQL,
}
