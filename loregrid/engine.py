"""One façade over the operators: each method returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.requests import checked
from .operators import code, graph, memory, retrieval, telemetry
from .plans.filters import current, visible
from .storage import commits


class Engine:
    """``catalog`` maps table names (docs, memory, aliases, doc_links, evolution, symbols, relationships, imports, recall_candidates) to DataFrames."""

    def __init__(self, spark: SparkSession, catalog: dict[str, DataFrame]) -> None:
        self.spark, self.catalog = spark, catalog
        self._corpora: dict[str, retrieval.Corpus] = {}
        self._calls: tuple[DataFrame, DataFrame] | None = None

    def _queries(self, text: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(0).alias("query"), F.lit(text).alias("text"))

    def _corpus(self, name: str, rows: DataFrame, fields: list[str]) -> retrieval.Corpus:
        """The index and vectors of ``rows``, written at the first search and kept for the next ones."""
        if name not in self._corpora:
            self._corpora[name] = retrieval.Corpus(self.spark, commits.fresh_dir(self.spark, name), fields, fields).add(rows, "all")
        return self._corpora[name]

    def search(self, text: str, limit: int = 10, include_superseded: bool = False) -> DataFrame:
        checked(limit)
        corpus = self._corpus(f"docs-{include_superseded}", self.catalog["docs"].where(current(include_superseded)), ["title", "body"])
        return retrieval.hybrid_documents(corpus, self._queries(text), limit)

    def recall(self, text: str, now: int, limit: int = 5, floor: float = 0.40) -> DataFrame:
        checked(limit, floor=floor)
        live = self.catalog["memory"].where((F.col("status") == "active") & visible(now))
        return retrieval.recall(self._corpus(f"memory-{now}", live, ["title", "content"]), live, self._queries(text), limit, now, floor)

    def get(self, path: str) -> DataFrame:
        return self.catalog["docs"].where(F.col("path") == path)

    def memory_list(self, now: int) -> DataFrame:
        return self.catalog["memory"].where(visible(now)).withColumn("confidence", memory.confidence(F.lit(now)))

    def graph_neighbors(self, entity: int, depth: int = 1) -> DataFrame:
        checked(depth, 16)
        return graph.neighbors(self.catalog["doc_links"], entity, depth)

    def graph_path(self, start: int, target: int, most: int = 6) -> DataFrame:
        checked(most, 64)
        return graph.shortest_path(self.catalog["doc_links"], start, target, most)

    def history(self) -> DataFrame:
        return graph.current_versions(self.catalog["evolution"])

    def callers(self, among: DataFrame | None = None) -> DataFrame:
        r, s = self.catalog["relationships"], self.catalog["symbols"]
        if self._calls is None:
            forms = code.asked(r)
            proof = commits.kept(code.imported_modules(forms, s, self.catalog["imports"]), "imported")
            self._calls = commits.kept(code.placed_calls(code.nearest_tiers(r, s, forms, proof)), "placed"), proof
        return code.callers(self._calls[0], s, self._calls[1], among)

    def impact(self, symbol: int, depth: int = 2) -> DataFrame:
        return code.impact(self.callers, self.spark, symbol, depth)

    def usage(self) -> DataFrame:
        return telemetry.recall_report(self.catalog["recall_candidates"])
