"""A versioned table of rows by key: buckets by the key's hash, merges that rewrite the touched ones, atomic commits.

Layout under the root: ``data/<id>/bucket=<b>/*.parquet`` and ``commits/<version>.json``. A commit names the folder
of each bucket, so it is as large as the number of buckets, not of rows, and older versions stay readable until
``vacuum``. Rows that a merge doesn't change are neither read beyond their bucket nor written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import commits


class Snapshots:
    """Rows of ``schema`` by ``key``; ``order`` is a column that grows with each change of a key, such as a revision.

    Of a key's rows the one with the largest order counts; of equal ones the stored row, so a change that comes again
    does nothing. Deleted rows stay as marks without content: an older change that arrives late doesn't revive them.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: Sequence[str], order: str, buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.order, self.buckets = spark, root.rstrip("/"), list(key), order, buckets
        self.schema = T._parse_datatype_string(schema)
        self._stored = T.StructType([*self.schema.fields, T.StructField("_deleted", T.BooleanType())])

    def version(self) -> int:
        return commits.latest(self.spark, self.root)[0]

    def _rows(self, content: dict, only: Sequence[int] | None = None) -> DataFrame:
        """Stored rows of some buckets, marks of deletion included."""
        at = {b: f for b, f in content.get("buckets", {}).items() if only is None or int(b) in only}
        if not at:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*[f"{self.root}/data/{f}/bucket={b}" for b, f in at.items()])

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows of a version, by default the newest."""
        content = commits.latest(self.spark, self.root)[1] if version is None else commits.load(self.spark, self.root, version)
        return self._rows(content).where("NOT _deleted").drop("_deleted")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, writer: str = "default", batch: int | None = None, deleted: str | None = None) -> int:
        """Applies ``changes`` (columns of the schema, and ``deleted`` if named) as one version; returns the version that holds them.

        ``batch``: a number that grows with each of a writer's batches; one that is applied already changes nothing.
        Changes that lose against the stored row, or repeat it, touch no bucket; no change left, no version.
        A writer that fails before its commit leaves only files that no version names.
        """
        while True:
            version, content = commits.latest(self.spark, self.root)
            if batch is not None and content.get("writers", {}).get(writer, -1) >= batch:
                return version
            if content and content["bucket_count"] != self.buckets:
                raise ValueError(f"{self.root} has {content['bucket_count']} buckets")
            gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
            new = changes.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], gone.alias("_deleted"), self._bucket().alias("bucket"))
            # of a batch's changes of one key the last counts, of equal orders the one with the larger hash
            rank = F.struct(F.col(self.order), F.xxhash64(*self._stored.names))
            new = new.groupBy(*self.key, "bucket").agg(F.max_by(F.struct(*self._stored.names), rank).alias("n")).select("bucket", "n.*")
            new = commits.kept(new, "changes")
            known = self._rows(content, [r.bucket for r in new.select("bucket").distinct().collect()]).select(*self.key, F.col(self.order).alias("_was"))  # at most a row for each bucket
            same = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.key]
            wins = new.alias("c").join(known.alias("o"), same, "left").where(F.col("_was").isNull() | (F.col(f"c.{self.order}") > F.col("_was"))).select("c.*")
            wins = commits.kept(wins, "wins")
            touched = [r.bucket for r in wins.select("bucket").distinct().collect()]
            held = {k: v for k, v in content.get("writers", {}).items()} | ({writer: batch} if batch is not None else {})
            try:
                if touched:
                    folder = f"{version + 1:012d}-{uuid.uuid4().hex}"
                    rest = self._rows(content, touched).withColumn("bucket", self._bucket()).alias("o")
                    rest = rest.join(wins.alias("c"), [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.key], "left_anti")
                    whole = rest.unionByName(wins.select(rest.columns))
                    whole.repartition("bucket").sortWithinPartitions(*self.key).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
                    commits.publish(self.spark, self.root, version + 1, {"bucket_count": self.buckets, "writers": held, "buckets": content.get("buckets", {}) | {str(b): folder for b in touched}})
                elif held != content.get("writers", {}):
                    commits.publish(self.spark, self.root, version + 1, {"bucket_count": self.buckets, "writers": held, "buckets": content.get("buckets", {})})
                else:
                    return version
                return version + 1
            except commits.Conflict:
                continue  # another writer was first: its rows are merged with next

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Keys whose row changed between two versions: the key's columns and ``change`` (created, updated, removed).

        Only buckets whose folder differs are read.
        """
        old = commits.load(self.spark, self.root, since) if since else {}
        new = commits.load(self.spark, self.root, until) if until else commits.latest(self.spark, self.root)[1]
        moved = [int(b) for b, f in new.get("buckets", {}).items() if old.get("buckets", {}).get(b) != f]
        live = lambda content: self._rows(content, moved).where("NOT _deleted").select(*self.key, F.col(self.order).alias("v"))
        o, n = live(old).alias("o"), live(new).alias("n")
        both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.key], "full").where(~F.col("o.v").eqNullSafe(F.col("n.v")))
        change = F.when(F.col("o.v").isNull(), "created").when(F.col("n.v").isNull(), "removed").otherwise("updated")
        return both.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in self.key], change.alias("change"))

    def vacuum(self, keep: int = 1) -> int:
        """Removes bucket folders that none of the newest ``keep`` versions names; returns how many. Not while a writer runs."""
        newest = self.version()
        used = {(f, f"bucket={b}") for v in range(max(1, newest - keep + 1), newest + 1) for b, f in commits.load(self.spark, self.root, v)["buckets"].items()}
        gone = 0
        for folder in commits.listed(self.spark, f"{self.root}/data"):
            stale = [b for b in commits.listed(self.spark, f"{self.root}/data/{folder}") if b.startswith("bucket=") and (folder, b) not in used]
            for b in stale:
                commits.delete(self.spark, f"{self.root}/data/{folder}/{b}")
            gone += len(stale)
            if folder not in {f for f, _ in used}:
                commits.delete(self.spark, f"{self.root}/data/{folder}")
        for v in range(1, newest - keep + 1):
            commits.delete(self.spark, f"{self.root}/commits/{v:012d}.json")
        return gone
