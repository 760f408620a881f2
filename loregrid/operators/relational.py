"""Reusable relational operators: bands, as-of, latest-by-key, percentiles, components, degrees."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import commits
from .bounds import small

#: Spans into which distinct values are dealt for running sums.
SPANS = 64
#: Rows of commits that one task holds, on the average.
TASK_ROWS = 500_000
#: Files of a commit that one row holds, where no commit is too large.
LISTED = 256
#: Rows of a many-to-many join: right rows of a block, blocks and left rows of a tile, pairs that one task writes on the average, tasks at most.
RUN, TILE_RUNS, TILE_ROWS, TASK_PAIRS, MOST_TASKS = 256, 16, 2_048, 32_000_000, 4_096


def band_semi_join(df: DataFrame, key: str, at: str, width: int, tie: str) -> DataFrame:
    """Rows with another row of the same ``key`` within ``width`` of ``at`` (rows differ in ``tie``).

    The neighbours in time order decide, so a hot key costs a sort, not a product: the nearest other row
    within the band is always the one before or after.
    """
    w = W.partitionBy(key).orderBy(at, tie)
    near = (F.col(at) - F.lag(at).over(w) <= width) | (F.lead(at).over(w) - F.col(at) <= width)
    return df.withColumn("_near", F.coalesce(near, F.lit(False))).where("_near").drop("_near")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` at or before ``left_at``; one sort for each key, no product."""
    l = left.withColumns({"_t": F.col(left_at), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    r = right.select(F.col(key), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("_t", "_side", F.coalesce("_v", F.lit(None))).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_t", "_side", "_v")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def offset_percentile(values: Column, p: int) -> Column:
    """Sorted value at the 0-based index floor(n * p / 100), n - 1 at most; null without values."""
    n = F.size(values)
    return F.get(F.sort_array(values), F.least(F.floor(n * p / 100), n - 1).cast("int"))


def offset_percentiles(df: DataFrame, value: str, ps: tuple[int, ...]) -> DataFrame:
    """One row ``p50, p95, ...`` of offset percentiles without gathering the values: counts by value, then running sums.

    The counts are stored once and read by each of these steps. Distinct values are dealt into ``SPANS`` spans by approximate quantiles and summed within each; only the
    spans' totals pass through a single ordered partition. Where the cuts lie doesn't change the result.
    """
    counts = commits.kept(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c")), "counts")
    cuts = counts.agg(F.percentile_approx(value, [k / SPANS for k in range(1, SPANS)])).first()[0] or []
    span = F.lit(0)
    for cut in sorted(set(cuts)):
        span = span + F.when(F.col(value) >= cut, 1).otherwise(0)
    dealt = counts.withColumn("span", span)
    totals = dealt.groupBy("span").agg(F.sum("c").alias("t"))  # SPANS rows at most
    before = totals.select("span", (F.sum("t").over(W.orderBy("span")) - F.col("t")).alias("low"))
    run = dealt.withColumn("hi", F.sum("c").over(W.partitionBy("span").orderBy(value))).join(F.broadcast(before), "span")
    run = run.withColumn("hi", F.col("hi") + F.col("low")).crossJoin(F.broadcast(totals.agg(F.sum("t").alias("n"))))
    hit = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return run.agg(*[F.min(F.when(F.col("hi") > hit(p), F.col(value))).alias(f"p{p}") for p in ps])


def cochange(commits: DataFrame, most_files: int | None = 100, least: int = 2) -> DataFrame:
    """``(file_a, file_b, n)``: unordered pairs of files by the commits that touch both.

    Commits with fewer than ``least`` or more than ``most_files`` rows are left out, counted before repeats
    go; None: no commit is too large. Rows are dealt by commit once, ``TASK_ROWS`` to a task, and a
    commit makes its pairs from the list of its files. Without a bound, commits of more than ``LISTED`` files make theirs from
    blocks of files that meet by two, so no row holds a large commit.
    """
    tasks = max(commits.sparkSession.sparkContext.defaultParallelism, ceil(commits.count() / TASK_ROWS))
    each = commits.where("commit_id IS NOT NULL").repartition(tasks, "commit_id").groupBy("commit_id", "path").agg(F.count("*").alias("rows"))
    commit = W.partitionBy("commit_id")
    held = each.withColumn("rows", F.sum("rows").over(commit)).where(F.col("rows") >= least if most_files is None else F.col("rows").between(least, most_files))
    if most_files is None:
        held = held.withColumn("files", F.count("path").over(commit))
    listed = held if most_files is not None else held.where(F.col("files") <= LISTED)
    files = listed.groupBy("commit_id").agg(F.array_sort(F.collect_list("path")).alias("files"))  # ``most_files`` or ``LISTED`` at most
    after = lambda x, i: F.transform(F.slice("files", i + 2, F.size("files")), lambda y: F.struct(x.alias("file_a"), y.alias("file_b")))
    pairs = files.select(F.inline(F.flatten(F.transform("files", after))))
    if most_files is None:
        large = held.where(F.col("files") > LISTED)
        if not large.isEmpty():
            pairs = pairs.unionByName(_block_pairs(large))
    return pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("n"))


def _block_pairs(held: DataFrame) -> DataFrame:
    """``(file_a, file_b)`` of each commit in ``held(commit_id, path, files)``: its files lie in blocks of about ``LISTED``, every two of which meet."""
    blocks = held.where("path IS NOT NULL").withColumn("blocks", F.ceil(F.col("files") / LISTED).cast("int"))
    blocks = blocks.groupBy("commit_id", "blocks", F.pmod(F.xxhash64("path"), "blocks").cast("int").alias("block")).agg(F.collect_list("path").alias("run"))
    first = blocks.select("commit_id", F.col("block").alias("i"), F.col("run").alias("xs"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    second = blocks.select("commit_id", F.col("block").alias("j"), F.col("run").alias("ys"))
    met = first.join(second, ["commit_id", "j"]).select("i", "j", "ys", F.explode("xs").alias("x"))
    others = F.filter("ys", lambda y: (F.col("i") < F.col("j")) | (F.col("x") < y))
    return met.select(F.inline(F.transform(others, lambda y: F.struct(F.least("x", y).alias("file_a"), F.greatest("x", y).alias("file_b")))))


def many_to_many(left: DataFrame, right: DataFrame, key: str, sort: bool = False) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, of which both sides have many rows, so that the result dwarfs them; both are read twice.

    A key's left rows are dealt into parts and its right rows into blocks of ``RUN``; a part and ``TILE_RUNS`` blocks are a tile, and
    tiles are dealt to tasks by the pairs they make, so that a hot key is many tasks. Within a tile a left row meets a
    whole block before the next one comes: a written result is runs of the left columns and short cycles of the right
    ones, which columnar files hold in about a tenth of a byte a row, where rows in the order of the left table take several.
    ``sort``: rows of a block are sorted by the right columns in their order, for columns that are told from both sides.
    """
    named = lambda df: [c for c in df.columns if c != key]
    counted = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    sizes = commits.kept(counted(left, "l").join(counted(right, "r"), key), "sizes")
    pairs = sizes.agg(F.coalesce(F.sum(F.col("l").cast("double") * F.col("r")), F.lit(0.0))).first()[0]
    rows = sizes.agg(F.coalesce(F.sum(F.col("l") + F.col("r")), F.lit(0))).first()[0]
    tasks = min(MOST_TASKS, max(left.sparkSession.sparkContext.defaultParallelism, ceil(pairs / TASK_PAIRS), ceil(rows / TASK_ROWS)))
    sizes = small(sizes.select(key, F.ceil(F.col("l") / TILE_ROWS).cast("int").alias("_parts"), F.ceil(F.col("r") / RUN).cast("int").alias("_blocks")))
    tile = [key, "_part", "_group"]
    blocks = right.join(sizes, key).withColumn("_block", F.pmod(F.xxhash64(*named(right)), F.col("_blocks")).cast("int"))
    run = F.collect_list(F.struct(*named(right)))
    blocks = blocks.groupBy(key, "_block", "_parts").agg((F.array_sort(run) if sort else run).alias("_run"))
    blocks = blocks.select(key, F.floor(F.col("_block") / TILE_RUNS).cast("int").alias("_group"), "_run", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    dealt = left.join(sizes, key).withColumn("_part", F.pmod(F.xxhash64(*named(left)), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("_group", F.explode(F.sequence(F.lit(0), F.floor((F.col("_blocks") - 1) / TILE_RUNS).cast("int")))).drop("_parts", "_blocks")
    # the blocks are the side that is gone through once, the part is held and met by each of them
    met = blocks.repartition(tasks, *tile).hint("merge").join(dealt.repartition(tasks, *tile), tile)
    return met.select(key, *named(left), F.inline("_run"))


def degrees(links: DataFrame) -> DataFrame:
    """``(entity, out_degree, in_degree, total)`` from ``links(src, dst)``."""
    ends = links.select(F.col("src").alias("entity"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(links.select(F.col("dst").alias("entity"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("entity").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("total"))


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with its place, from 1, in the order over all rows, which should leave no ties: rows are sorted in ranges, and each range adds the sizes of those before it."""
    held = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = commits.kept(held, "ranges")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each range
    before = sizes.select("_part", "_first", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")
