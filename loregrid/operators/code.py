"""Code graph: call resolution by tiers, callers, impact."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import commits
from .bounds import small
from .relational import many_to_many

# Callable kinds, and the tiers that stand for external and unplaced targets.
CALLABLE = ("function", "method")
EXTERNAL, UNPLACED = 3, 7
#: Separators before the last parts of an owner or qualifier, and of a module.
OWNER_SEPS, MODULE_SEPS = ("::", ".", "\\"), ("::", ".")
#: Kinds of evidence (names with owners, modules, files) that are broadcast at most.
MOST_EVIDENCE = 500_000


def _tails(text: Column, seps: tuple[str, ...]) -> Column:
    """``text`` and what follows each separator in it: all that it equals or ends with after a separator."""
    starts = F.filter(F.sequence(F.lit(1), F.length(text) + 1), lambda i: (i == 1) | reduce(lambda a, b: a | b, (F.substring(text, F.lit(1), i - 1).endswith(s) for s in seps)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.length(text) + 1)))


def _targets(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("sym_id"), F.col("name").alias("to_name"), F.col("owner_name").alias("owner"), F.col("module_path").alias("module"), F.col("file_id").alias("target_file"))


def _calls(relationships: DataFrame, symbols: DataFrame, how: str) -> DataFrame:
    """Calls with their caller's module, and whether the call that made the receiver has a known name."""
    caller = symbols.select(F.col("id").alias("from_symbol_id"), F.col("module_path").alias("caller_module"), F.lit(True).alias("has_caller"))
    names = symbols.select(F.col("name").alias("to_receiver_call")).distinct().withColumn("known", F.lit(True))
    return relationships.where("kind = 'Calls'").withColumnRenamed("id", "edge").join(caller, "from_symbol_id", how).join(small(names, MOST_EVIDENCE), "to_receiver_call", "left")


def asked(relationships: DataFrame) -> DataFrame:
    """``(file_id, to_name, q)``: the distinct forms in which files call names, stored."""
    return commits.kept(relationships.where("kind = 'Calls'").select("file_id", "to_name", F.col("to_qualifier").alias("q")).distinct(), "asked")


def imported_modules(forms: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``(file_id, to_name, module)``: the modules of callables of a name that a file with calls to that name (``asked``) imports."""
    held = _targets(symbols).where("module is not null").select("to_name", "module").distinct()
    keyed = forms.select("file_id", "to_name").distinct().join(held, "to_name").select("file_id", "module", "to_name", F.explode(F.array(F.col("module"), F.concat("module", F.lit("::"), "to_name"), F.concat("module", F.lit("."), "to_name"))).alias("path"))
    return keyed.join(imports.select("file_id", "path").distinct(), ["file_id", "path"], "left_semi").select("file_id", "to_name", "module").distinct()


def resolved_edges(relationships: DataFrame, symbols: DataFrame, proof: DataFrame) -> DataFrame:
    """``(edge, from_id, sym_id, tier)``: every call with every callable of its name, by how well it is placed.

    1 and 2: qualifier or receiver type names the owner or an imported module; 3: it names something else;
    4: same file; 5: imported module; 6: same module; 7: only the name. All that a pair's tier needs is on the call or
    the callable before they meet, so pairs are made and passed on, never shuffled or stored. Calls meet blocks of callables
    (``many_to_many``), in which those of one module, owner and file are neighbours, so a written result takes little space.
    ``proof``: ``imported_modules``.
    """
    imported = proof.groupBy("file_id", "to_name").agg(F.collect_set("module").alias("imported"))  # modules that hold one name
    calls = _calls(relationships, symbols, "inner").join(small(imported, MOST_EVIDENCE), ["file_id", "to_name"], "left")
    calls = calls.select("edge", "from_symbol_id", "file_id", "to_name", "to_qualifier", "to_receiver_type", (F.col("to_receiver_call").isNotNull() & F.col("known").isNull()).alias("unknown"), "caller_module", "imported")
    targets = _targets(symbols).select("module", "owner", "target_file", "sym_id", "to_name")
    e = many_to_many(commits.kept(calls, "calls"), targets, "to_name", sort=True)
    e = e.withColumn("imported", F.coalesce(F.array_contains("imported", F.col("module")), F.lit(False)))
    q, o, m, r = (F.col(c) for c in ("to_qualifier", "owner", "module", "to_receiver_type"))
    ends = lambda a, b, *seps: F.coalesce(a == b, F.lit(False)) | F.coalesce(sum((a.endswith(F.concat(F.lit(s), b)).cast("int") for s in seps), F.lit(0)) > 0, F.lit(False))
    by_qualifier = F.when(ends(q, o, *OWNER_SEPS), 1).when(F.coalesce(m == q, F.lit(False)) | (ends(m, q, *MODULE_SEPS) & F.col("imported")), 2).otherwise(EXTERNAL)
    by_type = F.when(ends(o, r, *OWNER_SEPS), F.when(F.col("target_file") == F.col("file_id"), 1).otherwise(2)).otherwise(EXTERNAL)
    tier = (
        F.when(q.isNotNull(), by_qualifier).when(r.isNotNull(), by_type).when(F.col("unknown"), EXTERNAL)
        .when(F.col("target_file") == F.col("file_id"), 4).when(m.isNotNull() & F.col("imported"), 5).when(m == F.col("caller_module"), 6).otherwise(UNPLACED)
    )
    return e.select("edge", F.col("from_symbol_id").alias("from_id"), "sym_id", tier.alias("tier"))


def has(df: DataFrame, keys: DataFrame, flag: str, **on: Column) -> DataFrame:
    """``df`` with ``flag`` where ``on`` is among ``keys``, whose columns bear the same names."""
    keys = small(commits.kept(keys.distinct(), "evidence"), MOST_EVIDENCE)
    names = {f"_{c}": k for c, k in on.items()}
    held = keys.toDF(*[f"_{c}" for c in keys.columns]).withColumn(flag, F.lit(True))
    return df.withColumns(names).join(held, list(names), "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop(*names)


def nearest_tiers(relationships: DataFrame, symbols: DataFrame, forms: DataFrame, proof: DataFrame) -> DataFrame:
    """Calls ``(edge, from_id, to_name, file_id, q, r, caller_module, nearest)``: each with the best tier that any callable of its name has.

    Nothing meets a candidate: a tier is there if the call's key is among the distinct keys of owners, modules or files of
    the callables of its name. Null: no callable has the name, or the caller is no symbol. ``forms``: ``asked``.
    """
    targets = _targets(symbols)

    name, file = F.col("to_name"), F.col("file_id")
    e = _calls(relationships, symbols, "left").withColumnsRenamed({"to_qualifier": "q", "to_receiver_type": "r", "from_symbol_id": "from_id"})
    e = has(e, targets.select("to_name"), "named", to_name=name)
    by_q, by_r, plain = F.col("q").isNotNull(), F.col("q").isNull() & F.col("r").isNotNull(), F.col("q").isNull() & F.col("r").isNull()
    owners, modules = targets.where("owner is not null"), targets.where("module is not null")
    only = lambda when, key: F.when(when, key)  # noqa: E731  a null key meets nothing
    owned = forms.select("to_name", "q").distinct().withColumn("owner", F.explode(_tails(F.col("q"), OWNER_SEPS))).join(owners.select("to_name", "owner").distinct(), ["to_name", "owner"])
    e = has(e, owned.select("to_name", "q"), "as_owner", to_name=only(by_q, name), q=F.col("q"))
    e = has(e, modules.select("to_name", "module"), "as_module", to_name=only(by_q, name), module=F.col("q"))
    e = has(e, proof.select("file_id", "to_name", F.explode(_tails(F.col("module"), MODULE_SEPS)).alias("tail")), "as_imported", file_id=file, to_name=only(by_q, name), tail=F.col("q"))
    typed = owners.select("to_name", "target_file", F.explode(_tails(F.col("owner"), OWNER_SEPS)).alias("tail"))
    e = has(e, typed, "typed_here", to_name=only(by_r, name), target_file=file, tail=F.col("r"))
    e = has(e, typed.drop("target_file"), "typed", to_name=only(by_r, name), tail=F.col("r"))
    e = has(e, targets.select("to_name", "target_file"), "here", to_name=only(plain, name), target_file=file)
    e = has(e, proof.select("file_id", "to_name"), "imported", file_id=file, to_name=only(plain, name))
    e = has(e, modules.select("to_name", "module"), "beside", to_name=only(plain, name), module=F.col("caller_module"))
    tier = (
        F.when(F.col("has_caller").isNull() | ~F.col("named"), F.lit(None).cast("int"))
        .when(by_q, F.when(F.col("as_owner"), 1).when(F.col("as_module") | F.col("as_imported"), 2).otherwise(EXTERNAL))
        .when(by_r, F.when(F.col("typed_here"), 1).when(F.col("typed"), 2).otherwise(EXTERNAL))
        .when(F.col("to_receiver_call").isNotNull() & F.col("known").isNull(), EXTERNAL)
        .when(F.col("here"), 4).when(F.col("imported"), 5).when(F.col("beside"), 6).otherwise(UNPLACED)
    )
    return e.select("edge", "from_id", "to_name", "file_id", "q", "r", "caller_module", tier.alias("nearest"))


def placed_calls(nearest: DataFrame) -> DataFrame:
    """Distinct calls of ``nearest_tiers`` that aren't external, ``lone`` where a caller has one call to the name: such a call meets each callable once."""
    keys = ["from_id", "to_name", "file_id", "q", "r", "caller_module", "nearest"]
    one = nearest.where((F.col("nearest") != EXTERNAL)).select(*keys).distinct()
    return one.withColumn("lone", F.count("*").over(W.partitionBy("from_id", "to_name")) == 1)


def _reached(calls: DataFrame, targets: DataFrame, proof: DataFrame) -> DataFrame:
    """``(sym_id, from_id, tier)``: the callables of ``targets`` that stand at each call's nearest tier, by equi-joins on that tier's key."""
    at = lambda tier, *when: calls.where(F.col("nearest") == tier).where(*(when or (F.lit(True),)))
    qualified, typed = F.col("q").isNotNull(), F.col("q").isNull() & F.col("r").isNotNull()
    tailed = targets.where("owner is not null").withColumn("r", F.explode(_tails(F.col("owner"), OWNER_SEPS)))
    here = targets.withColumnRenamed("target_file", "file_id")
    as_module = at(2, qualified).select("from_id", "to_name", "nearest", "file_id", F.col("q").alias("module"))
    tails = proof.withColumn("q", F.explode(_tails(F.col("module"), MODULE_SEPS))).where("q <> module")
    as_imported = at(2, qualified).join(tails, ["file_id", "to_name", "q"]).select("from_id", "to_name", "nearest", "file_id", "module")
    met = [
        at(1, qualified).withColumn("owner", F.explode(_tails(F.col("q"), OWNER_SEPS))).join(targets, ["to_name", "owner"]),
        as_module.unionByName(as_imported).join(targets, ["to_name", "module"]),
        at(1, typed).join(tailed.withColumnRenamed("target_file", "file_id"), ["to_name", "r", "file_id"]),
        at(2, typed).join(tailed, ["to_name", "r"]),
        at(4).join(here, ["to_name", "file_id"]),
        at(5).join(proof, ["file_id", "to_name"]).join(targets, ["to_name", "module"]),
        at(6).withColumn("module", F.col("caller_module")).join(targets, ["to_name", "module"]),
        at(UNPLACED).join(targets, "to_name"),
    ]
    return reduce(DataFrame.unionByName, [x.select("sym_id", "from_id", F.col("nearest").alias("tier")) for x in met])


def callers(calls: DataFrame, symbols: DataFrame, proof: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``(sym_id, from_id, tier)``: who calls what, by the nearest tier; external calls are left out. ``among(sym_id)``: only these callees.

    ``calls`` are ``placed_calls``. Only where a caller has several calls to a name are pairs gathered to take the best tier.
    """
    targets = _targets(symbols).distinct()
    targets = targets if among is None else targets.join(among, "sym_id", "left_semi")
    several = _reached(calls.where("not lone"), targets, proof).groupBy("sym_id", "from_id").agg(F.min("tier").alias("tier"))
    return _reached(calls.where("lone"), targets, proof).unionByName(several)


def impact(callers_of: Callable[[DataFrame], DataFrame], spark, start: int, depth: int) -> DataFrame:
    """``(id, tier)``: all that may call ``start``, directly or over ``depth`` further hops; unplaced arrivals are reported but not followed.

    ``callers_of`` gives ``(sym_id, from_id, tier)`` for the callees of a frontier ``(sym_id)``. A hop is one stored table.
    """
    frontier = spark.range(1).select(F.lit(start).cast("long").alias("sym_id"))
    seen, queued = None, frontier
    for _ in range(depth + 1):
        if frontier.isEmpty():
            break
        hop = commits.kept(callers_of(small(frontier)).groupBy(F.col("from_id").alias("id")).agg(F.min("tier").alias("tier")), "hop")
        seen = hop if seen is None else seen.unionByName(hop)
        frontier = commits.kept(hop.where(F.col("tier") != UNPLACED).select(F.col("id").alias("sym_id")).join(queued, "sym_id", "left_anti"), "frontier")
        queued = queued.union(frontier)
    return seen.groupBy("id").agg(F.min("tier").alias("tier"))


def receiver_types(functions: DataFrame) -> DataFrame:
    """``(name, type)``: the return type of each function name, where all its definitions agree on one."""
    g = functions.groupBy("name").agg(F.min("type").alias("type"), F.max("type").alias("other"), F.count_if(F.col("type").isNull()).alias("untyped"))
    return g.where((F.col("type") == F.col("other")) & (F.col("untyped") == 0)).select("name", "type")
