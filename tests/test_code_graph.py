"""Calls resolved without meeting every candidate, against all pairs of call and callable."""

from __future__ import annotations

import random

import pytest

from loregrid.operators import code

CALLS = "id long, from_symbol_id long, file_id long, kind string, to_name string, to_qualifier string, to_receiver_type string, to_receiver_call string"
SYMBOLS = "id long, name string, kind string, file_id long, owner_name string, module_path string"


def ends(a, b, seps):
    return a is not None and b is not None and (a == b or any(a.endswith(s + b) for s in seps))


def tier(r, s, caller, imports, names):
    _, _, file, _, name, q, rtype, rcall = r
    owner, module = s[4], s[5]
    imported = module is not None and any((file, p) in imports for p in (module, f"{module}::{name}", f"{module}.{name}"))
    if q is not None:
        return 1 if ends(q, owner, ("::", ".", "\\")) else 2 if module is not None and (module == q or ends(module, q, ("::", ".")) and imported) else 3
    if rtype is not None:
        return (1 if s[3] == file else 2) if ends(owner, rtype, ("::", ".", "\\")) else 3
    if rcall is not None and rcall not in names:
        return 3
    return 4 if s[3] == file else 5 if imported else 6 if module is not None and module == caller else 7


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    pick = rng.choice
    owners, modules = [None, "app::A", "A", "lib.B", "x\\B", "C"], [None, "app::m", "m", "lib.n"]
    symbols = [(i, f"f{i % 7}" if i % 3 else "hot", pick(["function", "method", "struct"]), rng.randrange(5), pick(owners), pick(modules)) for i in range(90)]
    calls = [(i, rng.randrange(95), rng.randrange(6), "Calls", pick(["hot", "f1", "f2", "f3", "none"]), pick([None, None, "A", "y::app::A", "m", "n", "app::m", "z\\B"]), pick([None, None, "A", "B"]), pick([None, None, "f1", "gone"])) for i in range(400)]
    imports = {(rng.randrange(6), pick(["app::m", "m::hot", "lib.n.f1", "lib.n"])) for _ in range(12)}
    r, s = spark.createDataFrame(calls, CALLS), spark.createDataFrame(symbols, SYMBOLS)
    i = spark.createDataFrame(sorted(imports), "file_id long, path string")
    module, names = {x[0]: x[5] for x in symbols}, {x[1] for x in symbols}
    pairs = [(c[0], c[1], x[0], tier(c, x, module[c[1]], imports, names)) for c in calls if c[1] in module for x in symbols if x[1] == c[4] and x[2] != "struct"]
    return r, s, i, pairs


def best(pairs):
    out = {}
    for e, _, _, k in pairs:
        out[e] = min(k, out.get(e, 9))
    return out


def expected_callers(pairs):
    near, out = best(pairs), {}
    for e, a, b, k in pairs:
        if k == near[e] != code.EXTERNAL:
            out[b, a] = min(k, out.get((b, a), 9))
    return out


def test_tiers_and_callers_equal_all_pairs(spark, graph):
    r, s, i, pairs = graph
    forms = code.asked(r)
    proof = code.imported_modules(forms, s, i)
    assert {k for *_, k in pairs} == set(range(1, 8))
    assert sorted(map(tuple, code.resolved_edges(r, s, proof).collect())) == sorted(pairs)
    near = code.nearest_tiers(r, s, forms, proof)
    assert near.count() == r.count()  # a row for each call, however many callables share its name
    assert {x.edge: x.nearest for x in near.collect() if x.nearest is not None} == best(pairs)
    placed = code.placed_calls(near)
    got = code.callers(placed, s, proof).collect()
    want = expected_callers(pairs)
    assert len(got) == len(want) and {(x.sym_id, x.from_id): x.tier for x in got} == want
    some = code.callers(placed, s, proof, spark.createDataFrame([(1,), (2,), (4,)], "sym_id long")).collect()
    assert {(x.sym_id, x.from_id): x.tier for x in some} == {k: v for k, v in want.items() if k[0] in (1, 2, 4)}


def test_impact_equals_a_walk(spark, graph):
    r, s, i, pairs = graph
    proof = code.imported_modules(code.asked(r), s, i)
    placed = code.placed_calls(code.nearest_tiers(r, s, code.asked(r), proof))
    calls, start = expected_callers(pairs), next(b for _, _, b, k in pairs if k == 4)
    seen, front, queued = {}, {start}, {start}
    for _ in range(3):
        hop = {}
        for (b, a), k in calls.items():
            if b in front:
                hop[a] = min(k, hop.get(a, 9))
        for a, k in hop.items():
            seen[a] = min(k, seen.get(a, 9))
        front = {a for a, k in hop.items() if k != code.UNPLACED} - queued
        queued |= front
    got = code.impact(lambda among: code.callers(placed, s, proof, among), spark, start, 2).collect()
    assert {x.id: x.tier for x in got} == seen


def test_no_call_meets_candidates_before_its_tier_is_known(spark, graph):
    """A name with n callables and m calls costs n + m rows until pairs at the nearest tier are made: n * m were stored before."""
    n = 300
    s = spark.createDataFrame([(k, "hot", "function", k, None, None) for k in range(n)], SYMBOLS)
    r = spark.createDataFrame([(k, k % n, k % n, "Calls", "hot", None, None, None) for k in range(2 * n)], CALLS)
    forms, none = code.asked(r), spark.createDataFrame([], "file_id long, to_name string, module string")
    placed = code.placed_calls(code.nearest_tiers(r, s, forms, none))
    assert placed.count() == n and {x.nearest for x in placed.collect()} == {4}
    assert code.callers(placed, s, none).count() == n


def test_nearest_edges_are_found_without_a_sort_of_all_pairs(spark):
    from loregrid.plans import registry

    plan = registry.QUERIES["WIN01"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_receivers_of_names_need_no_unparser(monkeypatch):
    import ast

    from loregrid.sources import code

    source = "import os\nos.path.join(g(x))\nself.n()\na.b.c.d(1)\n(a + b).m()\nf(1).g.h()\n'x'.join([])\nx[0].y.z()\n"
    want = [ast.unparse(x.func.value) for x in ast.walk(ast.parse(source)) if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute)]
    calls, plain = [], ast.unparse
    monkeypatch.setattr(code.ast, "unparse", lambda n: calls.append(n) or plain(n))
    got = [r[6] for r in code.parse_python(source) if r[0] == "call" and r[6]]
    assert sorted(got) == sorted(want) and len(calls) == 4  # only what isn't a dotted name


def test_sources_of_one_partition_are_parsed_by_many_tasks(spark):
    from loregrid.sources.code import parse_sources

    files = spark.range(64).selectExpr("concat('f', id, '.py') AS path", "concat('def f', id, '(): pass') AS source").coalesce(1)
    got = parse_sources(files).selectExpr("name", "spark_partition_id() AS p").collect()
    assert sorted(r.name for r in got) == sorted(f"f{k}" for k in range(64)) and len({r.p for r in got}) > 1


def test_resolved_edges_are_written_in_little_space(spark, tmp_path):
    """COD06 wrote its pairs in the order of the calls, about ten times the space that blocks of callables take (F1)."""
    from pyspark.sql import functions as F

    from loregrid.plans import registry

    part = spark.range(12_000).select((F.col("id") * 1_555).alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")], F.lit(1).alias("p_size"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    k = F.col("id")
    lines = spark.range(400).select((k * 7_919).alias("l_orderkey"), (k * 1_555).alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.lit(0).alias("l_linenumber"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    registry.QUERIES["COD06"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    rows, size = got.count(), sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert rows == 400 * 9_000 == got.select("edge", "sym_id").distinct().count()
    assert size < rows * 0.8 and got.select(F.input_file_name()).distinct().count() > 1
