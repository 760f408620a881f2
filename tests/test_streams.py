"""Streams whose result must not depend on how their rows arrive: bounded updates, flush timers, settlement."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loregrid.storage.snapshots import Snapshots
from loregrid.streaming import streams, watch

CHANGES = "path string, kind string, at_s long"


def written(spark, folder, batches, schema):
    """Each list of rows as one file of a stream's folder, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return streams.events_stream(spark, folder, spark.createDataFrame([], schema).schema, 1)


def test_a_stream_that_overruns_its_bound_ends_with_the_same_rows(spark, tmp_path):
    rng, disk, batches = random.Random(7), {}, []
    for n in (3, 40, 2, 5):  # the second batch overruns
        rows = []
        for at in range(n):
            path = f"f{rng.randrange(60)}"
            kind = rng.choice(["modified", "created", "removed"])
            disk.pop(path, None) if kind == "removed" else disk.update({path: f"{path} at {at} of {n}"})
            rows.append((path, kind, at))
        batches.append(rows)
    disk["silent"] = "written while events were dropped, without an event of its own"
    current = lambda: spark.createDataFrame([*disk.items()], "path string, body string")
    ends = {}
    for most in (10, 1_000):
        store = Snapshots(spark, f"file://{tmp_path}/store{most}", "path string, body string, seq long", ["path"], "seq", 4)
        sink = watch.BoundedUpdates(store, current, most)
        streams.run(written(spark, str(tmp_path / f"in{most}"), batches, CHANGES), sink, str(tmp_path / f"cp{most}"))
        ends[most] = {r.path: r.body for r in store.read().collect()}
        assert sink.rescans == (most == 10) and not sink.missed()
    assert ends[10] == disk and ends[1_000] == {p: b for p, b in disk.items() if p != "silent"}


def test_a_mark_outlives_the_writer(spark, tmp_path, monkeypatch):
    """A writer that dies while it rescans finds its mark again; a replayed batch changes nothing."""
    store = Snapshots(spark, f"file://{tmp_path}/store", "path string, body string, seq long", ["path"], "seq", 4)
    disk = {f"f{k}": "x" for k in range(9)}
    sink = watch.BoundedUpdates(store, lambda: spark.createDataFrame([*disk.items()], "path string, body string"), 3)
    batch = spark.createDataFrame([(p, "created", 1) for p in disk], CHANGES)
    with monkeypatch.context() as m:
        m.setattr(store, "merge", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sink(batch, 0)
    assert sink.missed() and store.read().count() == 0
    again = watch.BoundedUpdates(store, sink.current, 3)
    again(batch.limit(1), 0)  # far below the bound, but the mark stands
    assert not again.missed() and store.read().count() == 9
    version = store.version()
    again(batch.limit(1), 0)
    assert store.version() == version
    del disk["f1"]
    again(spark.createDataFrame([("f1", "removed", 2), ("f2", "accessed", 2), (None, "modified", 3)], CHANGES), 1)
    assert store.read().count() == 8


def plain_flushes(rows, idle, retry, recovery, most, until):
    """The sequential rule over rows in order of time, up to the last watermark."""
    out = []
    for key in sorted({r[0] for r in rows}):
        last, full, done, failed, changed, broken = 0, False, -(1 << 60), 0, set(), set()

        def due():
            found = [(max(last + idle, done + recovery), "full")] if full else [(last + idle, "changed")] if changed else []
            return min(found + ([(failed + retry, "failed")] if broken else []), default=None)

        def flush(limit):
            nonlocal full, done
            while (d := due()) and d[0] <= limit:
                if d[1] == "full":
                    out.append((key, d[0], "full", len(changed | broken)))
                    full, done = False, d[0]
                    changed.clear(), broken.clear()
                else:
                    which = changed if d[1] == "changed" else broken
                    out.append((key, d[0], d[1], len(which)))
                    which.clear()

        for _, path, kind, at in sorted((r for r in rows if r[0] == key and r[3] <= until), key=lambda r: (r[3], r[1], r[2])):
            flush(at)
            if kind == "failed":
                broken.add(path)
                failed = at
                continue
            last = at
            if kind == "reconcile":
                full = True
            elif not full:
                changed.add(path)
                if len(changed) > most:
                    full = True
                    changed.clear()
        flush(until)
    return sorted(out)


def test_flush_timers_with_late_and_idle_keys(spark, tmp_path):
    """Rows shuffled within the lateness give the flushes of the sequential rule; a key that stays silent is flushed by its timer."""
    watch.with_timers(spark)
    rng, rows, t = random.Random(11), [], {"a": 0, "b": 0, "c": 0}
    for _ in range(150):
        key = rng.choice("abc")
        t[key] += rng.choice([1, 1, 2, 5, 12, 40])
        rows.append((key, f"p{rng.randrange(12)}", rng.choices(["changed", "failed", "reconcile"], [8, 2, 1])[0], t[key]))
    rows.append(("idle", "once", "changed", 3))
    late = 30
    rows.sort(key=lambda r: r[3] + rng.random() * (late - 1))  # no row is behind the watermark of those before it
    schema = "key string, path string, kind string, at_s long"
    stream = written(spark, str(tmp_path / "in"), [rows[k : k + 38] for k in range(0, len(rows), 38)], schema).select("key", "path", "kind", F.timestamp_seconds("at_s").alias("at"))
    timers = watch.FlushTimers(idle=10, retry=25, recovery=60, most=4)
    got = sorted((r.key, r.at_s, r.what, r.n) for r in streams.run_once(watch.flushes(stream, timers, f"{late} seconds"), "flushes", "append").select("key", F.unix_timestamp("at").alias("at_s"), "what", "n").collect())
    until = max(r[3] for r in rows) - late
    want = plain_flushes(rows, 10, 25, 60, 4, until)
    assert got == want and {w for *_, w, _ in want} == {"changed", "failed", "full"} and ("idle", 13, "changed", 1) in got


def test_flush_timers_use_state_only_for_what_is_due():
    """Every use of state is a round trip for each key: rows that wait were read and written again in each batch, timers listed."""
    from types import SimpleNamespace

    used = []

    class Held:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def get(self):
            used.append(f"{self.name} get")
            return self.value if self.name == "times" else iter(self.value)

        def update(self, value):
            used.append(f"{self.name} update")
            self.value = value

        put = update

        def appendList(self, rows):
            used.append(f"{self.name} append")
            self.value = [*self.value, *rows]

        def clear(self):
            used.append(f"{self.name} clear")
            self.value = []

        def exists(self):
            used.append(f"{self.name} exists")
            return bool(self.value)

    timers, at = watch.FlushTimers(idle=10, retry=25), lambda s: pd.Timestamp(s, unit="s")
    set_ = []
    timers.init(SimpleNamespace(getListState=lambda name, _: Held(name, []), getValueState=lambda name, _: Held(name, None), listTimers=lambda: used.append("list") or iter(set_), registerTimer=set_.append, deleteTimer=set_.remove))
    mark = lambda s: SimpleNamespace(getCurrentWatermarkInMs=lambda: s * 1_000)
    batch = lambda *s: iter([pd.DataFrame({"at": [at(k) for k in s], "kind": "changed", "path": [None, *"abcdefgh"][: len(s)]})])
    assert not [*timers.handleInputRows(("k",), batch(100, 103, 140), mark(0))]
    assert used == ["times get", "waiting append", "times update"] and set_ == [100_000]
    used.clear()
    assert not [*timers.handleInputRows(("k",), batch(90), mark(50))] and set_ == [90_000]  # an earlier row, an earlier timer
    assert used == ["times get", "waiting append", "times update"]
    out = [*timers.handleExpiredTimer(("k",), mark(130), None)]
    set_.remove(90_000)  # as the engine does after the call
    assert [(r.at, r.what, r.n) for df in out for r in df.itertuples()] == [(at(100), "changed", 1), (at(113), "changed", 2)] and set_ == [140_000]
    out = [*timers.handleExpiredTimer(("k",), mark(145), None)]
    set_.remove(140_000)
    assert not out and set_ == [150_000]
    used.clear()
    out = [*timers.handleExpiredTimer(("k",), mark(200), None)]
    assert [(r.at, r.n) for df in out for r in df.itertuples()] == [(at(150), 1)] and used == ["times get", "pending get", "pending clear", "times update"]


def test_settlement_is_the_same_in_any_order(spark, tmp_path):
    """Two streams in two shuffled orders against the table's join, with errors that have no time of their own."""
    rng = random.Random(5)
    inj = [(k, f"s{rng.randrange(6)}", rng.randrange(0, 9_000), rng.choice(["disk full", "timeout", "parse"])) for k in range(60)]
    err = []
    for _ in range(90):
        seen = rng.randrange(0, 12_000)
        err.append((f"s{rng.randrange(6)}", seen, rng.choice([None, seen, max(0, seen - rng.randrange(900))]), rng.choice(["disk full", "timeout", "parse"])))
    inj.append((999, "quiet", 100, "timeout"))
    err.append(("end", 40_000, None, "x"))
    inj.append((1_000, "end", 40_000, "y"))  # carries both watermarks past every horizon but its own
    si, se = "id long, session string, i long, signature string", "error_session string, s long, a long, error_signature string"
    ready = lambda i, e: (i.select("id", "session", F.timestamp_seconds("i").alias("injected_at"), "signature"), e.select("error_session", F.timestamp_seconds("s").alias("seen_at"), F.timestamp_seconds("a").alias("at"), "error_signature"))
    same = F.col("signature") == F.col("error_signature")
    table = watch.settled(*ready(spark.createDataFrame(inj, si), spark.createDataFrame(err, se)), same, "1 hour")
    want = {r.id: r.refuted for r in table.groupBy("id").agg(F.max("refuted").alias("refuted")).collect() if r.id != 1_000}
    assert len(want) == 61 and set(want.values()) == {True, False} and want[999] is False
    plain = {i: any(s2 == s and g == g2 and t <= seen <= t + 3_600 and (a is None or a >= t) for s2, seen, a, g2 in err) for i, s, t, g in inj if i != 1_000}
    assert want == plain
    for order in range(2):
        rng.shuffle(inj), rng.shuffle(err)
        last = lambda rows, k: [r for r in rows if r[k] < 40_000], lambda rows, k: [r for r in rows if r[k] >= 40_000]
        parts = lambda rows, k: [*(last[0](rows, k)[n::3] for n in range(3)), last[1](rows, k)]
        i = written(spark, str(tmp_path / f"i{order}"), parts(inj, 2), si)
        e = written(spark, str(tmp_path / f"e{order}"), parts(err, 1), se)
        out = streams.run_once(watch.settled(*ready(i, e), same, "1 hour", "4 hours"), "settled", "append")
        assert {r.id: r.refuted for r in out.groupBy("id").agg(F.max("refuted").alias("refuted")).collect()} == want
