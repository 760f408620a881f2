"""Watching a source: bounded updates that fall back to a rescan, flush timers, and settlement of injections by errors."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..storage import commits
from ..storage.snapshots import Snapshots
from .streams import collapsed_changes

# Paths that are kept one by one, and seconds between full passes.
MOST_PENDING, RECOVERY_SECONDS = 1024, 30
#: Waiting rows in one element of state.
PACK = 4_096


class BoundedUpdates:
    """A ``foreachBatch`` sink that keeps ``store`` equal to a source by looking only at the paths that changed.

    A batch of more than ``most`` changed paths isn't followed: its paths are dropped behind a stored mark, and the
    whole source is compared with the store instead, by anti-joins both ways. The mark is stored before the paths
    go and cleared after the store has the result, so a writer that dies between the two rescans when it comes
    back. ``current()`` gives the source as it is now: the store's columns but its order, one row a path.
    The store's key is the path and its order column grows with the batches.
    """

    def __init__(self, store: Snapshots, current: Callable[[], DataFrame], most: int = MOST_PENDING, writer: str = "watch") -> None:
        self.store, self.current, self.most, self.writer = store, current, most, writer
        self.rescans = 0

    @property
    def _marks(self) -> str:
        return f"{self.store.root}/missed"

    def missed(self) -> bool:
        return commits.latest(self.store.spark, self._marks)[1].get("missed", False)

    def _mark(self, missed: bool) -> None:
        if missed != self.missed():
            commits.publish(self.store.spark, self._marks, commits.latest(self.store.spark, self._marks)[0] + 1, {"missed": missed})

    def __call__(self, batch: DataFrame, number: int) -> None:
        """``batch(path, kind, at_s)``; changes of one path collapse first, access is none."""
        paths = commits.kept(collapsed_changes(batch).select("path"), "changed")
        n = paths.limit(self.most + 1).count()
        if n > self.most:
            self._mark(True)
        if self.missed():
            self.rescans += 1
            self._reconcile(self.current(), self.store.read(), number)
            self._mark(False)
        elif n:
            few = F.broadcast(paths)  # most + 1 rows at most
            self._reconcile(self.current().join(few, "path", "left_semi"), self.store.read().join(few, "path", "left_semi"), number)

    def _reconcile(self, now: DataFrame, was: DataFrame, number: int) -> None:
        """Merges what ``now`` has and ``was`` doesn't, and marks as deleted what only ``was`` has."""
        order, names = self.store.order, [f.name for f in self.store.schema.fields]
        content = [c for c in names if c != order]
        at = F.lit(number + 1).cast("long").alias(order)
        state = F.sha2(F.to_json(F.struct(*content)), 256).alias("state")
        fresh = now.select(*content, state).join(was.select("path", state), ["path", "state"], "left_anti").select(*content, at, F.lit(False).alias("gone"))
        gone = was.select(*content).join(now.select("path"), "path", "left_anti").select(*content, at, F.lit(True).alias("gone"))
        self.store.merge(fresh.unionByName(gone), writer=self.writer, batch=number, deleted="gone")


class FlushTimers(StatefulProcessor):
    """Turns changes of a key into flushes: when it was idle, when a full pass may run again, when failed paths are due.

    Input ``(key, path, kind, at)``, kind changed, reconcile or failed; output ``FLUSH``. Changed paths are flushed once
    no change came for ``idle`` seconds; more than ``most`` of them, or a reconcile, ask for a full pass instead,
    which waits for the same quiet and for ``recovery`` seconds since the last full pass; failed paths are flushed
    again ``retry`` seconds after the last failure. A full pass takes all waiting paths with it. Rows wait in state until the
    watermark has passed them and are then taken in order of time, so flushes depend on the rows' times alone,
    whichever micro-batch brought them; rows behind the watermark are late and left out.
    """

    FLUSH = "key string, at timestamp, what string, n long, paths array<string>"

    def __init__(self, idle: float, retry: float, recovery: float = RECOVERY_SECONDS, most: int = MOST_PENDING) -> None:
        self.idle, self.retry, self.recovery = (int(seconds * 1e6) for seconds in (idle, retry, recovery))
        self.most = most

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.pending = handle.getListState("pending", "kind string, path string")
        self.times = handle.getValueState("times", "last long, full boolean, done long, failed long, first long, timer long, held boolean")

    def _deadline(self, last: int, full: bool, done: int, failed: int, changed: dict, broken: dict) -> tuple[int, str] | None:
        due = []
        if full:
            due.append((max(last + self.idle, done + self.recovery), "full"))
        elif changed:
            due.append((last + self.idle, "changed"))
        if broken:
            due.append((failed + self.retry, "failed"))
        return min(due, default=None)

    def _advance(self, key: str, until: int, came: list[tuple], expired: bool) -> Iterator[pd.DataFrame]:
        """Adds ``came`` to the waiting rows and takes those and the deadlines up to ``until`` (microseconds) in order of time.

        Each use of state is a round trip for a key, and each element of a list is coded by itself: rows wait in texts of
        ``PACK``, nothing is read that isn't due, and nothing is written that is as it was.
        """
        last, full, done, failed, first, timer, held = self.times.get() or (0, False, -(1 << 60), 0, None, None, False)
        timer = None if expired else timer  # an expired one is gone by itself
        first = min([r[0] for r in came] + ([] if first is None else [first]), default=None)
        kept: dict[str, dict] = {"changed": {}, "failed": {}}
        if held:
            for kind, path in self.pending.get():
                kept[kind][path] = None
        changed, broken, out = kept["changed"], kept["failed"], []
        was = [*changed], [*broken]

        def flush(limit: int) -> None:
            nonlocal full, done
            while (due := self._deadline(last, full, done, failed, changed, broken)) and due[0] <= limit:
                at, what = due
                paths = sorted({**changed, **broken} if what == "full" else changed if what == "changed" else broken, key=lambda p: p or "")
                out.append((key, at, what, len(paths), [] if what == "full" else paths))
                if what == "full":
                    full, done = False, at
                    changed.clear()
                    broken.clear()
                else:
                    (changed if what == "changed" else broken).clear()

        if first is not None and first <= until:
            rows = sorted([*(tuple(r) for (text,) in self.waiting.get() for r in json.loads(text)), *came], key=lambda r: (r[0], r[2] or "", r[1] or ""))
            ready = bisect_right(rows, until, key=lambda r: r[0])
            for at, kind, path in rows[:ready]:
                flush(at)
                if kind == "failed":
                    broken[path], failed = None, at
                    continue
                last = at
                if kind == "reconcile":
                    full = True
                elif not full:
                    changed[path] = None
                    if len(changed) > self.most:
                        full = True
                        changed.clear()
            rest = rows[ready:]
            self.waiting.put(self._packed(rest)) if rest else self.waiting.clear()
            first = rest[0][0] if rest else None
        elif came:
            self.waiting.appendList(self._packed(came))
        flush(until)
        if was != ([*changed], [*broken]):
            held = bool(changed or broken)
            self.pending.put([(k, p) for k, ps in kept.items() for p in ps]) if held else self.pending.clear()
        due = self._deadline(last, full, done, failed, changed, broken)
        after = min([*([] if first is None else [first]), *([due[0]] if due else [])], default=None)
        next_ = None if after is None else -(-after // 1000)
        if next_ != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if next_ is not None:
                self.handle.registerTimer(next_)
        self.times.update((last, full, done, failed, first, next_, held))
        if out:
            df = pd.DataFrame(out, columns=["key", "at", "what", "n", "paths"])
            df["at"] = pd.to_datetime(df["at"], unit="us")
            yield df

    @staticmethod
    def _packed(rows: list[tuple]) -> list[tuple[str]]:
        return [(json.dumps(rows[k : k + PACK]),) for k in range(0, len(rows), PACK)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: list[tuple] = []
        for pdf in rows:
            at = pdf["at"].astype("datetime64[us]").astype("int64")
            came += zip(at.tolist(), pdf["kind"].tolist(), pdf["path"].tolist())
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs() * 1000, came, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs() * 1000, [], True)

    def close(self) -> None:
        pass


def flushes(changes: DataFrame, timers: FlushTimers, late: str = "1 hour") -> DataFrame:
    """The flushes of a stream ``changes(key, path, kind, at)``; needs the RocksDB state store (``with_timers``)."""
    marked = changes.withWatermark("at", late)
    return marked.groupBy("key").transformWithStateInPandas(timers, FlushTimers.FLUSH, outputMode="Append", timeMode="EventTime")


def with_timers(spark) -> None:
    """Sets the state store that arbitrary state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def settled(injections: DataFrame, errors: DataFrame, same: Column, horizon: str, late: str = "10 minutes") -> DataFrame:
    """``(id, refuted)``: each injection with each error that refutes it, or once with false when its horizon has passed without one.

    ``injections(id, session, injected_at, signature)``, ``errors(error_session, seen_at, at, error_signature)``; both streams or
    both tables. An error counts for the injections of its session up to ``horizon`` before it was seen, if it came at or
    after them; an error without a time of its own (null ``at``) counts whenever it was seen within the horizon. ``same``: the
    condition on signatures. A stream holds an injection until the watermark is past its horizon.
    """
    streaming = injections.isStreaming
    i = injections.withWatermark("injected_at", late) if streaming else injections
    e = errors.withWatermark("seen_at", late) if streaming else errors
    on = (F.col("session") == F.col("error_session")) & F.expr(f"seen_at >= injected_at AND seen_at <= injected_at + interval {horizon}") & (F.col("at").isNull() | (F.col("at") >= F.col("injected_at"))) & same
    return i.join(e, on, "left").select("id", F.col("error_session").isNotNull().alias("refuted"))
