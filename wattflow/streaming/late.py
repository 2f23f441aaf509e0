"""Streams of readings that arrive out of order: keyed state that waits for the watermark, with late readings told apart.

State is kept by transformWithState: readings wait in a list, which grows by what arrives, and a timer at the earliest
of them wakes a series when the watermark has reached it. A reading at or before the watermark of its batch is late. The
watermark's column itself does not reach the stateful operator, so that Spark does not drop late readings unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .edges import OnlineDetector

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "kind string, building int, channel string, edge_no long, transition double, duration int, start long, end long, t long, seq long, watts double, late_no long"
CELLS = "kind string, building int, channel string, t long, watts double, late_no long"
DETECTOR = "n long, m double, t long, calm long, sum double, len long, level double, count long, start long, changed long, c boolean, edges long"
#: Rows of output that a series hands over at once.
LOT = 50_000


@contextmanager
def state_store(spark: SparkSession):
    """Queries that are started inside keep their state in a store that transformWithState can use."""
    old = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, old) if old is not None else spark.conf.unset(STORE)


class _Waiting(StatefulProcessor):
    """Keeps readings (ms, t, seq, watts) until the watermark has reached them and hands them on in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, t long, seq long, watts double")
        self.late = handle.getValueState("late", "n long")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def ready(self, key: tuple, rows: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def late_rows(self, key: tuple, rows: list[tuple], before: int) -> pd.DataFrame:
        raise NotImplementedError

    def wake(self, at: int, mark: int) -> None:
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(max(at, mark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, late, fresh = timerValues.getCurrentWatermarkInMs(), [], []
        for pdf in rows:
            for row in pdf[["ms", "t", "seq", "watts"]].itertuples(index=False, name=None):
                (late if row[0] <= mark else fresh).append((int(row[0]), int(row[1]), int(row[2]), float(row[3])))
        if fresh:
            self.waiting.appendList(fresh)
            self.wake(min(r[0] for r in fresh), mark)
        if late:
            before = self.late.get()[0] if self.late.exists() else 0
            self.late.update((before + len(late),))
            yield self.late_rows(key, sorted(late, key=lambda r: (r[1], r[2])), before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.wake(min(r[0] for r in rest), mark)
        yield from self.ready(key, sorted(due, key=lambda r: (r[1], r[2])), mark)

    def close(self) -> None:
        pass


class _Edges(_Waiting):
    def __init__(self, noise_level: float, state_threshold: float, min_n_samples: int):
        self.how = (noise_level, state_threshold, min_n_samples)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.names = [c.split()[0] for c in DETECTOR.split(", ")]
        self.detector = handle.getValueState("detector", DETECTOR)

    def ready(self, key, rows, mark):
        kept = dict(zip(self.names, self.detector.get(), strict=True)) if self.detector.exists() else None
        detector = OnlineDetector(*self.how, kept)
        found = [e for _, t, _, watts in rows if (e := detector.update(t, watts)) is not None]
        self.detector.update(tuple(detector.s[c] for c in self.names))
        if found:
            yield _shaped(found, FOUND, kind="edge", building=key[0], channel=key[1])

    def late_rows(self, key, rows, before):
        return _shaped([{"t": r[1], "seq": r[2], "watts": r[3], "late_no": before + i} for i, r in enumerate(rows)], FOUND, kind="late", building=key[0], channel=key[1])


class _Cells(_Waiting):
    """Means over a grid; a cell is final when the watermark has reached its last second, as readings are in whole seconds."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "cell long", "total double, n long")
        self.last = handle.getValueState("last", "cell long")

    def ready(self, key, rows, mark):
        totals: dict[int, list] = {}
        for _, t, _, watts in rows:
            own = totals.setdefault(t // self.seconds * self.seconds, [0.0, 0])
            own[0], own[1] = own[0] + watts, own[1] + 1
        for cell, (total, n) in totals.items():
            old = self.open.getValue((cell,)) if self.open.containsKey((cell,)) else (0.0, 0)
            self.open.updateValue((cell,), (old[0] + total, old[1] + n))
        end = lambda cell: (cell + self.seconds - 1) * 1000
        cells = sorted(k[0] for k in self.open.keys())
        for cell in [c for c in cells if end(c) > mark][:1]:
            self.wake(end(cell), mark)
        out, last = [], self.last.get()[0] if self.last.exists() else None
        for cell in (c for c in cells if end(c) <= mark):
            for empty in range(last + self.seconds if last is not None else cell, cell, self.seconds):
                out.append({"t": empty, "watts": 0.0})
                if len(out) >= LOT:
                    yield _shaped(out, CELLS, kind="cell", building=key[0], channel=key[1])
                    out = []
            total, n = self.open.getValue((cell,))
            self.open.removeKey((cell,))
            out.append({"t": cell, "watts": total / n})
            last = cell
        if last is not None:
            self.last.update((last,))
        if out:
            yield _shaped(out, CELLS, kind="cell", building=key[0], channel=key[1])

    def late_rows(self, key, rows, before):
        return _shaped([{"t": r[1], "watts": r[3], "late_no": before + i} for i, r in enumerate(rows)], CELLS, kind="late", building=key[0], channel=key[1])


def _shaped(rows: list[dict], schema: str, **same) -> pd.DataFrame:
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"int": "Int32", "long": "Int64", "double": "Float64", "string": "object"}
    return pd.DataFrame({name: pd.Series([{**r, **same}.get(name) for r in rows], dtype=kinds[kind]) for name, kind in fields})


def _stateful(readings: DataFrame, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    rows = readings.where("watts is not null").withWatermark("ts", delay)
    rows = rows.select("building", "channel", F.unix_millis("ts").alias("ms"), "t", "seq", "watts")
    return rows.groupBy("building", "channel").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def edges_with_late(readings: DataFrame, noise_level: float = 50.0, state_threshold: float = 15.0, min_n_samples: int = 2, delay: str = "1 minute") -> DataFrame:
    """The edges of a stream of readings (building, channel, ts, t, seq, watts) and, beside them, its late readings.

    Rows of kind edge have edge_no, transition, duration, start and end; rows of kind late have t, seq and watts of a
    reading that came when the watermark over ts, which follows the latest reading of all series by delay, had reached
    it, and late_no, which counts these in their series from 0. Edges are those of all other readings in order of
    (t, seq). Start the query inside ``state_store``.
    """
    return _stateful(readings, _Edges(noise_level, state_threshold, min_n_samples), FOUND, delay)


def resampled_with_late(readings: DataFrame, seconds: int = 6, delay: str = "1 minute") -> DataFrame:
    """Means over a grid of seconds as soon as a cell is final (kind cell: t, watts), with 0 in the empty cells between two that have readings; late readings as in edges_with_late.

    t is in whole seconds, and is that of ts; the watermark follows it, without ts's parts of a second. Start the query
    inside ``state_store``.
    """
    if seconds < 1:
        raise ValueError("the grid's step must be a second or more")
    return _stateful(readings.withColumn("ts", F.timestamp_seconds("t")), _Cells(seconds), CELLS, delay)


def late_counts(found: DataFrame) -> DataFrame:
    """building, channel, n_late of series that had any, from the collected rows of either stream."""
    return found.where("kind = 'late'").groupBy("building", "channel").agg(F.count("*").alias("n_late"))
