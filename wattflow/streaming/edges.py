"""Edges of power series while the readings arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDGES = "building int, channel string, edge_no long, transition double, duration int, start long, end long"


class OnlineDetector:
    """One series' detector with a state of fixed size: it counts the samples of an edge and does not keep them."""

    def __init__(self, noise_level: float = 50.0, state_threshold: float = 15.0, min_n_samples: int = 2, state: dict | None = None):
        self.noise, self.change, self.q = noise_level, state_threshold, min_n_samples
        self.s = state or {"n": 0, "m": 0.0, "t": 0, "calm": 0, "sum": 0.0, "len": 0, "level": 0.0, "count": 0, "start": None, "changed": None, "c": False, "edges": 0}

    def update(self, t: int, m: float) -> dict | None:
        """The edge that this reading completes, if any. Readings come in order."""
        s = self.s
        if s["n"] == 0:
            s.update(n=1, m=m, t=t, level=m)
            return None
        away, edge = abs(m - s["level"]) > self.noise, None
        s["count"] += int(away) + int(s["c"])
        if away and s["start"] is None:
            s["start"] = s["t"]
        if s["calm"] >= self.q:
            mean = s["sum"] / s["len"]
            if abs(mean - s["level"]) > self.noise:
                start = s["start"] if s["start"] is not None else s["changed"]
                edge = {"edge_no": s["edges"], "transition": mean - s["level"], "duration": s["count"], "start": start, "end": s["changed"]}
                s.update(count=0, start=None, edges=s["edges"] + 1)
            s["level"] = mean
        changed = abs(m - s["m"]) > self.change
        if changed:
            s.update(sum=m, len=1, calm=0, changed=t)
        else:
            s.update(sum=s["sum"] + m, len=s["len"] + 1, calm=s["calm"] + 1)
        s.update(n=s["n"] + 1, m=m, t=t, c=changed)
        return edge


def stream_transitions(readings: DataFrame, noise_level: float = 50.0, state_threshold: float = 15.0, min_n_samples: int = 2, delay: str | None = None) -> DataFrame:
    """The edges of a stream of readings (building, channel, t, seq, watts, and ts if there is a delay).

    Without a delay, batches are taken to arrive in order, and each is put in order of (t, seq) by itself. With one,
    readings wait in the state until the watermark over ts has passed them, so that readings late by less than delay
    are put in their place; later ones are dropped by the watermark. Readings that are null are left out.
    """
    waits = delay is not None

    def detect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"detector": None, "waiting": []}
        rows = kept["waiting"]
        for pdf in batches:
            times = (pdf["ts"].astype("int64") // 1_000_000 if str(pdf["ts"].dtype).startswith("datetime64[ns") else pdf["ts"].astype("int64") // 1000).tolist() if waits else [0] * len(pdf)
            rows += [list(r) for r in zip(times, pdf["t"].tolist(), pdf["seq"].tolist(), pdf["watts"].tolist(), strict=True)]
        mark = state.getCurrentWatermarkMs() if waits else 0
        rows.sort(key=lambda r: (r[1], r[2]))
        ready = [r for r in rows if not waits or r[0] <= mark]
        kept["waiting"] = [r for r in rows if waits and r[0] > mark]
        detector = OnlineDetector(noise_level, state_threshold, min_n_samples, kept["detector"])
        found = [e for r in ready if (e := detector.update(r[1], r[3])) is not None]
        kept["detector"] = detector.s
        state.update((json.dumps(kept),))
        if waits and kept["waiting"]:
            state.setTimeoutTimestamp(max(mark + 1, min(r[0] for r in kept["waiting"]) + 1))
        if not found:
            return
        out = pd.DataFrame(found, columns=["edge_no", "transition", "duration", "start", "end"])
        out.insert(0, "channel", key[1])
        out.insert(0, "building", key[0])
        yield out.astype({"start": "Int64", "end": "Int64"})

    rows = readings.where("watts is not null")
    if waits:
        rows = rows.withWatermark("ts", delay)
    timeout = GroupStateTimeout.EventTimeTimeout if waits else GroupStateTimeout.NoTimeout
    columns = ["building", "channel", "t", "seq", "watts", *(["ts"] if waits else [])]
    return rows.select(*columns).groupBy("building", "channel").applyInPandasWithState(detect, EDGES, "kept string", "append", timeout)


def stream_resampled(readings: DataFrame, seconds: int = 6, delay: str = "1 minute") -> DataFrame:
    """Means of a stream of readings (building, channel, ts, watts) over a grid of seconds; cells without readings are left to the batch side."""
    cell = F.window("ts", f"{seconds} seconds")
    means = readings.withWatermark("ts", delay).groupBy("building", "channel", cell.alias("cell")).agg(F.avg("watts").alias("watts"))
    return means.select("building", "channel", F.col("cell.start").alias("ts"), "watts")
