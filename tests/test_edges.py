"""Edge detection, batch and streaming, on worked examples and random series."""

import random

import pytest

from wattflow.operators import edges, prepare
from wattflow.streaming.edges import OnlineDetector, stream_transitions
from wattflow.streaming.late import edges_with_late, late_counts, resampled_with_late, state_store
from wattflow.streaming.run import drain, drain_in_turns

SERIES = "building int, channel string, t long, watts double"
STEP = [100.0] * 4 + [300.0] * 4 + [100.0] * 4
SPIKE = [100.0] * 4 + [300.0] + [100.0] * 5 + [250.0] * 5


def series(spark, *values):
    return spark.createDataFrame([(b, "main", t, w) for b, own in enumerate(values) for t, w in enumerate(own)], SERIES)


def found(df, building=0):
    return [(r.transition, r.duration, r.start, r.end) for r in df.where(f"building = {building}").orderBy("edge_no").collect()]


def test_steps_and_a_stale_start(spark):
    df = edges.transitions(series(spark, STEP, SPIKE, STEP[:-1]), 80, 15, with_sequence=True)
    assert found(df) == [(200, 5, 3, 4), (-200, 5, 7, 8)]
    assert found(df, 1) == [(150, 8, 3, 10)]
    assert found(df, 2) == [(200, 5, 3, 4)]
    first = df.where("building = 0 and edge_no = 0").first()
    assert first.sequence == [100, 300, 300, 300, 300]
    assert df.where("building = 1").first().sequence == [100, 300, 100, 100, 250, 250, 250, 250]


def test_no_edge(spark):
    df = edges.transitions(series(spark, [5.0] * 10, [1.0], [1.0, 500.0], [0.0] * 5 + [60.0] * 6, [10.0 * i for i in range(5)]), 80, 15)
    assert df.count() == 0


def test_steady_states(spark):
    states = edges.steady_states(series(spark, STEP), 80, 15).orderBy("t").collect()
    assert [(r.t, r.active_average) for r in states] == [(4, 300), (8, 100)]


def test_nulls_and_empty(spark):
    gaps = [None if i == 2 else w for i, w in enumerate(STEP)]
    assert edges.transitions(series(spark, gaps), 80, 15).count() == 2
    assert edges.transitions(series(spark, []), 80, 15).count() == 0
    with pytest.raises(ValueError):
        edges.detect(series(spark, STEP), min_n_samples=0)


def test_back_fill_keeps_the_last_gap(spark):
    df = prepare.backfill(series(spark, [None, 1.0, None, 3.0, None]))
    assert [r.watts for r in df.orderBy("t").collect()] == [1, 1, 3, 3, None]


def _random_series(n, seed):
    rnd, level, out = random.Random(seed), 100.0, []
    for _ in range(n):
        if rnd.random() < 0.15:
            level = rnd.choice([50.0, 100.0, 200.0, 400.0])
        out.append(level + rnd.uniform(-8, 8))
    return out


def test_online_equals_batch_and_facts_hold(spark):
    values = [_random_series(120, s) for s in range(6)]
    df = edges.transitions(series(spark, *values), 80, 15)
    for b, own in enumerate(values):
        detector = OnlineDetector(80, 15)
        online = [e for t, w in enumerate(own) if (e := detector.update(t, w))]
        batch = df.where(f"building = {b}").orderBy("edge_no").collect()
        assert [(r.edge_no, r.duration, r.start, r.end) for r in batch] == [(e["edge_no"], e["duration"], e["start"], e["end"]) for e in online]
        assert all(abs(r.transition - e["transition"]) < 1e-6 for r, e in zip(batch, online, strict=True))
        starts, ends = [r.start for r in batch], [r.end for r in batch if r.end is not None]
        assert starts == sorted(set(starts)) and ends == sorted(ends)


@pytest.mark.parametrize("delay", [None, "20 seconds"])
def test_stream_equals_batch(spark, tmp_path, delay):
    rows = [(1, "main", t, t, w) for t, w in enumerate(_random_series(150, 9))]
    schema = "building int, channel string, t long, seq long, watts double"
    batch = edges.transitions(spark.createDataFrame(rows, schema), 80, 15).collect()
    if delay:  # late by less than the delay, and rows that push the watermark on
        rows = [r for a in range(0, 150, 10) for r in random.Random(a).sample(rows[a : a + 10], 10)] + [(2, "push", 10_000, 10_000, 0.0), (2, "push", 10_001, 10_001, 0.0)]
    cuts = [0, 37, 38, 90, len(rows) - 2, len(rows) - 1, len(rows)] if delay else [0, 37, 38, 90, len(rows)]
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        spark.createDataFrame(rows[a:b], schema).selectExpr("*", "timestamp_seconds(t + 1000) as ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/n={i}")
    full = spark.read.parquet(f"{tmp_path}/in").drop("n").schema
    stream = spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    streamed = drain(spark, stream_transitions(stream, 80, 15, delay=delay), "test").where("channel = 'main'").collect()
    key = lambda r: (r.edge_no, round(r.transition, 6), r.duration, r.start, r.end)
    assert sorted(map(key, streamed)) == sorted(map(key, batch)) and batch


def test_resample_equals_a_plain_version(spark):
    """Cells of all days, means of several readings in a cell, and 0 in empty cells between a series' first and last."""
    from collections import defaultdict

    from wattflow.operators import prepare

    rows = [(1, "a", 5, 10.0), (1, "a", 6, 20.0), (1, "a", 11, 40.0), (1, "a", 40, 7.0), (1, "b", 86_400 * 2, 1.0), (1, "b", 86_400 * 2 + 13, 3.0), (2, "a", 0, 2.5)]
    cells = defaultdict(list)
    for building, channel, t, watts in rows:
        cells[building, channel, t // 6 * 6].append(watts)
    expected = {}
    for key in {k[:2] for k in cells}:
        own = [t for b, c, t in cells if (b, c) == key]
        for t in range(min(own), max(own) + 1, 6):
            found = cells.get((*key, t), [0.0])
            expected[(*key, t)] = sum(found) / len(found)
    got = prepare.resample(spark.createDataFrame(rows, "building int, channel string, t long, watts double"), 6).collect()
    assert {(r.building, r.channel, r.t): r.watts for r in got} == expected and len(got) == len(expected)


def _turns(spark, rows, schema):
    """Rows (turn, ...) as a table with ts."""
    return spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_seconds(t) as ts")


def _in_time(rows, delay):
    """Rows that are not late, those before the last watermark, and the number of late ones."""
    seen, kept, late = [], [], 0
    for turn in range(1 + max(r[0] for r in rows)):
        mark = max(seen) - delay if seen else -1
        for r in (r for r in rows if r[0] == turn):
            if r[3] <= mark:
                late += 1
            else:
                kept.append(r)
        seen += [r[3] for r in rows if r[0] == turn]
    return [r[1:] for r in kept if r[3] <= max(seen) - delay], late, max(seen) - delay


def test_late_readings_are_counted_and_left_out(spark):
    schema = "building int, channel string, t long, seq long, watts double"
    rnd, rows = random.Random(4), []
    for b in (1, 2):
        rows += [(min(3, t // 60 + (t % 60 > 50 and rnd.random() < 0.5) + (rnd.random() < 0.05)), b, "main", 1000 + t, t, w) for t, w in enumerate(_random_series(240, b))]
    rnd.shuffle(rows)
    in_time, late, _ = _in_time(rows, 15)
    made = lambda s: edges_with_late(s, 80, 15, delay="15 seconds")
    with state_store(spark):
        found = drain_in_turns(spark, _turns(spark, rows, f"turn int, {schema}"), "turn", 4, made, "test-late").cache()
    batch = edges.transitions(spark.createDataFrame(in_time, schema), 80, 15).collect()
    key = lambda r: (r.building, r.edge_no, round(r.transition, 6), r.duration, r.start, r.end)
    assert sorted(map(key, found.where("kind = 'edge'").collect())) == sorted(map(key, batch)) and batch
    counts = {r.building: r.n_late for r in late_counts(found).collect()}
    assert sum(counts.values()) == late > 0
    for b, n in counts.items():  # numbered without gaps through all turns
        assert sorted(r.late_no for r in found.where(f"kind = 'late' and building = {b}").collect()) == list(range(n))


def test_dense_cells_of_a_stream_equal_the_batch(spark):
    schema = "building int, channel string, t long, seq long, watts double"
    rnd, rows = random.Random(6), []
    for b in (1, 2):
        for i in range(160):
            t = 1000 + rnd.choice([i * 3, i * 3 + 1, 480 + i // 4])
            rows.append((min(3, max(0, (t - 1000) // 120 + (rnd.random() < 0.1))), b, "main", t, i, rnd.uniform(0, 9)))
    rows.append((3, 3, "push", 5000, 0, 1.0))
    in_time, late, mark = _in_time(rows, 20)
    final = [r for r in in_time if r[2] // 6 * 6 + 5 <= mark]
    with state_store(spark):
        found = drain_in_turns(spark, _turns(spark, rows, f"turn int, {schema}"), "turn", 4, lambda s: resampled_with_late(s, 6, "20 seconds"), "test-cells").cache()
    key = lambda r: (r.building, r.t, round(r.watts, 9))
    expected = prepare.resample(spark.createDataFrame(final, schema), 6).collect()
    assert sorted(map(key, found.where("kind = 'cell'").collect())) == sorted(map(key, expected))
    assert any(r.watts == 0 for r in expected) and found.where("kind = 'late'").count() == late > 0


def _drained(spark, rows, made, ts="timestamp_seconds(t)"):
    stream = spark.createDataFrame(rows, "turn int, building int, channel string, t long, seq long, watts double").selectExpr("*", f"{ts} as ts")
    with state_store(spark):
        return drain_in_turns(spark, stream, "turn", 1 + max(r[0] for r in rows), made, "test-mark").collect()


def test_a_cell_is_final_when_the_watermark_reaches_its_last_second(spark):
    rows = [(0, 1, "main", 3600, 0, 2.0), (0, 2, "main", 5000, 1, 4.0), (1, 2, "main", 7209, 2, 6.0)]  # ends at 7199
    found = _drained(spark, rows, lambda s: resampled_with_late(s, 3600, "10 seconds"))
    assert sorted((r.kind, r.building, r.t, r.watts) for r in found) == [("cell", 1, 3600, 2.0), ("cell", 2, 3600, 4.0)]


def test_parts_of_a_second_do_not_open_a_final_cell_again(spark):
    rows = [(0, 1, "main", 3600, 0, 2.0), (0, 2, "main", 7209, 1, 4.0), (1, 1, "main", 7199, 2, 6.0), (1, 2, "main", 9000, 3, 4.0)]
    found = _drained(spark, rows, lambda s: resampled_with_late(s, 3600, "10 seconds"), "timestamp_millis(1000 * t + if(seq = 2, 900, 200))")
    assert sorted((r.kind, r.building, r.t, r.watts) for r in found) == [("cell", 1, 3600, 2.0), ("late", 1, 7199, 6.0)]
