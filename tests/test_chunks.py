"""Series cut into chunks give what whole series give, whatever the length of a chunk."""

import random

import pytest
from pyspark.sql import functions as F

from wattflow.operators import chunks, edges, matching, painting, pairing, prepare

SERIES = "building int, channel string, t long, watts double"
EDGES = "building int, channel string, edge_no long, transition double, start long, end long"


def readings(spark, n_series=5, n=160):
    rows = []
    for b in range(n_series):
        rnd, level, t = random.Random(b), 100.0, rnd_start(b)
        for _ in range(n if b else 1):
            if rnd.random() < 0.2:
                level = rnd.choice([50.0, 100.0, 200.0, 400.0])
            rows.append((b, "main", t, None if rnd.random() < 0.05 else level + rnd.uniform(-9, 9)))
            t += rnd.choice([1, 1, 1, 2, 30])
    return spark.createDataFrame(rows, SERIES)


def rnd_start(b):
    return [-500, 0, 7, 1000, -3][b % 5]


def key(r):
    return tuple(round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r)


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    left, right = (sorted(map(key, df.select(*columns).collect()), key=repr) for df in (a, b))
    assert left == right and left
    return left


@pytest.mark.parametrize("chunk", [1, 3, 10, 64, 100_000])
@pytest.mark.parametrize("q", [1, 2, 4])
def test_edges_of_any_chunk(spark, chunk, q):
    df = readings(spark)
    how = {"noise_level": 30, "state_threshold": 15, "min_n_samples": q}
    same(edges.detect(df, **how), edges.detect(df, **how, chunk=chunk))


def test_samples_and_steady_states_of_a_chunk(spark):
    df = readings(spark)
    same(edges.transitions(df, 30, 15, with_sequence=True), edges.transitions(df, 30, 15, with_sequence=True, chunk=7))
    same(edges.steady_states(df, 30, 15), edges.steady_states(df, 30, 15, chunk=7))
    assert edges.detect(df.limit(0), chunk=7).count() == 0
    with pytest.raises(ValueError):
        edges.detect(df, chunk=0)


def test_a_series_is_many_tasks_and_its_readings_are_dealt_once(spark):
    df = spark.range(20_000).select(F.lit(1).alias("building"), F.lit("main").alias("channel"), F.col("id").alias("t"), (F.col("id") % 100).cast("double").alias("watts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = chunks.cut(df, ["building", "channel"], "t", 500)
        busy = {r[0] for r in rows.select(F.spark_partition_id()).distinct().collect()}
        assert len(busy) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = edges.detect(df, chunk=500)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange") <= 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("chunk", [1, 3, 8, 1000])
def test_pairs_of_any_chunk(spark, chunk):
    rows = []
    for seed, p in enumerate((0.5, 0.5, 0.7, 0.3, 0.9)):
        rnd = random.Random(seed)
        rows += [(seed, "main", i, 1.0 if rnd.random() < p else -1.0, 10 * i, 10 * i + 1) for i in range(60)]
    rows += [(9, "main", i, 1.0 if i < 30 else -1.0, 10 * i, 10 * i + 1) for i in range(60)]
    df = spark.createDataFrame(rows, EDGES)
    same(pairing.pair_edges(df), pairing.pair_edges(df, chunk=chunk))
    labelled = df.withColumnRenamed("channel", "label")
    same(pairing.pair_outermost(labelled), pairing.pair_outermost(labelled, chunk=chunk))


@pytest.mark.parametrize("chunk", [1, 5, 50, 10**6])
def test_backfill_and_painting_of_any_chunk(spark, chunk):
    df = readings(spark).where("building < 3 or t > 20")
    same(prepare.backfill(df), prepare.backfill(df, chunk=chunk))
    rnd = random.Random(1)
    spans = [(b, "main", (a := rnd.randint(-40, 200)), a + rnd.choice([0, 3, 50, 400])) for b in range(5) for _ in range(6)]
    pairs = spark.createDataFrame(spans, "building int, channel string, start long, end long")
    painted = same(painting.paint_intervals(df, pairs), painting.paint_intervals(df, pairs, chunk=chunk))
    assert len(painted) == df.count()
    expected = {(r.building, r.t): int(any(b == r.building and a <= r.t <= e for b, _, a, e in spans)) for r in df.collect()}
    assert {(r.building, r.t): r.on for r in painting.paint_intervals(df, pairs, chunk=chunk).collect()} == expected


def test_tolerance_pairs_equal_the_sequential_rule(spark):
    rows, expected = [], set()
    for seed in range(6):
        rnd = random.Random(seed)
        own = [(i, rnd.choice([1, -1]) * rnd.choice([100, 150, 180, 1500, 1540])) for i in range(90) if rnd.random() < 0.9]
        rows += [(seed, "x", i, float(w), i, i + 1) for i, w in own]
        used = set()
        for d in range(1, 8):
            for a in range(len(own) - d):
                (i, w), (j, v) = own[a], own[a + d]
                if not {a, a + d} & used and w > 0 >= v and abs(w + v) < (0.035 * w if w >= 1000 else 60):
                    used |= {a, a + d}
                    expected.add((seed, i, j))
    df = spark.createDataFrame([*rows, (0, "x", 500, 100.0, 500, None), (None, "x", 0, 5.0, 0, 1)], EDGES)
    for chunk in (1, 9, 1000):
        got = pairing.pair_by_tolerance(df, 8, 60, 0.035, 1000, chunk=chunk).collect()
        assert {(r.building, r.rise_no, r.fall_no) for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("chunk", [None, 1, 20, 5000])
def test_sweep_equals_buckets(spark, chunk):
    rows, app = [], []
    for b in range(4):
        rnd, t, e = random.Random(b), 0, 0
        for i in range(40):
            t += rnd.choice([0, 1, 3, 20])
            e = max(e, t - 1, t + rnd.choice([-1, 0, 2, 60]))
            rows.append((b, "main", i, 1.0, t, e))
        app += [(b, rnd.choice("xy"), i, 1.0, (a := rnd.randint(-30, 400)), rnd.choice([None, a, a + 5, a + 90])) for i in range(50)]
    main, app = spark.createDataFrame(rows, EDGES), spark.createDataFrame(app, EDGES)
    assert matching.ascending(main)
    same(matching.match_edges(main, app, 2, ordered=False), matching.match_edges(main, app, 2, chunk=chunk))


def test_unordered_edges_fall_back_to_buckets(spark):
    main = spark.createDataFrame([(1, "main", 0, 1.0, 50, 60), (1, "main", 1, 1.0, 0, 10)], EDGES)
    app = spark.createDataFrame([(1, "x", 0, 1.0, 5, 6), (1, "x", 1, 1.0, 55, 56)], EDGES)
    assert not matching.ascending(main)
    assert {(r.edge_no, r.main_edge) for r in matching.match_edges(main, app).collect()} == {(0, 1), (1, 0)}
