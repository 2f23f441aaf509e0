"""Pairing, overlap matching, painting and scoring on worked examples and against plain versions."""

import random

import pytest

from wattflow.operators import matching, painting, pairing

EDGES = "building int, channel string, edge_no long, transition double, start long, end long"


def edges(spark, signs, channel="main"):
    return spark.createDataFrame([(1, channel, i, float(s), 10 * i, 10 * i + 1) for i, s in enumerate(signs)], EDGES)


def test_pairs_and_outermost_pairs(spark):
    df = edges(spark, [1, 1, -1, -1, -1, 1, -1])
    assert sorted((r.rise_no, r.fall_no) for r in pairing.pair_edges(df).collect()) == [(0, 3), (1, 2), (5, 6)]
    labelled = df.withColumnRenamed("channel", "label")
    assert sorted((r.rise_no, r.fall_no) for r in pairing.pair_outermost(labelled).collect()) == [(0, 3), (5, 6)]
    assert pairing.pair_edges(edges(spark, [])).count() == 0


def test_pairs_are_matched_brackets(spark):
    for seed in range(4):
        signs = [random.Random(seed).choice([1, -1]) for _ in range(60)]
        stack, expected = [], []
        for i, s in enumerate(signs):
            if s > 0:
                stack.append(i)
            elif stack:
                expected.append((stack.pop(), i))
        got = pairing.pair_edges(edges(spark, signs)).collect()
        assert sorted((r.rise_no, r.fall_no) for r in got) == sorted(expected)
        assert all(r.duration == r.end - r.start for r in got)


def test_tolerance_pairs_take_the_nearest(spark):
    df = edges(spark, [200, 500, -210, -480, 2000, -2050, -100])
    assert sorted((r.rise_no, r.fall_no) for r in pairing.pair_by_tolerance(df).collect()) == [(0, 2), (1, 3), (4, 5)]


def test_overlap_matches(spark):
    interval = lambda c, own: spark.createDataFrame([(1, c, i, 1.0, a, b) for i, (a, b) in enumerate(own)], EDGES)
    main, app = interval("main", [(10, 11), (20, 22), (40, 41)]), interval("fridge", [(14, 15), (26, 27), (32, 33)])
    found = matching.match_edges(main, app, 2)
    assert sorted((r.edge_no, r.main_edge) for r in found.collect()) == [(0, 0), (1, 1)]
    assert [r.edge_no for r in matching.unmatched_edges(app, found).collect()] == [2]
    labels = {r.edge_no: (r.fridge_label, r.label) for r in matching.label_main_edges(main, found, ["fridge"]).collect()}
    assert labels == {0: (1, "fridge"), 1: (1, "fridge"), 2: (0, "unknown")}


def test_overlap_matches_of_any_length(spark):
    rnd = random.Random(3)
    make = lambda n: [(a := rnd.randint(0, 3000), a + rnd.choice([0, 1, 5, 40, 700, 2500])) for _ in range(n)]
    main, app = make(60), make(60)
    to = lambda c, own: spark.createDataFrame([(1, c, i, 1.0, a, b) for i, (a, b) in enumerate(own)], EDGES)
    got = {r.edge_no: r.main_edge for r in matching.match_edges(to("main", main), to("x", app), 2, width=8).collect()}
    expected = {i: min(hits) for i, (a, b) in enumerate(app) if (hits := [j for j, (c, d) in enumerate(main) if a - d <= 4 and c - b <= 4])}
    assert got == expected


def test_paint_covers_both_ends_and_nests(spark):
    samples = spark.createDataFrame([(1, "a", t, float(t)) for t in range(12)], "building int, channel string, t long, watts double")
    pairs = spark.createDataFrame([(1, "a", 3, 8), (1, "a", 4, 5), (1, "a", 10, 10)], "building int, channel string, start long, end long")
    got = painting.paint_intervals(samples, pairs).orderBy("t").collect()
    assert [r.on for r in got] == [0, 0, 0, 1, 1, 1, 1, 1, 1, 0, 1, 0] and got[3].watts == 3
    assert painting.paint_intervals(samples, pairs.where("false")).agg({"on": "sum"}).first()[0] == 0


def test_scores_are_strict_and_null_without_cases(spark):
    truth = spark.createDataFrame([(1, "a", t, w) for t, w in enumerate([80.0, 81.0, 200.0, 0.0, 90.0])] + [(1, "b", 0, 0.0)], "building int, channel string, t long, watts double")
    sub = spark.createDataFrame([(1, "a", t, v) for t, v in enumerate([1.0, 1.9, 0.0, 1.0, 1.0])] + [(1, "b", 0, 0.0)], "building int, channel string, t long, value double")
    rows = {r.channel: r for r in painting.score_on_off(sub, truth).collect()}
    assert (rows["a"].n_predicted, rows["a"].n_true, rows["a"].n_hit, rows["a"].precision) == (4, 3, 2, 50.0)
    assert rows["a"].recall == pytest.approx(66.6667, abs=1e-3) and rows["b"].precision is None and rows["b"].recall is None
    checks = {r.channel: r.conforms for r in painting.check_submission(sub.where("not (channel = 'a' and t = 2)"), truth).collect()}
    assert checks == {"a": False, "b": True}


def test_a_long_interval_does_not_make_short_ones_meet(spark):
    """Of 500 + 500 short intervals and one long one each side, few pairs are compared, and matches are those of a plain search."""
    main = [(1, i, 40 * i, 40 * i + 6) for i in range(1, 501)] + [(1, 501, 0, 21_000)]
    app = [(1, "x", i, 40 * i + 13 * (i % 3), 40 * i + 13 * (i % 3) + 5) for i in range(1, 501)] + [(1, "x", 501, 5, 20_000)]
    m, a = spark.createDataFrame(main, "building int, edge_no long, start long, `end` long"), spark.createDataFrame(app, "building int, channel string, edge_no long, start long, `end` long")
    expected = {e: min(n for _, n, s, t in main if start - t <= 4 and s - end <= 4) for _, _, e, start, end in app}
    assert {r.edge_no: r.main_edge for r in matching.match_edges(m, a).collect()} == expected
    assert matching.candidates(m, a).count() < 10 * (len(main) + len(app))
