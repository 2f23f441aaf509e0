"""Bits, splits, models, training and metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattflow.functions import scalar
from wattflow.jobs.disaggregate import train_and_evaluate, train_save_evaluate
from wattflow.operators import features, metrics, model, pairing, predict, train
from wattflow.sources import readings


def test_quantize_rounds_halves_to_even(spark):
    one = spark.range(1)
    bits = lambda x, n: "".join(map(str, one.select(scalar.to_bits(scalar.quantize(F.lit(x), n), n).alias("b")).first().b))
    assert [bits(0.5, n) for n in (1, 2, 4, 8)] == ["0", "10", "1000", "10000000"]
    assert bits(1.0, 8) == "1" * 8
    for bad in (-0.01, 1.01):
        with pytest.raises(Exception, match="outside"):
            one.select(scalar.quantize(F.lit(bad), 4)).collect()
    with pytest.raises(ValueError):
        scalar.quantize(F.lit(0.5), 3)


def test_erf_is_near_and_odd(spark):
    for x in (-2.0, -0.3, 0.0, 0.7, 3.0):
        got = spark.range(1).select(scalar.erf(F.lit(x)).alias("e"), scalar.erf(F.lit(-x)).alias("m")).first()
        assert got.e == pytest.approx(math.erf(x), abs=2e-7) and (x == 0 or got.m == -got.e)


def test_labels(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "label string")
    assert [r[0] for r in df.select(scalar.encode_label(F.col("label"), {"a": 0}, strict=False)).collect()] == [0, None, None]
    with pytest.raises(Exception, match="unknown label z"):
        df.select(scalar.encode_label(F.col("label"), {"a": 0})).collect()


def test_splits_and_samples(spark):
    df = spark.range(103).withColumn("label", F.col("id") % 3)
    split = features.train_test_split(df, "id", 0.2, seed=1)
    assert split.where("is_train").count() == int(103 * 0.8) and split.count() == 103
    places = [r.place for r in features.seeded_shuffle(df, "id", 5).collect()]
    assert sorted(places) == list(range(1, 104))
    assert {r["count"] for r in features.balance(df, "id", num_per_class=30).groupBy("label").count().collect()} == {30}
    with pytest.raises(ValueError):
        features.balance(df, "id", num_per_class=40)


def _random_model(spark, n_feature, seed):
    rng = np.random.default_rng(seed)
    meta = model.Meta(3, n_feature, 8, 10)
    rows = [(c, j, 1 - 2 * (j % 2), [int(x) for x in np.where(rng.random(2 * n_feature) < 0.06, 9, 3)]) for c in range(3) for j in range(8)]
    return spark.createDataFrame(rows, model.STATES), meta


@pytest.mark.parametrize("n_feature", [16, 70])
def test_both_forms_and_both_ways_predict_alike(spark, tmp_path, n_feature):
    states, meta = _random_model(spark, n_feature, 4)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [int(x) for x in rng.integers(0, 2, n_feature)]) for i in range(60)], "id long, bits array<int>")
    out = []
    for form in model.FORMS:
        model.save_model(states, meta, f"{tmp_path}/{form}", form)
        loaded, sizes = model.load_model(spark, f"{tmp_path}/{form}")
        assert sizes == meta
        clauses = model.included(loaded, sizes)
        out.append(sorted((r.id, r.pred, r.votes) for r in predict.predict(df, clauses, 3, n_feature, return_votes=True).collect()))
        out.append(sorted((r.id, r.pred, r.votes) for r in predict.votes_by_join(df, clauses, "id", 3, n_feature).collect()))
    assert all(x == out[0] for x in out)
    with pytest.raises(ValueError):
        model.save_model(states, meta, f"{tmp_path}/x", "other")


def test_an_empty_clause_holds_and_ties_go_to_the_first(spark):
    clauses = spark.createDataFrame([(0, 0, 1, 1, 0, [0]), (1, 0, 1, 0, 0, []), (2, 0, 1, 0, 1, [1])], model.CLAUSES)
    df = spark.createDataFrame([([1, 0],), ([0, 1],), (None,)], "bits array<int>")
    assert [(r.pred, r.votes) for r in predict.predict(df, clauses, 3, 2, return_votes=True).collect()] == [(0, [1, 1, 1]), (1, [0, 1, 0]), (None, None)]


def test_footprint(spark):
    clauses = spark.createDataFrame([(0, j, 1, 2, 1, [0, 1, 2]) for j in range(4)], model.CLAUSES)
    assert model.model_footprint(clauses).first().n_bytes == 52 + 12 * 4 + 2 * 12


def _two_classes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(2.0 * (i % 2), 0.5, 3)], i % 2) for i in range(200)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int")


@pytest.mark.parametrize("exact", [True, False])
def test_training_beats_the_majority_and_repeats(spark, exact):
    params = train.Params(n_clause=10, n_state=10, target=8, specificity=4.0, epochs=6)
    runs = [sorted((r.id, r.pred, r.label) for r in train_and_evaluate(_two_classes(spark), "id", 2, params, exact=exact).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 40
    assert sum(p == y for _, p, y in runs[0]) / 40 > 0.85


def test_training_keeps_states_in_range(spark):
    df = features.booleanize_features(_two_classes(spark), 2, 1.0, 1.0).withColumn("k", F.col("id") % 2 + F.lit(0))
    states = train.train_grouped(df.withColumn("label", F.col("label")), ["k"], 2, train.Params(n_clause=4, n_state=6, target=4, epochs=2))
    assert states.select(F.array_min("state").alias("a"), F.array_max("state").alias("b")).agg(F.min("a"), F.max("b")).first()[0] >= 1
    assert states.count() == 2 * 2 * 4
    with pytest.raises(ValueError):
        model.Meta(2, 4, 3, 10)


def test_report_and_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "label int, pred int")
    rows = {r.name: r for r in metrics.report(df).collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["2"].f1, rows["accuracy"].f1) == (0.5, 1.0, 0.0, 0.5)
    assert sorted(tuple(r) for r in metrics.confusion(df, [0, 1, 2]).collect()) == [(0, 1, 1, 0), (1, 0, 1, 0), (2, 1, 0, 0)]
    assert metrics.accuracy(df).first()[0] == 0.5


def test_readings_of_buildings_with_different_channels(spark, tmp_path):
    (tmp_path / "redd_house1_0.csv").write_text(",fridge,main\n0,1.5,10\n1,,11\n")
    (tmp_path / "redd_house1_1.csv").write_text(",fridge,main\n0,2.5,NaN\n")
    (tmp_path / "redd_house2_0.csv").write_text(",main,stove\n0,5,7\n")
    df = readings.with_sample_number(readings.read_readings(spark, f"{tmp_path}/redd_house*.csv"))
    got = sorted((r.building, r.t, r.fridge, r.main, r.stove) for r in df.collect())
    assert got == [(1, 0, 1.5, 10.0, None), (1, 1, None, 11.0, None), (1, 2, 2.5, None, None), (2, 0, None, 5.0, 7.0)]
    long = readings.melt(df.select("building", "t", "fridge", "main", "stove"))
    assert long.count() == 12
    readings.write_table(long, f"{tmp_path}/long")
    assert readings.read_stage(spark, f"{tmp_path}/long", [1], ["main"]).count() == 3
    (tmp_path / "s.csv").write_text(",main,fridge\n0,1,\n1,x,1\n")
    sub = {(r.t, r.channel): r.value for r in readings.read_submission(spark, f"{tmp_path}/s.csv", 1).collect()}
    assert sub == {(0, "main"): 1, (0, "fridge"): 0, (1, "main"): 0, (1, "fridge"): 1}
    (tmp_path / "f.csv").write_text("a,b,kind\n1,2,x\n")
    assert readings.read_labelled_csv(spark, f"{tmp_path}/f.csv").first() == ([1.0, 2.0], "x")


def plain_feedback(states, bits, label, id_, epoch, params):
    """One sample's changes, automaton by automaton."""
    n_class, n_clause, n_literal = states.shape
    draw = lambda key, number: train.keyed(key, np.array([number]))
    key = draw(draw(draw(np.zeros(1, np.uint64), params.seed), epoch), np.int64(id_))
    literals, middle, change = [*bits, *(1 - b for b in bits)], params.n_state // 2, np.zeros(states.shape, int)
    other = int(train.uniform(draw(key, 0))[0] * (n_class - 1))
    other += other >= label
    for row, (cls, sign) in enumerate(((label, 1), (other, -1))):
        holds = [all(x or s <= middle for x, s in zip(literals, states[cls, j], strict=True)) for j in range(n_clause)]
        votes = max(-params.target, min(params.target, sum((1 - 2 * (j % 2)) * h for j, h in enumerate(holds))))
        for j in range(n_clause):
            own = draw(key, 1 + row * n_clause + j)
            if train.uniform(own)[0] >= (params.target - sign * votes) / (2 * params.target):
                continue
            for k in range(n_literal):
                state, u = states[cls, j, k], (int(draw(own, k // 4)[0]) >> 16 * (k % 4)) % 65_536 / 65_536
                if (j % 2 == 0) == (sign > 0):
                    if holds[j] and literals[k]:
                        change[cls, j, k] += u < round(65_536 * (params.specificity - 1) / params.specificity) / 65_536 and state < params.n_state
                    else:
                        change[cls, j, k] -= u < round(65_536 / params.specificity) / 65_536 and state > 1
                elif holds[j]:
                    change[cls, j, k] += not literals[k] and state <= middle
    return change


@pytest.mark.parametrize("n_class", [2, 4])
def test_a_batch_equals_its_samples_one_by_one(n_class):
    params, rng = train.Params(n_clause=6, n_state=8, target=3, specificity=3.0, seed=5), np.random.default_rng(n_class)
    states = rng.integers(1, 9, (n_class, 6, 10))
    states[:, ::3] = rng.integers(1, 5, states[:, ::3].shape)  # clauses that hold
    bits, labels, ids = rng.integers(0, 2, (40, 5)), rng.integers(0, n_class, 40), rng.integers(-5, 1 << 40, 40)
    expected = sum(plain_feedback(states, b.tolist(), int(y), int(i), 2, params) for b, y, i in zip(bits, labels, ids, strict=True))
    assert (train.batch_feedback(states, bits, labels, ids, 2, params) == expected).all() and expected.any()


def test_batched_training_does_not_depend_on_partitions(spark):
    df = features.booleanize_features(_two_classes(spark), 2, 1.0, 1.0)
    params, meta = train.Params(n_clause=4, n_state=6, target=4, epochs=2), model.Meta(2, 6, 4, 6)
    learn = lambda rows: sorted(map(str, train.train_batched(rows, "id", meta, params).collect()))
    odd = spark.createDataFrame([(None, [1] * 6, 0), (5000, None, 1), (5001, [0] * 6, None)], "id long, bits array<int>, label int")
    assert learn(df.repartition(7)) == learn(df.coalesce(1).select("id", "bits", "label").unionByName(odd))


def test_a_grid_learns_what_its_settings_learn_alone(spark):
    df = features.booleanize_features(_two_classes(spark), 2, 1.0, 1.0).withColumn("k", (F.col("id") % 4 < 2).cast("int"))
    grid = [train.Params(n_clause=4, n_state=6, target=4, epochs=1), train.Params(n_clause=6, n_state=10, target=5, specificity=3.0, epochs=4)]
    found = train.train_grid(df, ["k"], "id", 2, grid, seed=3)
    rows = found.collect()
    assert len(rows) == 2 * 2 * (4 + 6)
    split = features.train_test_split(df.select("k", "id", "bits", "label"), "id", 0.2, 3, exact=False).orderBy("label", "id").collect()
    for k in (0, 1):
        for i, params in enumerate(grid):
            own = [r for r in split if r.k == k and r.is_train]
            bits = np.array([r.bits for r in own])
            states = train.train_samples(bits, np.array([r.label for r in own]), train._first_states(2, bits.shape[1], params), params)
            got = {(r["class"], r.clause): r.state for r in rows if (r.k, r.setting) == (k, i)}
            assert got == {(c, j): states[c, j].tolist() for c in range(2) for j in range(params.n_clause)}
        best = {(r.accuracy, r.setting) for r in rows if r.k == k and r.best}
        assert len(best) == 1 and best.pop()[0] == max(r.accuracy for r in rows if r.k == k)


def test_a_saved_model_is_as_good_as_the_learned_one(spark, tmp_path):
    params = train.Params(n_clause=10, n_state=10, target=8, specificity=4.0, epochs=4)
    rows = train_save_evaluate(_two_classes(spark), "id", 2, params, f"file://{tmp_path}").collect()
    assert {r.form for r in rows} == {"learned", "training", "inference"} and len({(r.n_test, r.accuracy) for r in rows}) == 1
    assert rows[0].accuracy > 0.85


def test_footprints_of_a_model_of_three_classes(spark):
    """300 clauses with 2,512 literals in all take 8,676 bytes."""
    sizes = [8 + (j < 112) for j in range(300)]
    clauses = spark.createDataFrame([(j // 100, j % 100, 1, n, 0, list(range(n))) for j, n in enumerate(sizes)], model.CLAUSES)
    assert sum(sizes) == 2512 and model.model_footprint(clauses).first().n_bytes == 8676
    states = spark.createDataFrame([(0, j, 1, [1] * 32) for j in range(300)], model.STATES)
    assert model.training_footprint(states).first().n_bytes == 52 + 8 * 300 + 4 * 300 * 32


def test_a_model_that_is_too_large_is_an_error(spark, monkeypatch):
    clauses = spark.createDataFrame([(0, j, 1, 1, 0, [0]) for j in range(4)], model.CLAUSES)
    monkeypatch.setattr(model, "MOST_AUTOMATA", 15)
    with pytest.raises(ValueError):
        model.to_arrays(clauses, 2)


@pytest.mark.parametrize("fmt", readings.FORMATS)
def test_tables_come_back_as_they_were_written(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "fridge", 0, 2.5, [1.0, 2.0]), (2, "main", 3, None, [])], "building int, channel string, edge_no long, transition double, sequence array<double>")
    readings.write_table(df, f"{tmp_path}/{fmt}", fmt)
    back = spark.read.format(fmt).schema("channel string, edge_no long, transition double, sequence string, building int" if fmt == "csv" else df.schema).option("header", True).load(f"{tmp_path}/{fmt}")
    if fmt == "csv":
        back = back.withColumn("sequence", F.from_json("sequence", "array<double>"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_clusters_equal_a_plain_mean_shift(spark):
    rnd, rows = np.random.default_rng(8), []
    for b in (1, 2):
        rows += [(b, float(abs(h))) for centre in (60, 150, 420) for h in rnd.normal(centre, 9, 40)]
    got = pairing.cluster_pairs(spark.createDataFrame(rows, "building int, height_w double"), 30.0, 5.0).collect()
    for b in (1, 2):
        points = [(np.floor(h / 5) + 0.5) * 5 for k, h in rows if k == b]
        ends = []
        for x in points:
            while True:
                near = [p for p in points if abs(p - x) <= 30]
                if abs(sum(near) / len(near) - x) < 1e-9:
                    break
                x = sum(near) / len(near)
            ends.append(x)
        merged = []
        for x in sorted(ends):
            if merged and x - merged[-1][0] <= 15:
                merged[-1][1] += 1
            else:
                merged.append([x, 1])
        own = sorted((r.center_w, r.n) for r in got if r.building == b)
        assert len(own) == len(merged) and all(abs(c - m) < 1e-5 and n == k for (c, n), (m, k) in zip(own, merged, strict=True))
