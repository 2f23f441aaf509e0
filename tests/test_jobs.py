"""The jobs from readings to intervals, scores, labelled pairs, training sets and reports."""

import random

import pytest

from wattflow.jobs import disaggregate as jobs
from wattflow.operators import train
from wattflow.sources import shared

READINGS = "building int, channel string, t long, watts double"


def cycles(level, starts, length, n=400, base=0.0):
    out = [base] * n
    for s in starts:
        for t in range(s, min(n, s + length)):
            out[t] += level
    return out


def house(building, seed):
    """A main meter that adds up two appliances and one that no meter of its own has."""
    rnd = random.Random(seed)
    fridge, oven = cycles(150, range(20, 380, 60), 12), cycles(900, range(45, 380, 120), 9)
    other = cycles(400, range(100, 380, 140), 5)
    noise = lambda w: w + rnd.uniform(-3, 3)
    main = [a + b + c for a, b, c in zip(fridge, oven, other, strict=True)]
    return [(building, name, t, None if name == "fridge" and t % 97 == 96 else noise(w)) for name, own in (("main", main), ("fridge", fridge), ("oven", oven)) for t, w in enumerate(own)]


@pytest.fixture(scope="module")
def readings(spark):
    return spark.createDataFrame([r for b in (1, 2) for r in house(b, b)], READINGS).cache()


def test_intervals_and_scores(readings):
    found = jobs.on_intervals(readings).where("channel = 'fridge' and building = 1").collect()
    assert [r.start for r in sorted(found, key=lambda r: r.start)] == [19 + 60 * k for k in range(6)] and all(r.duration == 13 for r in found)
    scores = {(r.building, r.channel): r for r in jobs.painted_scores(readings).collect()}
    assert all(scores[b, c].recall == 100 and scores[b, c].precision > 80 for b in (1, 2) for c in ("fridge", "oven"))


def test_labelled_pairs_and_training_set(readings):
    pairs = jobs.labelled_pairs(readings, ["fridge", "oven"])
    n = {(r["building"], r["label"]): r["count"] for r in pairs.groupBy("building", "label").count().collect()}
    assert n[1, "fridge"] >= 4 and n[1, "oven"] >= 2 and n[1, "unknown"] >= 1
    rows = jobs.training_set(pairs, ["fridge", "unknown"]).collect()
    assert {r.label for r in rows} == {0, 1} and len(rows) == sum(k for (_, name), k in n.items() if name != "oven")
    assert all(len(r.features) == 2 and r.features[0] > 0 for r in rows)


def test_report_of_appliances(readings):
    params = train.Params(n_clause=10, n_state=20, target=8, specificity=4.0, epochs=6)
    rows = {r.name: r for r in jobs.appliance_report(readings, ["fridge", "oven"], params, test_size=0.4).collect()}
    assert {"accuracy", "macro avg", "weighted avg"} < set(rows) and rows["accuracy"].support > 3


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: "spark://host:7077" if name == "spark.master" else default)

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
