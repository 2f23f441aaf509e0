"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from wattflow.jobs import queries
from wattflow.jobs.oracle import ORACLE_SQL
from wattflow.jobs.queries import QUERIES
from wattflow.operators import train

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def _plain(rows):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "lineitem", "embeddings"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = _plain(map(tuple, df.select(*(f"`{c}`" for c in columns)).collect()))
    relation = duck.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    assert got == _plain(relation.select(*(f'"{c}"' for c in columns)).fetchall())


def test_dense_cells_up_to_the_last_second_of_an_hour_equal_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"create table events as select * from '{DATA}/events.parquet'")
    con.execute("update events set ts = date_trunc('hour', ts) + interval '3599.5 seconds' where ts = (select max(ts) from events)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = QUERIES["stream_resampled_dense"](spark, str(tmp_path)).select("building", "channel", "t", "watts").collect()
    want = con.sql(f"select building, channel, t, watts from ({ORACLE_SQL['stream_resampled_dense']})").fetchall()
    assert _plain(map(tuple, got)) == _plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_saved_model_is_learned_from_all_rows(spark):
    learned = sorted(map(tuple, queries.q_train_batched(spark, DATA).select("class", "clause", "state").collect()))
    states, _ = queries._saved(spark, DATA, "training")
    assert sorted(map(tuple, states.select("class", "clause", "state").collect())) == learned


def test_the_registered_training_is_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(train, "train_grouped", None)
    assert QUERIES["train_and_evaluate"](spark, DATA).count() > 0
