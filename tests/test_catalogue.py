"""Every query with an oracle gives DuckDB's rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from factloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for name in df.columns:
        if df[name].dtype.kind in "fiu":
            df[name] = df[name].astype(float).round(6)
        else:
            df[name] = df[name].map(lambda v: "NULL" if v is None or v is pd.NaT or v is np.nan else str(v).removesuffix(" 00:00:00"))
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, sf, name):
    got = plain(catalogue.QUERIES[name](spark, sf).toPandas())
    want = plain(duck.sql(catalogue.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_question_answers_of_users_without_some_events(spark, tmp_path):
    events = f"SELECT i AS event_id, TIMESTAMP '2024-01-05 10:00:00' + to_days(i * 9) AS ts, i % 3 AS user_id, ['view', 'signup', 'view', 'error', 'view'][i + 1] AS event_type FROM (SELECT unnest(range(5))::INT AS i)"
    con = duckdb.connect()
    con.sql(f"COPY ({events}) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got = plain(catalogue.QUERIES["question_answers"](spark, str(tmp_path)).toPandas())
    want = plain(con.sql(catalogue.ORACLES["question_answers"]).df())
    assert "NULL" in set(want["cited"]) and "" in set(want["cited"])
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", ["question_answers", "question_walks"])
def test_texts_are_planned_once_and_not_once_a_user(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan  # no pattern runs over the questions of users
    assert "RoundRobinPartitioning" in plan  # few users with many questions each go to all tasks
