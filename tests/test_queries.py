"""Every query that has SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from touchline import catalog


def cell(x):
    if isinstance(x, (list, np.ndarray)):
        return "[" + ",".join(map(cell, x)) + "]"
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    return format(float(x), ".9g") if isinstance(x, (int, float, np.integer, np.floating)) else str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object).map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(name, spark, duck, sf_dir):
    got, want = rows(catalog.queries()[name](spark, sf_dir).toPandas()), rows(duck.sql(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "grp"
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["settle_bets", "bet_groups", "bets_of", "settle_in_time", "normalise_picks", "upsert_odds", "page_matches", "backtest", "pattern_recommendations", "predict_and_review", "append_and_update_bets", "bets_dashboard"])
def test_queries_of_few_columns_write_no_view(name, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "_VIEWS", {})
    catalog.queries()[name](spark, sf_dir)
    assert not catalog._VIEWS


def test_only_bets_that_are_shown_are_settled(spark, sf_dir):
    from touchline.plans import bets

    legs, m = catalog.view(spark, sf_dir, "legs"), catalog.matches(spark, sf_dir)
    chosen = bets.newest_legs(legs, 2)
    assert 0 < chosen.count() < legs.count() / 2
    got, want = (rows(bets.bet_groups(bets.settle_bets(x, m), 2).toPandas()) for x in (chosen, legs))
    pd.testing.assert_frame_equal(got, want)
    mine = bets.settle_bets(bets.legs_of(legs, "d7"), m).where("device_id = 'd7'")
    pd.testing.assert_frame_equal(rows(mine.toPandas()), rows(bets.settle_bets(legs, m).where("device_id = 'd7'").toPandas()))
