"""Every registered query runs on the smallest tables and matches its SQL check."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from ridgeflow.catalog import all_checks

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
CHECKS = all_checks()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return "null"
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def _rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(_cell(v) for v in row) for row in frame.itertuples(index=False))


def _motion_sessions(got, duck):
    """Every second of a track has one state; tracks last from their first to their last record."""
    parts = got["moving_s"] + got["stopped_s"] + got["undetermined_s"]
    assert (abs(parts - got["elapsed_s"]) < 0.01).all()
    assert (got.groupby("user_id")["convention"].nunique() == 5).all()
    spans = duck.sql("SELECT user_id, max(t) - min(t) AS s FROM (SELECT user_id, floor(epoch_us(ts) / 1000000.0 / 900) AS t FROM events) GROUP BY 1").df()
    joined = got.merge(spans, on="user_id")
    assert len(joined) == len(got) and (abs(joined["elapsed_s"] - joined["s"]) < 0.01).all()


def _matched_segments(got, duck):
    """Segments of a route follow one another; those kept have a time and their own length."""
    for _, own in got.groupby("c_nationkey"):
        assert sorted(own["k"]) == list(range(len(own)))
    kept = got[got["exclusion"].isna()]
    assert len(kept) and (kept["elapsed_s"] > 0).all() and kept["length_ratio"].between(0.9, 1.1).all()
    assert set(kept["klass"]) <= {"ascent", "flat", "descent", "mixed"}


def _climb_table(got, duck):
    """Climbs of a track do not overlap; their measures agree with one another."""
    assert (got["gain_m"] > 0).all() and (got["end_s"] > got["start_s"]).all() and (got["vertical_speed_ms"] > 0).all()
    assert (abs(got["gain_m"] / got["moving_distance_m"] - got["grade"]) < 0.02).all()
    for _, own in got.sort_values("start_s").groupby("c_nationkey"):
        assert (own["start_s"].to_numpy()[1:] >= own["end_s"].to_numpy()[:-1]).all()


def _wild_cluster_bootstrap(got, duck):
    """The interval stands around the slope that SQL finds, as far on either side, and is as wide
    as a few of its standard errors."""
    row = got.iloc[0]
    slope, se = duck.execute("""
        WITH i AS (SELECT l_suppkey AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
        f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS m, sum(x * x) - count(*) * avg(x) * avg(x) AS v FROM i),
        s AS (SELECT g, sum((x - m) * (y - a - b * x)) AS u FROM i, f GROUP BY g)
        SELECT (SELECT b FROM f), sqrt(sum(u * u)) / (SELECT v FROM f) FROM s""").fetchone()
    assert abs(row["coef"] - slope) < 1e-6 * abs(slope)
    assert abs((row["high"] - row["coef"]) - (row["coef"] - row["low"])) < 1e-6 * abs(slope)
    assert 1.5 * se < row["high"] - row["coef"] < 3 * se


#: Queries that no short SQL states: what must hold of their rows.
HOLDS = {
    "motion_sessions": _motion_sessions,
    "matched_segments": _matched_segments,
    "climb_table": _climb_table,
    "wild_cluster_bootstrap": _wild_cluster_bootstrap,
}


def test_every_query_is_checked():
    assert {n for n, c in CHECKS.items() if c.sql is None} == HOLDS.keys()


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, duck, name):
    check = CHECKS[name]
    got = check.run(spark, SF).toPandas()
    if check.sql is None:
        HOLDS[name](got, duck)
        return
    want = duck.sql(check.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
