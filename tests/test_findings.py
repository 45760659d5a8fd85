"""Findings on larger tables: each test failed on the code before its finding was settled."""

from __future__ import annotations

import math
import os
import statistics
from bisect import bisect_right

import duckdb
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from ridgeflow.catalog import curves, measures, outings, scores
from ridgeflow.functions import grades
from ridgeflow.operators import calibration, climbs, clocks, curve, days, matching, ordered, pace, panel, quantiles, route, scoring, track, trend
from ridgeflow.plans import sensitivity
from ridgeflow.session import ALL_JOIN_KEYS, HUGE_METHOD, cut_lineage
from ridgeflow.tables import compact

SF = "/root/testdata/sf0.1"


def test_bins_and_paces_of_a_grade_are_searched_once(spark):
    """a bin is a few comparisons, the knots of a curve are filtered once a row."""
    edges = [e / 1000 for e in grades.BIN_EDGES_PERMILLE]
    values = [g + d for g in edges for d in (-1e-12, 0.0, 0.004)]
    rows = spark.createDataFrame([(v,) for v in values], "g double")
    found = rows.select("g", grades.bin_index(F.col("g")).alias("bin"))
    for row in found.collect():
        inside = edges[0] <= row.g < edges[-1]
        assert row.bin == (bisect_right(edges, row.g) - 1 if inside else None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "floor" not in plan.lower() and plan.count(">=") <= len(edges) + 1
    knots = pace.literal_knots([-0.1, 0.0, 0.1], [1.0, 2.0, 1.0])
    read = rows.withColumn("knots", knots).select("g", pace.curve_pace(F.col("g"), F.col("knots")).alias("p"))
    assert read._jdf.queryExecution().analyzed().toString().count("filter(") == 1
    paces = {round(r.g, 3): r.p for r in read.collect()}
    assert abs(paces[0.05] - 0.75) < 1e-12 and abs(paces[0.2] - 2.0) < 1e-12 and paces[0.0] == 0.5


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_a_stop_on_a_grid_point_keeps_its_last_instant(spark):
    """two tracks stop on a grid point but for the noise of their summed steps; an interval
    of length 0 came out, and the one before it ended at the stop's first instant."""
    records = curves._meridian(spark, SF).filter(F.col("user_id").isin(156, 1038))
    rules = curve.CurveRules(max_elapsed_s=curves.CEILING_S)
    out = curve.activity_intervals(records, ["user_id"], None, rules, step_m=25.0, window_m=100.0)
    last = out.groupBy("user_id").agg(F.max("i").alias("i"), F.min("length_m").alias("least")).collect()
    assert {r.user_id for r in last} == {156, 1038} and all(r.i == 7 and r.least > 1 for r in last)


def test_configured_scores_are_read_from_one_written_table(spark):
    """a comparison reads the values twice, and each reading passed over the segments again."""
    rows = [("a", "m", *sensitivity.CENTRAL_M, k, "flat", 2.0 + k, [1.0 + k] * sensitivity.CLOCKS) for k in range(3)]
    types = "o string, model string, step_m double, tolerance_m double, k int, klass string, p double, times array<double>"
    values = sensitivity.configured_scores(spark.createDataFrame(rows, types), ["o"])
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert values.count() == 11 * 3 and values.select("signature").distinct().count() == 1


def test_overlapping_nights_mask_from_their_first_end(spark):
    """a point that two nights hold is masked when the first of them ends; windows that overlap
    were one window, and a night that holds another hid its last point and its day points."""
    windows = [(0.0, 100.0), (60.0, 160.0), (300.0, 400.0), (310.0, 320.0), (390.0, 396.0)]
    singles = [(5.0, 1.0), (70.0, 2.0), (150.0, 3.0), (250.0, 4.0), (305.0, 5.0), (315.0, 6.0)]
    own = [(20.0, 7.0, 0.0, 100.0), (350.0, 8.0, 300.0, 400.0), (392.0, 9.0, 390.0, 396.0)]
    asked = [float(t) for t in range(0, 420, 3)]
    nights = spark.createDataFrame([("a", *w) for w in windows], "k string, n0 double, n1 double")
    file_day = F.lit("2024-01-01").cast("date").alias("file_day")
    day_points = spark.createDataFrame([("a", *d) for d in singles], "k string, t double, level double").select("*", file_day)
    night_points = spark.createDataFrame([("a", *n) for n in own], "k string, t double, level double, n0 double, n1 double").select("*", file_day)
    probes = spark.createDataFrame([("a", t) for t in asked], "k string, at double")
    for strict in (False, True):

        def done(end, at, strict=strict):
            return end < at if strict else end <= at

        def seen(t, at, strict=strict):
            return t < at if strict else t <= at

        out = days.battery_at(probes, day_points, night_points, nights, ["k"], "at", strict=strict)
        got = {r["at"]: (r.point_t, r.level, r.from_night) for r in out.collect()}
        assert len(got) == len(asked)
        for at in asked:
            known = [(t, v, True) for t, v, _, n1 in own if done(n1, at)]
            for t, v in singles:
                if seen(t, at) and not any(n0 <= t <= n1 and done(n1, at) for n0, n1 in windows):
                    known.append((t, v, False))
            assert got[at] == max(known, default=(None, None, None)), (strict, at)


def test_a_median_is_selected_by_counting(spark, monkeypatch):
    """each step of the robust fit wrote and sorted every different residual."""
    written = []
    monkeypatch.setattr(quantiles, "WRITTEN_BYTES", 0)
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df: written.append(df) or df)
    monkeypatch.setattr(quantiles, "SELECT_ROWS", 3)
    monkeypatch.setattr(quantiles, "SELECT_BINS", 4)
    lists = [[3.0], [1.0, 2.0], [5.0] * 40, [0.1 * (i * 37 % 101) for i in range(100)], [0.0] * 20 + [9.0] * 20]
    lists += [[1.0 + i * 2.0**-52 for i in range(30)], [1e-300, 1.0, 1e300, 2.0, 3.0]]
    for values in lists:
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        for near in (None, 2.0, 1e-9, 1e9):
            assert quantiles.select_median(rows, "v", near) == statistics.median(values)
    data = [(1.0, float(i % 50), i % 50 + (i * 17 % 23) * 0.1 + (400.0 if i % 11 == 3 else 0.0)) for i in range(600)]
    items = spark.createDataFrame(data, "one double, x double, y double")
    fit, scale, _ = trend.huber(items, ["one", "x"], "y", tolerance=1e-9)
    rest = [abs(y - fit.coef[0] - fit.coef[1] * x) for _, x, y in data]
    assert abs(scale * 0.6744897501960817 - statistics.median(rest)) < 1e-9 and not written


def test_sleep_decides_on_slices_once(spark, monkeypatch):
    """F8: every scan of a chain looked for large keys anew and passed over all before it: seven times."""
    calls = []
    decide = ordered.assign_chunks
    monkeypatch.setattr(ordered, "assign_chunks", lambda *a, **k: calls.append(a) or decide(*a, **k))
    spans = spark.createDataFrame([("a", 0, 0.0, 100.0)], "k string, span_id int, start_s double, end_s double")
    rows = [("a", 1, 0.0, 10.0, 8.0, 1.0), ("a", 2, 5.0, 20.0, 9.0, 1.0), ("a", 3, 30.0, 40.0, 6.0, 2.0)]
    episodes = spark.createDataFrame(rows, "k string, episode int, e0 double, e1 double, sleep_s double, unmeasurable_s double")
    parts = [("a", 1, 1.0, 10.0, True), ("a", 2, 6.0, 20.0, True), ("a", 2, 5.0, 6.0, False), ("a", 3, 30.0, 38.0, True)]
    segments = spark.createDataFrame(parts, "k string, episode int, s0 double, s1 double, asleep boolean")
    row = days.sleep_within(spans, episodes, segments, ["k"], 50.0).first()
    assert (row.episodes, row.sleep_s, row.coverage) == (3, 17.0 + 6.0, (30.0 - 3.0) / 30.0)
    assert len(calls) == 3


def test_prefix_ranks_of_small_and_large_keys(spark, monkeypatch):
    """every key went through counters of sixteen digits; small keys read one sorted array."""
    ranked = []
    digits = calibration._digit_ranks
    monkeypatch.setattr(calibration, "_digit_ranks", lambda *a: ranked.append(a) or digits(*a))
    rows = [("s", float(t), float(t * 7 % 11)) for t in range(20)] + [("l", float(t // 2), float(t * 13 % 37)) for t in range(90)]
    points = spark.createDataFrame([*rows, ("s", 3.0, None)], "k string, t double, v double")
    asked = [(k, float(a)) for k in ("s", "l", "none") for a in (-1, 0, 1, 7, 19, 44, 99)]
    probes = spark.createDataFrame(asked, "k string, at double")
    orders = calibration.BAND_ORDERS
    for limit in (256, 50):
        monkeypatch.setattr(calibration, "SMALL_KEY", limit)
        out = calibration.prefix_ranks(probes, points, ["k"], "at", "t", "v", orders)
        got = {(r.k, r["at"]): (r.n_known, *(r[n] for n in orders)) for r in out.collect()}
        assert len(got) == len(asked) and len(ranked) == (limit == 50)
        for k, at in asked:
            known = sorted(v for key, t, v in rows if key == k and t < at)
            n = len(known)
            want = (n, *(known[-(-n * a // b) - 1] for a, b in orders.values())) if n else (None,) * 5
            assert got[k, at] == want


def test_quantiles_and_median_share_one_count(spark, monkeypatch):
    """the query counted all values twice."""
    counts = []
    rank_values = quantiles.rank_values
    monkeypatch.setattr(quantiles, "rank_values", lambda *a, **k: counts.append(a) or rank_values(*a, **k))
    rows = curves.rank_quantiles(spark, "/root/testdata/sf0.001").collect()
    assert len(counts) == 1 and all(r.q10 <= r["median"] <= r.q90 for r in rows)


def test_bands_draw_once(spark):
    """the spreads and the largest ratios each passed over all rows and drew their signs."""
    rows = spark.createDataFrame([(k, i, float(i * 7 % 13)) for k in range(3) for i in range(40)], "x int, i int, r double")
    rows = rows.withColumn("f", F.lit(5.0)).withColumn("key", F.concat_ws("-", "x", "i"))
    curve_draws = trend.signed_means(rows, "x", "f", "r", "key", 20, 3)
    estimate = rows.groupBy("x").agg(F.avg("f").alias("estimate"))
    band = trend.max_t_band(estimate, curve_draws, 0.9)
    assert "MapInPandas" not in band._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.low < r.estimate < r.high for r in band.collect()) and band.count() == 3


def test_a_step_toward_the_pole_meets_the_points_at_its_end(spark):
    """the cells around a score point are those of its own latitude. Steps were listed in the
    cells around them by the latitude of their start, nine each: both passes below were lost."""
    metre = 180 / 3.141592653589793 / 6371008.8
    cell, _ = matching._cell_sizes(30.0)
    east = metre / 0.17364817766693033  # cos 80 degrees
    lon = cell * 1000 + 1e-9
    frames = spark.createDataFrame(
        [(1, k, False, 80.0, lon + k * cell * 40, 0.0, 1.0) for k in range(2)],
        "o int, k int, last boolean, q_lat double, q_lon double, tx double, ty double",
    )
    steps = spark.createDataFrame(
        [(1, k, 79.0, at, 0.0, 0.0, 0, 80.001, at, 5.0, 111000.0, 0) for k in range(2) for at in [lon + k * cell * 40 - 29.9 * east]],
        "o int, i long, r_lat double, r_lon double, r_t double, r_d double, r_block int, n_lat double, n_lon double, n_t double, n_d double, n_block int",
    )
    found = matching.crossings(frames, steps, ["o"], matching.MatchRules()).collect()
    assert sorted(r.k for r in found) == [0, 1] and all(abs(abs(r.lateral_m) - 29.9) < 1e-3 for r in found)
    listed = matching._near(frames, steps, ["o"], 30.0, True)._jdf.queryExecution().optimizedPlan().toString()
    assert listed.count("Generate") == 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_segment_distances_are_rows(spark):
    """distances were arrays searched inside arrays, a piece at a time."""
    small = SF.replace("sf0.1", "sf0.001")
    line, records, points = outings._matched(spark, small)
    dated = points.filter("k < 2").groupBy("c_nationkey").pivot("k", [0, 1]).agg(F.first("pos").alias("pos"), F.first("effective_m").alias("m"))
    near = records.select("c_nationkey", "i", "lat", "lon")
    whole = dated.filter("`1_pos` IS NOT NULL").select(
        "c_nationkey", F.lit(0).alias("k"), F.col("0_m").alias("start_m"), F.col("1_m").alias("end_m"), F.col("0_pos").alias("pos0"), F.col("1_pos").alias("pos1")
    )
    for tag in "01":
        ends = near.select("c_nationkey", F.col("i").alias("_i"), F.col("lat").alias(f"p{tag}_lat"), F.col("lon").alias(f"p{tag}_lon"))
        whole = whole.withColumn("_i", F.floor(f"pos{tag}")).join(ends, ["c_nationkey", "_i"]).drop("_i")
    out = matching._interior(whole, line, records, ["c_nationkey"], matching.MatchRules())
    assert "array_min" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    # The trace runs 2e-5 degrees of longitude east of its route.
    assert rows and all(1.0 < r.h1_m < 2.0 and 1.0 < r.h2_m < 5.0 for r in rows)


def test_clocks_and_profiles_scan_once(spark, monkeypatch):
    """each speed of the conventions had scans of its own, each scan of a profile passed over
    the whole track again, and wide tables were written by methods too long to be compiled."""
    scans, decided = [], []
    run, decide = ordered.running, ordered.assign_chunks
    monkeypatch.setattr(ordered, "running", lambda *a, **k: scans.append(a) or run(*a, **k))
    monkeypatch.setattr(ordered, "assign_chunks", lambda df, *a, **k: decided.append("asin" in df._jdf.queryExecution().analyzed().toString().lower()) or decide(df, *a, **k))
    rows = [("a", 5.0 * i, 45.0 + 2e-5 * (i if i < 40 else 40), 6.0, 500.0 + min(i, 40)) for i in range(80)]
    records = spark.createDataFrame(rows, "k string, time_s double, lat double, lon double, ele double")
    series = cut_lineage(track.build_series(records, ["k"]))
    scans.clear()
    states = clocks.clock_partition(series, ["k"])
    assert len(scans) == 2
    by_time = {r.time_s: [r[f"state_{k}"] for k in range(5)] for r in states.collect()}
    assert set(by_time[60.0]) == {clocks.MOVING} and set(by_time[300.0]) == {clocks.STOPPED}
    decided.clear()
    profile = route.build_profile(series.withColumn("seq", F.col("time_s")), ["k"])
    assert profile.count() > 2 and not any(decided)
    seen = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path: seen.append(spark.conf.get(HUGE_METHOD)) or write(w, path))
    before = spark.conf.get(HUGE_METHOD)
    cut_lineage(series)
    assert seen == ["8000"] and spark.conf.get(HUGE_METHOD) == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_projections_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    """a table of any size was dealt to one number of tasks, and each scan of a
    projection looked for large keys by passing over the whole of it."""
    decided = []
    decide = ordered.assign_chunks
    monkeypatch.setattr(ordered, "assign_chunks", lambda *a, **k: decided.append(a) or decide(*a, **k))
    small = SF.replace("sf0.1", "sf0.001")
    few = curves.pace_lookup_projection(spark, small)
    assert len(decided) == 1
    monkeypatch.setattr(ordered, "input_bytes", lambda df: 100e6)
    many = curves.pace_lookup_projection(spark, small)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_suppkey" in plan and ", 13" in plan
    assert few.exceptAll(many).count() == 0 and few.count() == many.count() > 0


def test_copies_of_climbs_are_not_paired(spark):
    """F16: two pieces whose first climbs are not linked were compared copy by copy: with their square."""
    lon = 0.0009 * 1.05
    kinds = [(100.0, 6.0), (106.0, 6.0), (109.9, 6.0 + lon), (112.0, 6.0 + lon)]
    rows = [("n", 4 * c + k, g, 45.0, at, 45.01, at) for c in range(30) for k, (g, at) in enumerate(kinds)]
    schema = "k string, climb_id long, gain_m double, start_lat double, start_lon double, end_lat double, end_lon double"
    links = panel.route_links(spark.createDataFrame(rows, schema), ["k"], 100.0, 1.1)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "min(climb_id" in plan
    parts = {r.node: r.component for r in panel.effects.components(links, "a", "b").collect()}
    assert len(parts) == len(rows) and len(set(parts.values())) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_intervals_are_dealt_by_the_size_of_the_table(spark, monkeypatch, tmp_path):
    """partial sums as long as the table, a join of few tasks and cells made twice grew with
    it; and an order that stands twice counted as one activity of twice the time."""
    small = SF.replace("sf0.1", "sf0.001")
    os.symlink(f"{small}/lineitem.parquet", tmp_path / "lineitem.parquet")
    orders = spark.read.parquet(f"{small}/orders.parquet")
    orders.union(orders.where("o_orderkey % 3 = 0")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    few = curves.median_curve(spark, str(tmp_path)).collect()
    with duckdb.connect() as duck:
        duck.sql(f"CREATE VIEW lineitem AS FROM '{small}/lineitem.parquet'")
        duck.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
        want = duck.sql(curves.MEDIAN_SQL).fetchall()
    assert sorted(tuple(r) for r in few) == sorted(want)
    written = []
    cut = curve.cut_lineage
    monkeypatch.setattr(curve, "cut_lineage", lambda df: written.append(df) or cut(df))
    monkeypatch.setattr(ordered, "input_bytes", lambda df: 100e6)
    many = curves.median_curve(spark, str(tmp_path))
    assert sorted(many.collect()) == sorted(few)
    assert len(written) == 1
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", 13)" in plan and "o_orderpriority" in plan
    assert plan.count("Exchange hashpartitioning") <= 2  # nothing is dealt again for the sums
    assert "RepartitionByExpression" in curves.grade_bins_curve(spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_dealt_once_for_all_configurations(spark, monkeypatch, request):
    """the totals and the deviations shuffled and sorted every item under all nineteen
    configurations, by supplier, configuration and class. Now only the items are dealt; a large
    key is spread over slots, with the same values."""
    plans = []
    cut = scoring.cut_lineage
    monkeypatch.setattr(scoring, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    small = SF.replace("sf0.1", "sf0.001")
    rows = [(o, n, f"c{n % 2}", 1.0 + n % 5, 2.0 + n % 3) for o, size in (("a", 60), ("b", 4)) for n in range(size)]
    pairs = [(s, t) for s in sensitivity.STEPS_M for t in sensitivity.TOLERANCES_M]
    data = [(o, "m", s, t, n, c, p * (1 + s / 1e3), [q - 0.1 * k for k in range(sensitivity.CLOCKS)]) for o, n, c, p, q in rows for s, t in pairs if t < 40 or n % 7]
    types = "o string, model string, step_m double, tolerance_m double, k int, klass string, p double, times array<double>"
    forecast = spark.createDataFrame(data, types)
    whole = sensitivity.configured_scores(forecast, ["o"]).collect()
    assert len(plans) == 2 and not any("ENSURE_REQUIREMENTS" in plan for plan in plans)
    request.getfixturevalue("split")
    parts = sensitivity.configured_scores(forecast, ["o"]).collect()
    assert "slot" in plans[2] and "slot" in plans[3]
    got = {(r.o, r.configuration, r.metric): r for r in whole}
    assert len(got) == len(whole) == len(parts) == 2 * 19 * 5
    for r in parts:
        same = got[r.o, r.configuration, r.metric]
        assert abs(r.value - same.value) < 1e-12 and (r.motif, r.signature) == (same.motif, same.signature)
    for c in sensitivity.configurations():
        for o in "ab":
            own = [d for d in data if (d[0], d[2], d[3]) == (o, c.step_m, c.tolerance_m)]
            level = math.log(sum(d[6] for d in own) / sum(d[7][c.clock] for d in own))
            assert abs(got[o, c.number, "level"].value - level) < 1e-12
            assert got[o, c.number, "level"].signature.startswith(f"{len(own)}-")
            for k in ("c0", "c1"):
                of = [(d[6], d[7][c.clock]) for d in own if d[5] == k]
                center = math.log(sum(p for p, _ in of) / sum(t for _, t in of))
                spread = sum(t * abs(math.log(p / t) - center) for p, t in of) / sum(t for _, t in of)
                assert abs(got[o, c.number, f"{k}_dispersion"].value - spread) < 1e-12
    assert spark.conf.get(ALL_JOIN_KEYS, "true") == "true"
    if os.path.isdir(small):
        plans.clear()
        spark.conf.unset("spark.ridgeflow.chunkRows")
        scores.sensitivity_scores(spark, small)
        assert len(plans) == 2 and not any("ENSURE_REQUIREMENTS" in plan for plan in plans)


def test_ties_of_best_matches_do_not_depend_on_the_order_of_rows(spark):
    """of two spans of one overlap and start, whichever row came first gave its speed, and so
    the verdict; now the first end, then the least of the other columns."""
    reference = spark.createDataFrame([("a", 1, 0.0, 10.0, 5.0)], "k string, ref int, start_s double, end_s double, speed double")
    types = "k string, variant string, v_start_s double, v_end_s double, v_speed double"
    # The two ends stand as far on either side of the reference: 10 / 12.5 and 8 / 10.
    spans = [("a", "v", 0.0, 12.5, 5.0), ("a", "v", 0.0, 8.0, 7.0), ("a", "v", 0.0, 8.0, 5.1)]
    for rows in (spans, spans[::-1], [spans[1], spans[0], spans[2]]):
        variants = spark.createDataFrame(rows, types).coalesce(1)
        out = climbs.best_matches(reference.drop("speed"), variants, ["k"], cell_s=30.0)
        assert [(r.jaccard, r.v_end_s, r.v_speed) for r in out.collect()] == [(0.8, 8.0, 5.1)]
        stable = climbs.climb_stability(reference, out, ["k"], 1).first()
        assert stable.stable and abs(stable.max_deviation - 0.02) < 1e-12


def test_halves_are_rounded_as_in_sql(spark):
    """two rows of sf0.1 differed in their sixth decimal: a half that is one bit short."""
    values = [2358.1629374999997, -2358.1629374999997, 1974.6554624999999, 0.1 + 0.2, 2.5e-6, -0.5e-6, 1e-7, 1e305, -1e18, 123456789.1234565, None]
    values += [float("inf"), (72403.62083333333 / 20000 - 1) * 0.25 * 3600]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.v for r in compact(rows).orderBy("i").collect()]
    with duckdb.connect() as duck:
        want = [duck.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchall()[0][0] for v in values]
    assert got == want and got[0] == 2358.162938
    nan = compact(spark.createDataFrame([(float("nan"),)], "v double")).first().v
    assert nan != nan


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_curve_file_equals_its_sql_to_the_last_digit(spark):
    """the same on the two suppliers' rows of the table, compared without a tolerance."""
    got = {(r.l_suppkey, r.grade_pct): tuple(r.asDict().values()) for r in measures.curve_file(spark, SF).filter("l_suppkey IN (303, 585)").collect()}
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
        want = duck.execute(f"SELECT * FROM ({measures.CURVE_SQL}) WHERE l_suppkey IN (303, 585)").fetchall()
    columns = "l_suppkey grade_pct kmh hr vam_mh time_min elapsed_kmh activities shape_iqr problem".split()
    assert set(columns) == set(measures.curve_file(spark, SF).columns)
    rows = [dict(zip(columns, w, strict=True)) for w in want]
    names = measures.curve_file(spark, SF).columns
    assert len(rows) == len(got) == 12
    for row in rows:
        assert got[row["l_suppkey"], row["grade_pct"]] == tuple(row[n] for n in names)
