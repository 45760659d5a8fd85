"""Thresholds of the rules on tiny hand-computable tables."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeflow.functions import civil, geo, grades, student
from ridgeflow.operators import (
    clocks,
    curve,
    days,
    effects,
    matching,
    origin,
    pace,
    passages,
    route,
    scoring,
    track,
    trend,
)

METRE = 1 / 111195.07973436875


def _one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).collect()[0]


def test_hole_is_strictly_above_ten_seconds(spark):
    rows = spark.createDataFrame([("a", t) for t in (0.0, 10.0, 20.001, 25.0)], "k string, time_s double")
    out = track.with_blocks(rows, ["k"]).orderBy("time_s").collect()
    assert [r.block for r in out] == [0, 0, 1, 1]


def _track(spark, seconds, pause=(100, 300), speed=1.5):
    def metres(t):
        held = min(max(t - pause[0], 0), pause[1] - pause[0])
        return (t - held) * speed

    rows = [("a", float(t), 45 + metres(t) * METRE, 6.0, 500 + metres(t) * 0.1) for t in range(seconds)]
    return spark.createDataFrame(rows, "k string, time_s double, lat double, lon double, ele double")


def test_clocks_sum_to_elapsed(spark):
    series = track.build_series(_track(spark, 500), ["k"])
    totals = clocks.totals(clocks.clock_partition(series, ["k"]), ["k"]).collect()
    assert len(totals) == 5
    for row in totals:
        assert math.isclose(row.moving_s + row.stopped_s + row.undetermined_s, 499.0)
        assert 150 < row.stopped_s < 200
        assert row.elapsed_s == 499.0


@pytest.mark.parametrize("length, stopped", [(60.0, True), (59.0, False)])
def test_stop_needs_its_whole_duration(spark, length, stopped):
    rows = [("a", 0.0, 5.0, False), ("a", 5.0, 5.0 + length, True), ("a", 5.0 + length, 99.0, False)]
    steps = spark.createDataFrame(rows, "k string, time_s double, end_s double, still boolean")
    runs = clocks.confirm(steps, ["k"], "time_s", "end_s", F.col("still"), "run")
    judged = F.when(F.col("still"), clocks.IMMOBILE).otherwise(clocks.MOBILE)
    state = clocks.state_of(judged, F.col("run_start"), F.col("run_end"), 60.0)
    got = [r.s for r in runs.select("time_s", state.alias("s")).orderBy("time_s").collect()]
    assert got == ["M", "S" if stopped else "U", "M"]


def test_span_clocks_are_additive(spark):
    series = track.build_series(_track(spark, 400), ["k"])
    partition = clocks.clock_partition(series, ["k"]).cache()
    spans = spark.createDataFrame(
        [("a", 1, 0.0, 150.5), ("a", 2, 150.5, 399.0), ("a", 3, 0.0, 399.0)], "k string, n int, a double, b double"
    )
    out = {r.n: r.times for r in clocks.span_clocks(spans, partition, ["k"], "a", "b").collect()}
    assert np.allclose(np.add(out[1], out[2]), out[3])
    assert out[3][0] == 399.0


def test_grade_rules(spark):
    row = _one(
        spark,
        flat=grades.grade_regime(F.lit(0.05)),
        up=grades.grade_regime(F.lit(0.0501)),
        pure=grades.regime_class(F.lit(0.8), F.lit(0.2), F.lit(0.0)),
        mixed=grades.regime_class(F.lit(0.7999), F.lit(0.2001), F.lit(0.0)),
        low=grades.bin_index(F.lit(-1.0)),
        out=grades.bin_index(F.lit(1.0)),
        mid=grades.bin_index(F.lit(0.0)),
    )
    assert (row.flat, row.up, row.pure, row.mixed) == ("flat", "ascent", "ascent", "mixed")
    assert (row.low, row.out, row.mid) == (0, None, grades.BIN_EDGES_PERMILLE.index(0))
    assert len(grades.BIN_EDGES_PERMILLE) == 39


def test_grid_ends_at_the_length(spark):
    for metres, want in ((120.0, [0.0, 50.0, 120.0]), (130.0, [0.0, 50.0, 100.0, 130.0]), (30.0, [0.0, 30.0])):
        line = spark.createDataFrame(
            [("r", 0.0, metres, 10.0, 20.0)], "k string, a_m double, b_m double, a_ele double, b_ele double"
        )
        grid = route.regular_grid(line, ["k"], 50.0).orderBy("i").collect()
        assert [r.distance_m for r in grid] == want
        assert [r.i for r in grid] == list(range(len(want)))
        assert grid[-1].raw_m == 20.0


def test_pace_is_exact_on_knots_and_continuous(spark):
    g, v = (-0.1, 0.0, 0.2), (1.0, 2.0, 0.5)
    knots = pace.literal_knots(g, v)
    for x, want in ((-0.1, 1.0), (0.0, 0.5), (0.2, 2.0), (0.1, 1.25), (0.4, 4.0), (-0.2, 2.0)):
        row = _one(
            spark, a=pace.curve_pace(F.lit(x), knots), b=pace.literal_curve_pace(F.lit(x), g, v)
        )
        assert math.isclose(row.a, want) and math.isclose(row.b, want)


def test_support_stops_at_the_first_thin_bin(spark):
    bins = spark.createDataFrame(
        [(-0.2, 50.0), (-0.1, 1.0), (-0.05, 20.0), (0.0, 20.0), (0.05, 20.0), (0.2, 20.0)],
        "grade double, time_min double",
    )
    out = {r.grade: r for r in curve.select_support(bins, [], 10.0).collect()}
    assert [g for g in sorted(out) if out[g].kept] == [-0.05, 0.0, 0.05, 0.2]
    assert out[-0.1].discard_reason == "low_support"
    assert out[-0.2].discard_reason == "outside_range"
    thin = bins.withColumn("time_min", F.when(F.col("grade") == 0, 1.0).otherwise(F.col("time_min")))
    assert curve.select_support(thin, [], 10.0).first().curve_error == "core_below_threshold"


def test_geometry(spark):
    share, offset = geo.foot_on_segment(
        *(F.lit(x) for x in (45.0, 6.0, 45.001, 6.0, 45.0005, 6.0001))
    )
    row = _one(spark, d=geo.haversine_m(*(F.lit(x) for x in (45.0, 6.0, 46.0, 6.0))), s=share, o=offset)
    assert math.isclose(row.d, geo.EARTH_RADIUS_M * math.radians(1), rel_tol=1e-12)
    assert math.isclose(row.s, 0.5, abs_tol=1e-9)
    assert math.isclose(row.o, 111195.0797 * math.cos(math.radians(45)) * 0.0001, rel_tol=1e-6)


def test_crossings_rules(spark):
    row = _one(
        spark,
        a=matching.crosses(F.lit(0.0), F.lit(1.0), F.lit(False)),
        b=matching.crosses(F.lit(-1.0), F.lit(0.0), F.lit(False)),
        c=matching.crosses(F.lit(-1.0), F.lit(0.0), F.lit(True)),
        d=matching.crosses(F.lit(0.0), F.lit(0.0), F.lit(True)),
    )
    assert (row.a, row.b, row.c, row.d) == (True, False, True, False)


def test_attribution_ties(spark):
    rows = [(1, 10, 5.0, 3.0), (1, 11, 6.0, 2.0), (1, 12, 6.1, 0.0), (2, 20, 1.0, 5.0), (2, 21, 1.0, 6.0)]
    df = spark.createDataFrame(rows, "e int, rank int, delay_s double, away_m double")
    out = {r.e: (r.outcome, r.passage) for r in passages.attribute(df, ["e"]).collect()}
    assert out == {1: ("tie", None), 2: ("tie", None)}
    clear = df.withColumn("away_m", F.when(F.col("rank") == 11, 0.5).otherwise(F.col("away_m")))
    assert {r.e: r.passage for r in passages.attribute(clear, ["e"]).collect()}[1] == 11


def test_origin_is_paris_midnight_across_clock_changes(spark):
    row = _one(
        spark,
        o=F.unix_seconds(civil.origin(F.lit(dt.date(2026, 4, 6)))),
        ok=civil.is_origin(civil.midnight(F.lit(dt.date(2026, 3, 29)))),
        low=F.unix_seconds(civil.window_bound(civil.midnight(F.lit(dt.date(2026, 3, 30))), F.lit(7))),
    )
    assert dt.datetime.fromtimestamp(row.o, dt.UTC) == dt.datetime(2026, 3, 29, 22, tzinfo=dt.UTC)
    assert dt.datetime.fromtimestamp(row.low, dt.UTC) == dt.datetime(2026, 3, 22, 23, tzinfo=dt.UTC)
    assert row.ok


def test_an_activity_ending_at_the_origin_is_after_it(spark):
    row = _one(
        spark,
        at=origin.decide(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(None).cast("double")),
        late=origin.decide(F.lit(4.0), F.lit(5.0), F.lit(5.0), F.lit(1.0)),
        bound=origin.decide(F.lit(1.0), F.lit(1.0), F.lit(5.0), F.lit(1.0)),
        old=origin.decide(F.lit(0.5), F.lit(0.5), F.lit(5.0), F.lit(1.0)),
        gone=origin.decide(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(5.0), F.lit(1.0)),
    )
    assert list(row) == ["after_origin", "after_origin", "candidate", "before_window", "unknown_end"]


def test_normals_never_read_their_own_day(spark):
    day0 = dt.date(2024, 1, 1)
    rows = [("a", day0 + dt.timedelta(days=i), 50.0 + i % 3, True) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, day date, v double, ok boolean")
    rules = days.NormalRules()
    out = days.rolling_normals(df, ["k"], "v", "ok", rules).orderBy("day").collect()
    assert [r.absence for r in out[:15]] == ["no_admitted_day"] + ["too_few_admitted_days"] * 13 + [None]
    wild = df.withColumn("v", F.when(F.col("day") >= F.lit(rows[15][1]), 999.0).otherwise(F.col("v")))
    again = days.rolling_normals(wild, ["k"], "v", "ok", rules).orderBy("day").collect()
    assert out[15].normal == again[15].normal


def test_score_motifs(spark):
    rows = [("a", 1.0, 2.0, "x"), ("a", 1.0, 0.0, "y"), ("b", None, 2.0, "x"), ("c", 1.0, 0.0, "x")]
    df = spark.createDataFrame(rows, "k string, p double, t double, klass string")
    out = {r.k: r for r in scoring.support_scores(df, ["k"]).overall.collect()}
    assert out["a"].log_ratio == 0.0 and out["a"].vector_motif == "zero_time"
    assert out["b"].level_motif == "model_error" and out["b"].model_error
    assert out["c"].level_motif == "zero_time" and out["c"].log_ratio is None


def test_student():
    assert math.isclose(student.quantile(0.975, 10), 2.228138851964939, rel_tol=1e-9)
    assert math.isclose(student.quantile(0.8, 1), 1.3763819204711734, rel_tol=1e-9)
    assert math.isclose(student.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-9)


def _clustered(spark, clusters=14, size=9):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(clusters):
        effect = rng.normal()
        for _ in range(size):
            x = rng.normal()
            rows.append((g, 1.0, float(x), float(2 + 0.5 * x + effect + rng.normal())))
    df = spark.createDataFrame(rows, "g int, one double, x double, y double")
    return df, np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows]), np.array([r[0] for r in rows])


def test_linear_and_clustered_inference(spark):
    df, x, y, g = _clustered(spark)
    fit = trend.ols(df, ["one", "x"], "y")
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(fit.coef, coef)
    bread = np.linalg.inv(x.T @ x)
    meat = np.zeros((2, 2))
    for k in np.unique(g):
        xg, eg = x[g == k], (y - x @ coef)[g == k]
        w, v = np.linalg.eigh(np.eye(len(eg)) - xg @ bread @ xg.T)
        s = xg.T @ ((v / np.sqrt(w)) @ v.T @ eg)
        meat += np.outer(s, s)
    assert np.allclose(trend.cr2_cov(df, fit, "y", "g"), bread @ meat @ bread)
    one = trend.wild_cluster_interval(df, fit, "y", "g", 1, 0.9, 99, 5)
    two = trend.wild_cluster_interval(df.repartition(3), fit, "y", "g", 1, 0.9, 99, 5)
    assert np.allclose(one, two)
    assert one[0] < coef[1] < one[1]


def test_huber_resists_an_outlier(spark):
    rows = [(1.0, float(i), 3.0 + 2.0 * i + (-1) ** i * 0.1) for i in range(30)] + [(1.0, 15.0, 500.0)]
    df = spark.createDataFrame(rows, "one double, x double, y double")
    fit, scale, _ = trend.huber(df, ["one", "x"], "y", tolerance=1e-8)
    assert abs(fit.coef[1] - 2.0) < 0.01 and scale < 0.5


def test_two_way_fit_is_certified(spark):
    rows = [(u, k, 1.0 * u + 0.3 * k) for u in range(4) for k in range(5) if (u + k) % 4]
    cells = spark.createDataFrame(rows, "u int, k int, y double")
    levels, segments, _, ok = effects.two_way_fit(cells, [], "u", "k", "y")
    c = {r.u: r.c for r in levels.collect()}
    a = {r.k: r.a for r in segments.collect()}
    assert ok and all(abs(c[u] + a[k] - y) < 1e-6 for u, k, y in rows)


def _folds_by_least_squares(rows, parts_of):
    """Levels of every fold by dense least squares, centred in each part; nothing shared."""
    out = {}
    days = sorted({d for d, _, _ in rows})
    for j in days:
        train = [r for r in rows if r[0] != j and r[2] is not None]
        for part in parts_of(train):
            own = [r for r in train if r[0] in part]
            ds, ks = sorted(part), sorted({k for _, k, _ in own})
            x = np.zeros((len(own) + 1, len(ds) + len(ks)))
            y = np.zeros(len(own) + 1)
            for n, (d, k, v) in enumerate(own):
                x[n, ds.index(d)] = x[n, len(ds) + ks.index(k)] = 1
                y[n] = v
            x[-1, : len(ds)] = 1  # day levels sum to nil
            fit = np.linalg.lstsq(x, y, rcond=None)[0]
            for d, k, _ in rows:
                if d == j and k in ks:
                    out[j, k] = (fit[len(ds) + ks.index(k)], min(part))
    return out


def _parts(train):
    left = {d for d, _, _ in train}
    while left:
        part = {min(left)}
        while True:
            segments = {k for d, k, _ in train if d in part}
            more = {d for d, k, _ in train if k in segments}
            if more == part:
                break
            part = more
        left -= part
        yield part


@pytest.mark.parametrize("chunk", [2, 2000])
def test_downdated_folds_are_least_squares_without_the_day(spark, chunk):
    import random

    rng = random.Random(11)
    rows = []
    for route in ("r", "s"):
        for d in range(7):
            for k in range(12):
                # Two days of route s share nothing with the others but through day 0.
                own = k >= 8 if route == "s" and d >= 5 else k < 8 if route == "s" and d else True
                if own and rng.random() < 0.7:
                    rows.append((route, d, k, None if rng.random() < 0.08 else rng.gauss(0.3 * d + k, 0.4)))
    table = spark.createDataFrame(rows, "route string, day int, k int, y double").repartition(3)
    got = effects.downdated_folds(table, ["route"], chunk_segments=chunk).collect()
    found = {(r.route, r.fold, r.k): r for r in got}
    want = {}
    for route in ("r", "s"):
        own = [r[1:] for r in rows if r[0] == route]
        want |= {(route, *key): v for key, v in _folds_by_least_squares(own, _parts).items()}
    assert found.keys() == want.keys()
    assert all(abs(found[key].a - a) < 1e-9 for key, (a, _) in want.items())
    # Parts: equal where least squares has one part, different where it has two.
    for route, fold in {(r, j) for r, j, _ in want}:
        keys = [key for key in want if key[:2] == (route, fold)]
        assert len({found[key].part for key in keys}) == len({want[key][1] for key in keys})
    assert any(len({want[key][1] for key in want if key[:2] == ("s", j)}) > 1 for j in range(7))


def test_leave_one_day_out_with_few_and_many_days(spark):
    """Routes beyond the bound on days alternate; scores and motifs are the same."""
    import random

    rng = random.Random(4)
    rows = [("r", d, k, math.exp(rng.gauss(0.2 * d, 0.1) + 0.1 * k), "flat" if k < 3 else "ascent") for d in range(5) for k in range(6) if (d + 2 * k) % 5]
    rows += [("s", d, k, 0.0 if (d, k) == (1, 1) else 10.0 + d + k, "flat") for d, k in [(0, 0), (1, 0), (0, 1), (1, 1), (2, 2), (3, 2), (0, 2)]]
    table = spark.createDataFrame(rows, "route string, day int, k int, t double, klass string")
    shown = []
    for bound in (64, 3):
        classes, means = effects.leave_one_day_out(table, ["route"], fold_days=bound)
        shown.append(
            (
                sorted(str([r[c] if not isinstance(r[c], float) else round(r[c], 5) for c in sorted(classes.columns)]) for r in classes.collect()),
                sorted((r.route, r.klass, r.folds) for r in means.collect()),
            )
        )
    assert shown[0] == shown[1]
    assert any("not_identified" in c for c in shown[0][0])


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12) if i != 5] + [(20, 21)], "a int, b int")
    got = {r.node: r.component for r in effects.components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(6)) and all(got[i] == 6 for i in range(6, 13))
    assert got[21] == 20


def test_route_links_connect_like_all_pairs_and_stay_few(spark):
    import random

    from ridgeflow.operators import panel

    same = [("u", i, 500.0, 45.0, 6.0, 45.1, 6.1) for i in range(2000)]
    schema = "user string, climb_id long, gain_m double, start_lat double, start_lon double, end_lat double, end_lon double"
    links = panel.route_links(spark.createDataFrame(same, schema), ["user"], 100.0, 1.1)
    assert links.count() == 1999

    rng = random.Random(1)
    step = 60 / 111_195
    rows = [
        ("u", i, 300 * 1.07 ** rng.randint(0, 6), *(base + rng.randint(0, 6) * step for base in (45, 6, 45.1, 6.1)))
        for i in range(150)
    ]

    def metres(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    def connected(pairs):
        root = {r[1]: r[1] for r in rows}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {i: find(i) for i in root}

    brute = [
        (a[1], b[1])
        for a in rows
        for b in rows
        if a[1] < b[1]
        and metres(a[3:5], b[3:5]) < 100
        and metres(a[5:7], b[5:7]) < 100
        and max(a[2], b[2]) / min(a[2], b[2]) <= 1.1
    ]
    got = panel.route_links(spark.createDataFrame(rows, schema), ["user"], 100.0, 1.1).collect()
    assert connected([(r["a"], r["b"]) for r in got]) == connected(brute)
    assert len(brute) > 20


def test_prefix_ranks_beyond_sixteen_bits_and_edges_of_bins(spark):
    import bisect

    from pyspark.sql import functions as F

    from ridgeflow.functions.grades import BIN_EDGES_PERMILLE, bin_index
    from ridgeflow.operators import calibration

    points = spark.range(70_000).select(
        F.lit("k").alias("k"), F.col("id").alias("at"), (F.col("id") * 7919 % 70_000).cast("double").alias("v")
    )
    probes = spark.createDataFrame([("k", 70_000), ("k", 69_000)], "k string, at long")
    got = {
        r["at"]: r
        for r in calibration.prefix_ranks(probes, points, ["k"], "at", "at", "v", {"q": (9, 10)}).collect()
    }
    for at, r in got.items():
        known = sorted(float(i * 7919 % 70_000) for i in range(at))
        assert (r["n_known"], r["q"]) == (at, known[-(-at * 9 // 10) - 1])

    edges = [e / 1000 for e in BIN_EDGES_PERMILLE]
    grades = [g for e in edges for g in (math.nextafter(e, -9), e, math.nextafter(e, 9))]
    frame = spark.createDataFrame([(g,) for g in grades], "g double")
    for r in frame.select("g", bin_index(F.col("g")).alias("b")).collect():
        inside = edges[0] <= r["g"] < edges[-1]
        assert r["b"] == (bisect.bisect_right(edges, r["g"]) - 1 if inside else None)
