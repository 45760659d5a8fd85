"""Composite plans end to end on small invented worlds, and the streaming forms."""

from __future__ import annotations

import datetime as dt
import math
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeflow.operators import climbs, curve, pace
from ridgeflow.plans import backtest, projection, questions
from ridgeflow.plans import tables as table_plans
from ridgeflow.session import cut_lineage
from ridgeflow.streaming import live

METRE = 1 / (6_371_008.8 * math.radians(1))
LON = METRE / math.cos(math.radians(45))


def _route(spark, outings=("o1", "o2", "o3")):
    rows = [
        (o, i, 45 + i * 20.0 * METRE, 6.0, 500 + (i * 2.0 if i <= 60 else 240 - i * 2.0))
        for o in outings
        for i in range(121)
    ]
    return spark.createDataFrame(rows, "outing_id string, seq int, lat double, lon double, ele double")


def _trace(spark, outings=("o1", "o2", "o3")):
    rows = []
    for n, o in enumerate(outings):
        speed, metres, t = 1.4 + 0.1 * n, 0.0, 0
        while metres < 2410:
            held = 600 <= t < 780
            metres += 0.0 if held else speed
            step = metres / 20
            ele = 500 + (step * 2.0 if step <= 60 else 240 - step * 2.0)
            rows.append((o, float(t), 45 + metres * METRE, 6.0 + 3 * LON, ele))
            t += 1
    return spark.createDataFrame(rows, "outing_id string, time_s double, lat double, lon double, ele double")


slow = pytest.mark.skipif(
    not os.environ.get("RIDGEFLOW_SLOW"), reason="minutes long: set RIDGEFLOW_SLOW=1"
)


@slow
def test_backtest_chain(spark):
    places = spark.createDataFrame(
        [(o, "Hut", 45 + 900.0 * METRE, 6.0) for o in ("o1", "o2", "o3")],
        "outing_id string, name string, lat double, lon double",
    )
    matched = backtest.match_outings(_route(spark), places, _trace(spark))
    assert matched.points.filter("status not in ('found', 'anchored')").count() == 0
    assert matched.segments.filter("exclusion is not null").count() == 0
    hut = matched.passages.filter("outing_id = 'o1'").collect()[0]
    assert hut.role == "intermediate" and hut.status == "found" and hut.comparable
    for row in matched.segment_times.collect():
        assert len(row.times) == 11
        assert math.isclose(row.times[0], row.end_s - row.start_s, rel_tol=1e-9)
    bins = spark.createDataFrame([(-0.2, 1.2), (0.0, 1.5), (0.2, 0.8)], "grade double, speed_ms double")
    models = []
    for profile in (matched.profile, matched.trace_profile):
        own = projection.curve_timelines(profile, bins, ["outing_id"]).withColumn("model", F.lit("curve"))
        models.append(
            cut_lineage(own.unionByName(pace.baseline_timelines(profile, ["outing_id"]), allowMissingColumns=True))
        )
    segments, targets = backtest.forecasts(matched, *models)
    segments, targets = cut_lineage(segments), cut_lineage(targets)
    assert targets.select("model").distinct().count() == 4
    perf = spark.createDataFrame(
        [("o1", "a", 100.0, 50.0, True, False, "d"), ("o2", "a", 200.0, 150.0, True, False, "d"),
         ("o3", "a", 300.0, 250.0, True, False, "d")],
        "outing_id string, athlete_id string, end_time double, origin double, is_training boolean, is_race boolean, dataset string",
    )
    result = backtest.evaluate(matched, segments, targets, perf)
    known = {(r.outing_id, r.model): r for r in result.calibration.collect()}
    assert known["o1", "curve"].calibration_motif == "not_calibrated"
    assert known["o3", "curve"].population == 2
    assert 0.5 <= known["o3", "curve"].effort <= 1.5
    usage = {(r.outing_id, r.model): r.usage for r in result.usage.collect()}
    assert all(v is not None and v >= 0 for v in usage.values())
    levels = result.calibrated.overall.filter("outing_id = 'o3' and clock = 0 and scenario = 'usage' and model = 'curve'")
    assert abs(levels.collect()[0].log_ratio) < 0.2
    assert result.bands.count() > 0


def test_curve_known_at_an_origin(spark):
    rows = [
        ("a", f"r{n}", (k - 10) * 0.02, 50.0, 40.0 + n, 38.0 + n, None, 3600.0)
        for n in range(8)
        for k in range(21)
        for _ in range(3)
    ]
    intervals = spark.createDataFrame(
        rows,
        "athlete_id string, activity_ref string, grade double, length_m double, elapsed_s double, moving_s double, hr_bpm double, activity_s double",
    )
    activities = spark.createDataFrame(
        [("a", f"r{n}", float(n), float(n)) for n in range(8)],
        "athlete_id string, activity_ref string, index_end double, safe_end double",
    )
    origins = spark.createDataFrame(
        [("a", 0.0, "all", None), ("a", 4.0, "all", None), ("a", 8.0, "short", 6.0)],
        "athlete_id string, origin double, window string, bound double",
    )
    rules = curve.CurveRules(support_min=1.0)
    estimate, outcome = projection.curves_at_origins(activities, origins, intervals, ["athlete_id"], rules)
    got = {(r.origin, r.window): r.outcome for r in outcome.collect()}
    assert got == {(0.0, "all"): "no_curve", (4.0, "all"): "projectable", (8.0, "short"): "projectable"}
    flat = estimate.bins.filter("abs(grade - 0.0125) < 1e-9").collect()
    speeds = {r.origin: r.speed_ms for r in flat}
    assert math.isclose(speeds[4.0], 200 / sum(38.0 + n for n in range(4)))
    assert math.isclose(speeds[8.0], 100 / sum(38.0 + n for n in (6, 7)))


def test_route_projection(spark):
    bins = spark.createDataFrame([(-0.2, 1.0), (0.0, 2.0), (0.2, 1.0)], "grade double, speed_ms double")
    points = _route(spark, ("r",)).withColumnRenamed("outing_id", "route_id")
    places = spark.createDataFrame(
        [("r", "Top", 45 + 1200.0 * METRE, 6.0), ("r", "Far", 46.0, 6.0)],
        "route_id string, name string, lat double, lon double",
    )
    passages, lines, summary = projection.project_routes(points, places, bins)
    times = {r.name: r.passage_s for r in passages.collect()}
    assert set(times) == {"start", "Top", "finish"}
    assert times["start"] == 0.0 and times["start"] < times["Top"] < times["finish"]
    row = summary.collect()[0]
    assert math.isclose(row.time_s, times["finish"], rel_tol=1e-9)
    assert math.isclose(row.length_m, 2400.0, rel_tol=1e-6)


def test_processed_tables(spark):
    records = _trace(spark, ("x",)).withColumnRenamed("outing_id", "activity_ref")
    index = spark.createDataFrame([("x", "foot", True)], "activity_ref string, sport string, barometric boolean")
    out = table_plans.build_tables(records, index, with_variants=False)
    rows = out.climbs.collect()
    assert len(rows) == 1
    climb = rows[0]
    assert 115 < climb.gain_m < 121 and abs(climb.grade - 0.1) < 0.01
    assert abs(climb.vertical_speed_ms - 0.14) < 0.01
    assert climb.regime == "intermediate" and climb.grade_stratum == "moderate"
    assert out.activities.collect()[0].stopped_s > 100
    assert len(climbs.variants(climbs.ClimbRules())) == 12


def test_day_table(spark):
    first = dt.date(2024, 1, 1)
    rows = []
    for i in (*range(0, 40), 42):
        day = first + dt.timedelta(days=i)
        start = dt.datetime.combine(day, dt.time(0, 30))
        rows.append(
            ("a", day, "complete", start, start + dt.timedelta(hours=7), start + dt.timedelta(hours=24), True, True,
             60.0, 7200.0, 9000.0, 3600.0, True, 1800.0 + 12000, 48.0 + i % 2, [1], 1, 60.0 + i % 3)
        )
    documents = spark.createDataFrame(
        rows,
        "athlete_id string, day date, state string, night_start timestamp, night_end timestamp, data_end timestamp, "
        "window_confirmed boolean, from_device boolean, unmeasurable_s double, deep_s double, light_s double, rem_s double, "
        "rem_capable boolean, midpoint_s double, resting_hr_bpm double, ranks array<int>, version int, hrv_ms double",
    )
    entries = spark.createDataFrame(
        [("a", first, "run", 3600.0, 50.0), ("a", first, "yoga", None, None)],
        "athlete_id string, day date, activity_type string, elapsed_s double, load double",
    )
    journal = spark.createDataFrame(
        [("a", dt.date(2024, 1, 5), dt.date(2024, 1, 6), "illness")], "athlete_id string, start date, end date, type string"
    )
    out = table_plans.day_table(documents, entries, journal, {"foot": ["run"]}).orderBy("day").collect()
    assert len(out) == 43 and out[41].state == "absent"
    assert out[0].activity_count == 2 and out[0].foot_elapsed_s == 3600.0 and out[1].training_load == 0.0
    assert out[4].hrv_refusal == "illness" and out[20].resting_hr_status == "valid"
    assert out[30].resting_hr_normal in (48.0, 48.5, 49.0)
    assert out[30].night_state == "complete" and out[30].night_shifted is False


def test_trials_find_the_slope(spark):
    rows = [
        (i, i // 30, 1.0, float(i), math.sin(i), 0.001 * i + 0.2 * math.sin(i) + 0.01 * math.cos(7 * i))
        for i in range(300)
    ]
    design = spark.createDataFrame(rows, "day int, month_no int, one double, date double, grade double, y double")
    trials = [questions.Trial("S-MP-ski", None), questions.Trial("late", None, F.expr("day > 150"))]
    out = {r.trial: r for r in questions.efficiency_trials(design, ["one", "date", "grade"], trials).collect()}
    assert abs(out["S-MP-ski"].slope - 0.001) < 1e-4 and out["S-MP-ski"].rejected
    assert abs(out["late"].slope - 0.001) < 1e-4 and out["late"].rejected is None
    residuals, band = questions.trend_figure(design, ["one", "date", "grade"], 11, draws=30)
    for r in band.collect():
        assert r.low < r.estimate < r.high


def test_the_24_trials_in_their_order_and_holm_over_five(spark):
    assert [t.name for t in questions.declared_trials()] == list(questions.TRIAL_NAMES)
    assert len(questions.TRIAL_NAMES) == 24 and len(questions.HOLM_FAMILY) == 5
    rows = []
    for regime, shift in (("long_climb", 0), ("short_climb", 1), ("ski_touring", 2)):
        for i in range(90):
            hr = 140 + 5 * math.sin(i * 1.7 + shift)
            y = 0.002 * i + 0.01 * hr + 0.01 * math.cos(7 * i + shift)
            rows.append((regime, i, i // 6, 1.0, float(i), hr, hr + 1, y, y / 2, "discovery" if i < 45 else "after", True, False))
    schema = (
        "regime string, day int, month_no int, one double, date double, hr double, hr_unlagged double, "
        "y double, y_ms double, period string, all_stable boolean, any_slow boolean"
    )
    design = spark.createDataFrame(rows, schema)
    some = [t for t in questions.declared_trials(["one", "date", "hr"]) if t.name not in ("S14",)]
    out = {r.trial: r for r in questions.efficiency_trials(design, ["one", "date", "hr"], some, eta=0.01).collect()}
    for name in ("P", "S1", "S4", "S8", "S9", "S11", "S17", "S18"):
        assert abs(out[name].slope - 0.002) < 2e-4, name
    assert abs(out["S-MS-longues"].slope - 0.001) < 1e-4 and abs(out["S19"].slope - 0.005) < 1e-3
    assert {n for n, r in out.items() if r.rejected is not None} == set(questions.HOLM_FAMILY)
    assert out["S2"].reason == out["S13"].reason == "missing_column"
    found = questions.residual_autocorrelation(design, ["one", "date", "hr"]).collect()
    assert {r.regime for r in found} == {"long_climb", "short_climb", "ski_touring"} and len(found) == 12


def _drain(stream, mode, name):
    """Runs a stream over what is there; processing-time timers would keep it alive."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name)
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(60)


def test_live_blocks_and_stops(spark, tmp_path):
    source = str(tmp_path / "in")
    start = dt.datetime(2024, 1, 1)
    rows = [
        ("a", start + dt.timedelta(seconds=s), float(s), 100 <= s < 180)
        for s in [*range(0, 200, 5), *range(211, 400, 5)]
    ]
    spark.createDataFrame(
        pd.DataFrame(rows, columns=["activity_ref", "ts", "time_s", "immobile"])
    ).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    blocks = live.live_blocks(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    _drain(blocks, "complete", "blocks")
    assert sorted(r.records for r in spark.sql("select records from blocks").collect()) == [38, 40]
    assert os.path.isdir(source)


def _stops(records, min_stop_s):
    """Runs of one activity's (time, immobile) records, in order, as the batch rule has them."""
    out, run = [], []
    for t, immobile in [*sorted(records), (float("inf"), False)]:
        if run and (not immobile or t - run[-1] > 10):
            end = run[-1] if t - run[-1] > 10 else t
            if end - run[0] >= min_stop_s:
                out.append((run[0], end))
            run = []
        if immobile:
            run.append(t)
    return out


def test_live_stops_over_shuffled_batches(spark, tmp_path):
    """Records out of order within the delay, over many batches, give the runs of the batch rule;
    activities that end are closed and their state goes."""
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    records = {}
    for name, length in (("a", 900), ("b", 400), ("c", 120)):
        at, still, rows = 0.0, False, []
        while at < length:
            rows.append((at, still))
            still = still if rng.random() < 0.93 else not still
            at += rng.choice([1.0, 4.5, 5.0, 10.0, 10.001] if rng.random() < 0.9 else [25.0])
        records[name] = rows
    records["clock"] = [(t, False) for t in (0.0, 3000.0)]  # moves the watermark on
    rows = [(n, start + dt.timedelta(seconds=t), t, i) for n, own in records.items() for t, i in own]
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 50))
    schema = "activity_ref string, ts timestamp, time_s double, immobile boolean"
    source = tmp_path / "in"
    size = -(-len(rows) // 8)
    for n in range(8):
        part = spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1)
        part.write.parquet(str(source / f"part={n}"))
    files = sorted(source.glob("part=*/*.parquet"))
    for n, file in enumerate(files):
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    try:
        given = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
        stops = live.live_stops(given, 8.0)
        query = stops.writeStream.outputMode("append").format("memory").queryName("stops")
        query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted((r.activity_ref, r.start_s, r.end_s) for r in spark.sql("select * from stops").collect())
    want = sorted((n, *run) for n, own in records.items() for run in _stops(own, 8.0))
    assert got == want and len(want) > 5
    assert kept <= 8  # what the last record of the clock leaves, against some 250 records
