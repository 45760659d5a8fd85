"""Readers and writers on tiny files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ridgeflow.operators import days, experiments
from ridgeflow.sources import documents, gpx, tables

GPX = """<?xml version="1.0"?>
<gpx><wpt lat="45.001" lon="6.0"><ele>510</ele><name>Hut</name></wpt>
<trk><trkseg>
<trkpt lat="45.0" lon="6.0"><ele>500</ele><time>2024-01-01T10:00:00Z</time></trkpt>
<trkpt lat="45.001" lon="6.0"><ele>510</ele><time>2024-01-01T10:00:05Z</time></trkpt>
</trkseg><trkseg>
<trkpt lat="45.002" lon="6.0"><ele>520</ele><time>2024-01-01T10:00:05Z</time></trkpt>
<trkpt lat="45.003" lon="6.0"><ele>530</ele><time>2024-01-01T10:00:20Z</time></trkpt>
</trkseg></trk></gpx>
"""


def test_gpx(spark, tmp_path):
    (tmp_path / "one.gpx").write_text(GPX)
    (tmp_path / "two.gpx").write_text(GPX.replace("10:00:20Z", "09:00:20Z"))
    points, places = gpx.read_routes(spark, str(tmp_path / "one.gpx"))
    assert [r.ele for r in points.orderBy("seq").collect()] == [500, 510, 520, 530]
    assert [r.name for r in places.collect()] == ["Hut"]
    records, problems = gpx.read_traces(spark, str(tmp_path))
    got = records.filter("activity_ref = 'one'").orderBy("time_s").collect()
    assert [(r.time_s, r.ele) for r in got] == [(0.0, 500), (5.0, 510), (20.0, 530)]
    counts = {r.activity_ref: (r.invalid, r.repeated) for r in problems.collect()}
    assert counts == {"one": (0, 1), "two": (1, 1)}
    assert records.filter("activity_ref = 'two'").count() == 0


def test_index_and_journal(spark, tmp_path):
    entries = [
        {"activity_ref": "a", "source_activity_type": "run", "start_time": "2024-01-01T23:30:00+02:00",
         "elapsed_duration_s": 10.0, "distance_m": 5.0, "has_recording": True},
        {"activity_ref": "b", "source_activity_type": "run", "start_time": "nope"},
    ]
    (tmp_path / "index.json").write_text(json.dumps({"entries": entries}))
    kept, refused = documents.read_index(spark, str(tmp_path / "index.json"))
    row = kept.collect()[0]
    assert str(row.local_start.date()) == "2024-01-01"
    assert [r.reason for r in refused.collect()] == ["invalid_start"]
    views = documents.activity_rows(kept, {"run": "foot"}).collect()[0]
    assert (views.sport, views.refusal) == ("foot", None)
    (tmp_path / "journal.csv").write_text("start;end;type\n2024-01-01;2024-01-03;illness\n2024-01-05;;injury\nx;;injury\n")
    good, bad = documents.read_journal(spark, str(tmp_path / "journal.csv"))
    spread = days.journal_by_day(good.withColumn("k", F.lit(1)), ["k"])
    assert spread.count() == 4 and bad.count() == 1


def test_daily_exports(spark, tmp_path):
    for name, at in (("first", "2024-02-01T00:00:00Z"), ("second", "2024-03-01T00:00:00Z")):
        folder = tmp_path / name / "stress"
        folder.mkdir(parents=True)
        (tmp_path / name / "acquisition.json").write_text(json.dumps({"retrieved_at": at}))
        body = {"window_start": "2024-01-01T00:00:00Z", "data_end": "2024-01-02T00:00:00Z",
                "values": [[1704067200000, 20], [1704067380000, -1], [1704067560000, 400]]}
        (folder / "2024-01-01.json").write_text(json.dumps(body))
    exports = documents.read_exports(spark, str(tmp_path))
    assert [r.export for r in exports.orderBy("position").collect()] == ["first", "second"]
    points, discards = documents.read_series_family(spark, str(tmp_path), "stress")
    assert points.filter("value = 20").count() == 2 and points.filter("code = -1").count() == 2
    assert {(r.reason, r.points) for r in discards.collect()} == {("out_of_range", 1)}
    raw = documents.read_daily_family(spark, str(tmp_path), "stress", "data_end TIMESTAMP")
    assert documents.exports_ahead(raw, exports).count() == 0


def test_tables_and_curve(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, athlete_id string")
    tables.write_tables({"one": df, "two": df}, str(tmp_path / "t"), "p1")
    assert tables.read_tables(spark, str(tmp_path / "t"), ["one", "two"])["one"].count() == 2
    tables.write_tables({"two": df}, str(tmp_path / "t"), "p2")
    with pytest.raises(ValueError):
        tables.read_tables(spark, str(tmp_path / "t"), ["one", "two"])
    rows = spark.createDataFrame(
        [(-5.0, 5.0, None, -250.0, 30.0), (5.0, 4.0, 140.0, 200.0, 40.0)],
        "grade_pct double, kmh double, hr double, vam_mh double, time_min double",
    )
    tables.write_curve(rows, str(tmp_path / "c"), {"sport": "foot", "activity_count": 3})
    bins, note = tables.read_curve(spark, str(tmp_path / "c" / "curve"), str(tmp_path / "c" / "companion"))
    assert bins.count() == 2 and note.collect()[0].activity_count == 3
    with pytest.raises(Exception):
        tables.write_curve(rows, str(tmp_path / "c"), {})
    first = tables.fingerprint(spark, str(tmp_path / "c"), "*.csv").collect()[0]
    assert first.files == 1 and len(first.sha256) == 64


def test_chained_log(spark, tmp_path):
    path, payload = str(tmp_path / "log"), ["kind", "effect"]
    row = spark.createDataFrame([("declaration", "heat")], "kind string, effect string")
    empty = spark.createDataFrame([], "number long, previous_sha256 string, kind string, effect string")
    first = experiments.next_events(empty, row, payload)
    tables.append_events(first.withColumn("number", F.col("number").cast("long")), path)
    log = spark.read.parquet(path)
    second = experiments.next_events(log, row.withColumn("kind", F.lit("result")), payload)
    tables.append_events(second.withColumn("number", F.col("number").cast("long")), path)
    log = spark.read.parquet(path)
    assert experiments.chain_violations(log, [], payload).count() == 0
    forged = log.withColumn("effect", F.when(F.col("number") == 1, "cold").otherwise(F.col("effect")))
    assert [r.number for r in experiments.chain_violations(forged, [], payload).collect()] == [2]
