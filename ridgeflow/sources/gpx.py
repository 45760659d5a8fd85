"""GPX routes and traces through Spark's XML source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeflow.operators import ordered

_POINT = "_lat DOUBLE, _lon DOUBLE, ele DOUBLE, time STRING"
_GPX = (
    f"trk ARRAY<STRUCT<name: STRING, trkseg: ARRAY<STRUCT<trkpt: ARRAY<STRUCT<{_POINT.replace(' DOUBLE', ': DOUBLE').replace(' STRING', ': STRING')}>>>>>>, "
    "wpt ARRAY<STRUCT<_lat: DOUBLE, _lon: DOUBLE, ele: DOUBLE, name: STRING, type: STRING, sym: STRING, desc: STRING>>"
)


def _documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per GPX file, with its name as identifier."""
    paths = path if isinstance(path, str) else ",".join(path)
    raw = spark.read.format("xml").option("rowTag", "gpx").schema(_GPX).load(paths)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.gpx$", 1)
    return raw.select(name.alias("route_id"), "trk", "wpt")


def _points(documents: DataFrame) -> DataFrame:
    known = lambda x: x.isNotNull()
    # All points of all segments of all tracks in the order of the document.
    segments = F.flatten(F.filter(F.transform("trk", lambda t: t["trkseg"]), known))
    points = F.flatten(F.filter(F.transform(segments, lambda s: s["trkpt"]), known))
    rows = documents.select("route_id", F.posexplode(points).alias("_k", "_p"))
    return rows.select(
        "route_id",
        F.col("_k").cast("long").alias("seq"),
        F.col("_p._lat").alias("lat"),
        F.col("_p._lon").alias("lon"),
        F.col("_p.ele").alias("ele"),
        F.col("_p.time").alias("time"),
    )


def read_routes(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(points, places) of prepared routes: all track segments in order, and waypoints."""
    documents = _documents(spark, path)
    places = documents.select("route_id", F.inline("wpt")).select(
        "route_id",
        "name",
        F.col("_lat").alias("lat"),
        F.col("_lon").alias("lon"),
        "ele",
        "type",
        "sym",
        "desc",
    )
    return _points(documents).drop("time"), places


def read_traces(
    spark: SparkSession, path: str | Sequence[str], group: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(records, problems) of realized traces.

    Records have seconds from the first instant; a record at an instant already seen is
    dropped and counted. Problems: traces with a missing or decreasing time or position.
    ``group`` (a regular expression with one group on the file name) joins several files
    of one activity in name order."""
    points = _points(_documents(spark, path))
    if group is not None:
        points = points.withColumn("_file", F.col("route_id")).withColumn(
            "route_id", F.regexp_extract("route_id", group, 1)
        )
    else:
        points = points.withColumn("_file", F.col("route_id"))
    stamped = points.withColumn("ts", F.to_timestamp("time")).withColumn(
        "_at", F.unix_micros("ts")
    )
    # Order of the documents: file name, then position.
    back = ordered.shift(
        stamped.withColumn("_file_no", F.dense_rank().over(_by_file())),
        ["route_id"],
        ["_file_no", "seq"],
        {"_before": F.col("_at")},
    )
    broken = (
        F.col("_at").isNull()
        | F.col("lat").isNull()
        | F.col("lon").isNull()
        | F.col("ele").isNull()
        | (F.col("_at") < F.col("_before"))
    )
    problems = back.groupBy(F.col("route_id").alias("activity_ref")).agg(
        F.sum(F.when(broken, 1).otherwise(0)).alias("invalid"),
        (F.count("_at") - F.count_distinct("_at")).alias("repeated"),
    )
    refused = problems.filter(F.col("invalid") > 0).select(F.col("activity_ref").alias("route_id"))
    kept = stamped.join(refused, "route_id", "left_anti")
    unique = kept.groupBy(F.col("route_id").alias("activity_ref"), "_at").agg(
        F.min_by(F.struct("lat", "lon", "ele", "ts"), F.struct("_file", "seq")).alias("_p")
    )
    first = unique.groupBy("activity_ref").agg(F.min("_at").alias("_t0"))
    records = unique.join(first, "activity_ref").select(
        "activity_ref",
        ((F.col("_at") - F.col("_t0")) / 1e6).alias("time_s"),
        "_p.lat",
        "_p.lon",
        "_p.ele",
        "_p.ts",
    )
    return records, problems


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("route_id").orderBy("_file")


def trace_as_route(records: DataFrame) -> DataFrame:
    """A trace reused as a route."""
    return records.select(
        F.col("activity_ref").alias("route_id"),
        F.col("time_s").alias("seq"),
        "lat",
        "lon",
        "ele",
    )
