"""Activity index, daily documents, exports, manifest and journal readers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = (
    "activity_ref STRING, source_activity_type STRING, start_time STRING, "
    "elapsed_duration_s DOUBLE, moving_duration_s DOUBLE, distance_m DOUBLE, ascent_m DOUBLE, "
    "descent_m DOUBLE, average_hr_bpm DOUBLE, max_hr_bpm DOUBLE, training_load DOUBLE, "
    "has_recording BOOLEAN"
)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(kept, refused) entries of activity indexes, refused ones with their reason.

    The local civil day is that of the stamp as written, before any zone change."""
    nested = _ENTRY.replace(" STRING", ": STRING").replace(" DOUBLE", ": DOUBLE").replace(
        " BOOLEAN", ": BOOLEAN"
    )
    raw = (
        spark.read.schema(f"entries ARRAY<STRUCT<{nested}>>").option("multiLine", True).json(path)
    )
    rows = raw.select(F.inline("entries"))
    instant = F.try_to_timestamp("start_time")
    reason = F.coalesce(
        F.when(F.col("activity_ref").isNull(), "missing_reference"),
        F.when(F.col("source_activity_type").isNull(), "missing_type"),
        F.when(instant.isNull(), "invalid_start"),
        F.when(F.col("elapsed_duration_s") < 0, "negative_duration"),
        F.when(F.col("moving_duration_s") > F.col("elapsed_duration_s"), "moving_over_elapsed"),
    )
    tagged = (
        rows.withColumn("start", instant)
        .withColumn("local_start", F.substring("start_time", 1, 19).try_cast("timestamp_ntz"))
        .withColumn("reason", reason)
    )
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(
        F.col("reason").isNotNull()
    )


def activity_rows(entries: DataFrame, sports: Mapping[str, str]) -> DataFrame:
    """Index entries as activity rows, or the reason there is none."""
    known = F.create_map(*(F.lit(x) for pair in sports.items() for x in pair))
    sport = F.try_element_at(known, F.col("source_activity_type"))
    refusal = F.coalesce(
        F.when(sport.isNull(), "type"),
        F.when(F.col("elapsed_duration_s").isNull(), "missing_elapsed"),
        F.when(F.col("distance_m").isNull(), "missing_distance"),
        F.when(F.col("distance_m") < 0, "negative_distance"),
    )
    return entries.withColumn("sport", sport).withColumn("refusal", refusal)


def read_exports(spark: SparkSession, root: str) -> DataFrame:
    """Export folders with their acquisition instant and position, oldest first."""
    raw = (
        spark.read.schema("retrieved_at STRING")
        .option("multiLine", True)
        .json(f"{root}/*/acquisition.json")
    )
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/acquisition\.json$", 1)
    rows = raw.select(name.alias("export"), F.to_timestamp("retrieved_at").alias("retrieved_at"))
    from pyspark.sql import Window

    # Exports are dated folders: dozens, not data.
    return rows.withColumn(
        "position", F.row_number().over(Window.orderBy("retrieved_at", "export"))
    )


def read_daily_family(
    spark: SparkSession, root: str, family: str, schema: str
) -> DataFrame:
    """Daily files of one family of every export: ``export``, ``day`` from the path."""
    raw = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(f"{root}/*/{family}/*.json")
    )
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(path, rf"/([^/]+)/{family}/", 1).alias("export"),
        F.to_date(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})\.json$", 1)).alias("day"),
        "*",
    )


MAX_AHEAD_S = 3600


def exports_ahead(days: DataFrame, exports: DataFrame) -> DataFrame:
    """Exports whose data end more than an hour after they were acquired."""
    ends = days.groupBy("export").agg(F.max("data_end").alias("data_end"))
    late = F.unix_seconds("data_end") - F.unix_seconds("retrieved_at")
    return ends.join(exports, "export").filter(late > MAX_AHEAD_S)


def explode_series(
    rows: DataFrame,
    keys: Sequence[str],
    points: str,
    *,
    low: float,
    high: float,
    sentinels: Sequence[float] = (),
) -> tuple[DataFrame, DataFrame]:
    """(points, discards) of a ``[[milliseconds, value], ...]`` array column.

    Sentinel codes keep their code and no value; values out of range are discarded and
    counted by reason."""
    pairs = rows.select(*keys, F.explode(points).alias("_p"))
    value = F.col("_p")[1]
    coded = value.isin(*[float(s) for s in sentinels]) if sentinels else F.lit(False)
    reason = F.coalesce(
        F.when(F.col("_p")[0].isNull(), "no_instant"),
        F.when(value.isNull(), "no_value"),
        F.when(~coded & ((value < low) | (value > high)), "out_of_range"),
    )
    tagged = pairs.select(
        *keys,
        F.timestamp_millis(F.col("_p")[0].cast("long")).alias("instant"),
        F.when(~coded, value).alias("value"),
        F.when(coded, value.cast("int")).alias("code"),
        reason.alias("reason"),
    )
    kept = tagged.filter(F.col("reason").isNull()).drop("reason")
    discards = (
        tagged.filter(F.col("reason").isNotNull())
        .groupBy(*keys, "reason")
        .agg(F.count(F.lit(1)).alias("points"))
    )
    return kept, discards


# Plausible range of each daily series and its sentinel codes.
FAMILY_RANGES: Mapping[str, tuple[float, float, tuple[float, ...]]] = {
    "heart_rate": (1, 300, ()),
    "stress": (0, 100, (-1, -2)),
    "body_battery": (0, 100, ()),
    "respiration": (1, 60, (-1, -2)),
    "spo2": (50, 100, ()),
    "hrv": (1, 500, ()),
}


def read_series_family(
    spark: SparkSession, root: str, family: str
) -> tuple[DataFrame, DataFrame]:
    """Points and discards of one daily series family over all exports."""
    low, high, sentinels = FAMILY_RANGES[family]
    rows = read_daily_family(
        spark, root, family, "window_start STRING, data_end STRING, values ARRAY<ARRAY<DOUBLE>>"
    )
    return explode_series(
        rows, ["export", "day"], "values", low=low, high=high, sentinels=sentinels
    )


def read_sleep(spark: SparkSession, root: str) -> DataFrame:
    """Night of each day and export: window, stage durations, flags."""
    schema = (
        "start STRING, end STRING, deep_s DOUBLE, light_s DOUBLE, rem_s DOUBLE, awake_s DOUBLE, "
        "unmeasurable_s DOUBLE, window_confirmed BOOLEAN, from_device BOOLEAN, rem_capable BOOLEAN, "
        "segments ARRAY<STRUCT<start_s: DOUBLE, end_s: DOUBLE, stage: STRING>>"
    )
    rows = read_daily_family(spark, root, "sleep", schema)
    return (
        rows.withColumn("night_start", F.to_timestamp("start"))
        .withColumn("night_end", F.to_timestamp("end"))
        .drop("start", "end")
    )


JOURNAL_TYPES = ("illness", "injury", "altitude_stay", "travel", "alcohol", "other")


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, malformed rows) of an athlete's journal: ``start``, ``end``, ``type``.

    The separator of a file is that of its header; other files may have another."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    is_header = F.col("value").rlike(r'^\ufeff?\s*"?start"?\s*[;,]')
    headers = lines.filter(is_header).groupBy("_file").agg(F.max(F.col("value").contains(";")).alias("_semi"))
    body = lines.filter(~is_header & (F.trim("value") != "")).join(headers, "_file", "left")
    shape = "start STRING, end STRING, type STRING"
    row = F.when(F.col("_semi"), F.from_csv("value", shape, {"sep": ";"})).otherwise(
        F.from_csv("value", shape)
    )
    raw = body.select(row.alias("_row")).select("_row.*")
    start, end = F.try_to_date("start"), F.try_to_date("end")
    reason = F.coalesce(
        F.when(start.isNull(), "start"),
        F.when(F.col("end").isNotNull() & end.isNull(), "end"),
        F.when(end < start, "order"),
        F.when(~F.col("type").isin(*JOURNAL_TYPES), "type"),
    )
    tagged = raw.withColumn("reason", reason)
    good = tagged.filter(F.col("reason").isNull()).select(
        start.alias("start"), F.coalesce(end, start).alias("end"), "type"
    )
    return good, tagged.filter(F.col("reason").isNotNull())


_MANIFEST = (
    "schema_version INT, athlete_ref STRING, domain_start_date DATE, "
    "outings ARRAY<STRUCT<id: STRING, sport: STRING, traces: ARRAY<STRUCT<file: STRING>>, "
    "duplicates: ARRAY<STRUCT<file: STRING, sha256: STRING>>, route: STRING, variant: STRING, "
    "portion_m: ARRAY<DOUBLE>, reference: STRUCT<file: STRING, kind: STRING, available_at: STRING>, "
    "dataset: STRING, label: STRING>>"
)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outings, traces, duplicates) of backtest manifests."""
    raw = spark.read.schema(_MANIFEST).option("multiLine", True).json(path)
    rows = raw.select("athlete_ref", "domain_start_date", F.explode("outings").alias("o"))
    outings = rows.select(
        "athlete_ref",
        "domain_start_date",
        F.col("o.id").alias("outing_id"),
        "o.sport",
        "o.route",
        "o.variant",
        "o.portion_m",
        F.col("o.reference.file").alias("reference_file"),
        F.col("o.reference.kind").alias("reference_kind"),
        F.to_timestamp("o.reference.available_at").alias("reference_available_at"),
        "o.dataset",
        "o.label",
        F.size("o.traces").alias("trace_count"),
    )
    traces = rows.select(
        "athlete_ref", F.col("o.id").alias("outing_id"), F.posexplode("o.traces").alias("part", "_t")
    ).select("athlete_ref", "outing_id", "part", F.col("_t.file").alias("file"))
    duplicates = rows.select(
        "athlete_ref", F.col("o.id").alias("outing_id"), F.inline("o.duplicates")
    )
    return outings, traces, duplicates


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """Declared athlete settings: reference vertical speed, barometer products, period."""
    schema = (
        "athlete_ref STRING, reference_vertical_speed_ms DOUBLE, barometer_products ARRAY<INT>, "
        "discovery_start DATE, discovery_end DATE"
    )
    return spark.read.schema(schema).option("multiLine", True).json(path)


def checked(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """Rows with an assertion evaluated where they are read."""
    return df.filter(F.when(rule, True).otherwise(F.raise_error(F.lit(message)).isNull()))
