"""The four processed tables: activities, climbs, climb variants and days."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.functions import geo
from ridgeflow.operators import climbs, clocks, days, ordered, route, track
from ridgeflow.operators.climbs import ClimbRules, QualityRules
from ridgeflow.session import cut_lineage

ACTIVITY = ["activity_ref"]


@dataclass(frozen=True)
class Processed:
    activities: DataFrame
    climbs: DataFrame
    climb_variants: DataFrame


def _climbs_of(
    series: DataFrame, moves: DataFrame, keys: Sequence[str], rules: ClimbRules
) -> DataFrame:
    c = clocks.CENTRAL
    slim = moves.select(
        *keys,
        "time_s",
        "realized_m",
        "ele_s",
        F.col(f"c_t_M_{c}").alias("moving_s"),
        F.col("c_moving_m").alias("moving_m"),
    )
    profile = cut_lineage(
        ordered.without_chunks(
            route.build_profile(
                ordered.without_chunks(series).withColumn("seq", F.col("time_s")),
                keys,
                step_m=rules.grid_step_m,
                window_m=rules.smoothing_window_m,
            )
        )
    )
    spans = cut_lineage(climbs.detect_climbs(slim, profile, keys, rules))
    return climbs.measure_climbs(spans, moves, keys, rules)


def build_tables(
    records: DataFrame,
    index: DataFrame,
    keys: Sequence[str] = ACTIVITY,
    rules: ClimbRules = ClimbRules(),
    quality: QualityRules = QualityRules(),
    with_variants: bool = True,
) -> Processed:
    """Activities, climbs (with flags, strata and stability) and their variants.

    ``records``: decoded tracks; ``index``: keys, ``sport``, ``barometric`` and anything
    shown. The clocks of a track are computed once and read by the reference and by the
    twelve variants."""
    keys = list(keys)
    series = cut_lineage(track.build_series(records, keys))
    partition = cut_lineage(clocks.clock_partition(series, keys))
    moves = cut_lineage(climbs.motion(partition, keys, rules))
    facts = _track_facts(series, keys)
    drift = climbs.altimetric_drift(
        quality, F.col("closure_m"), F.col("closure_z"), F.col("duration_s")
    )
    tagged = index.join(facts, keys, "left").withColumn("altimetric_drift", drift)
    totals = clocks.totals(partition, keys).filter(F.col("convention") == clocks.CENTRAL)
    activities = tagged.join(totals.drop("convention", "elapsed_s"), keys, "left")
    side = tagged.select(*keys, "sport", "barometric", "altimetric_drift")

    def described(measured: DataFrame) -> DataFrame:
        flags = climbs.climb_flags(
            quality,
            rules.min_grade,
            barometric=F.col("barometric"),
            drift=F.col("altimetric_drift"),
            sport=F.col("sport"),
        )
        return (
            measured.join(side, keys)
            .withColumn("flags", flags)
            .withColumn("regime", climbs.climb_regime(quality, F.col("gain_m"), F.col("sport")))
            .withColumn("grade_stratum", climbs.grade_stratum(quality, rules.min_grade))
            .withColumn("altitude_stratum", climbs.altitude_stratum(quality))
            .drop("barometric", "altimetric_drift", "sport")
        )

    reference = cut_lineage(described(_climbs_of(series, moves, keys, rules)))
    if not with_variants:
        return Processed(activities, reference, reference.limit(0))
    stacked = climbs.stacked_variants(
        {
            name: described(_climbs_of(series, moves, keys, changed))
            for name, changed in climbs.variants(rules).items()
        }
    )
    variant_rows = cut_lineage(stacked)
    named = reference.withColumn("ref", F.col("start_s")).withColumn(
        "speed", F.col("vertical_speed_ms")
    )
    matches = climbs.best_matches(
        named.select(*keys, "ref", "start_s", "end_s"),
        variant_rows.select(
            *keys,
            "variant",
            F.col("start_s").alias("v_start_s"),
            F.col("end_s").alias("v_end_s"),
            F.col("vertical_speed_ms").alias("v_speed"),
        ),
        keys,
    )
    stable = climbs.climb_stability(named, matches, keys, len(climbs.variants(rules)))
    return Processed(activities, stable.drop("ref", "speed"), variant_rows)


def _track_facts(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duration, distance and closing gap of each track."""
    ends = series.groupBy(*keys).agg(
        F.min_by(F.struct("lat", "lon", "ele", "time_s"), "time_s").alias("_a"),
        F.max_by(F.struct("lat", "lon", "ele", "time_s"), "time_s").alias("_b"),
        F.max("realized_m").alias("track_m"),
        F.count(F.lit(1)).alias("records"),
    )
    return ends.select(
        *keys,
        "track_m",
        "records",
        (F.col("_b.time_s") - F.col("_a.time_s")).alias("duration_s"),
        (F.col("_b.ele") - F.col("_a.ele")).alias("closure_z"),
        geo.haversine_m(
            F.col("_a.lat"), F.col("_a.lon"), F.col("_b.lat"), F.col("_b.lon")
        ).alias("closure_m"),
    )


# Value column, scale, resolution and kind of each measure of a day.
MEASURES: dict[str, tuple[str, bool, float, bool]] = {
    "hrv": ("hrv_ms", True, 1.0, True),
    "resting_hr": ("resting_hr_bpm", False, 1.0, False),
    "measured_sleep": ("measured_sleep_s", False, 60.0, True),
    "night_stress": ("night_stress", False, 1.0, True),
    "night_respiration": ("night_respiration", False, 1.0, True),
    "night_spo2": ("night_spo2", False, 1.0, True),
}


def day_table(
    documents: DataFrame,
    entries: DataFrame,
    journal: DataFrame,
    families: dict[str, Sequence[str]],
    keys: Sequence[str] = ("athlete_id",),
    *,
    max_unmeasured: float = 0.1,
    short_sleep_s: float = 4 * 3600.0,
    shift_s: float = 3 * 3600.0,
    usual_window_days: int = 28,
    usual_min_nights: int = 7,
    min_sleep_s: float = 3 * 3600.0,
) -> DataFrame:
    """One row per calendar day with nights, statuses, activity, journal and normals.

    ``documents``: merged day documents (keys, ``day``, ``state``, night columns, ``ranks``,
    ``version`` and the measures). Absent days are rows of state ``absent``."""
    keys = list(keys)
    rows = days.on_spine(documents, keys).withColumn("state", F.coalesce("state", F.lit("absent")))
    rows = days.assess_nights(
        rows,
        keys,
        max_unmeasured=max_unmeasured,
        short_sleep_s=short_sleep_s,
        shift_s=shift_s,
        usual_window_days=usual_window_days,
        usual_min_nights=usual_min_nights,
    )
    rows = rows.withColumn("resting_hr_status", days.resting_status(min_sleep_s))
    rows = rows.join(days.activity_columns(entries, keys, families), [*keys, "day"], "left")
    rows = days.empty_day_defaults(rows, list(families))
    types = days.journal_by_day(journal, keys).withColumnRenamed("types", "journal_types")
    rows = rows.join(types, [*keys, "day"], "left").withColumn(
        "journal_types", F.coalesce("journal_types", F.array().cast("array<string>"))
    )
    rows = days.ruptures(rows, keys)
    night = (F.col("night_state"), F.col("night_short"), F.col("night_shifted"))
    for name, (column, log_scale, resolution, is_night) in MEASURES.items():
        if column not in rows.columns:
            continue
        refusal = days.admission_refusal(
            absent=F.col("state") == "absent",
            value=F.col(column),
            invalid=_invalid(name, column),
            night=night if is_night else None,
            short_admitted=name == "measured_sleep",
            journal=F.col("journal_types"),
        )
        rows = rows.withColumn(f"{name}_refusal", refusal).withColumn(
            f"{name}_admitted", F.col(f"{name}_refusal").isNull()
        )
        rules = days.NormalRules(resolution=resolution, log_scale=log_scale)
        rows = days.rolling_normals(
            rows, keys, column, f"{name}_admitted", rules, prefix=f"{name}_"
        )
    return rows


def _invalid(name: str, column: str) -> Column:
    if name == "resting_hr":
        return F.col("resting_hr_status") != "valid"
    if name == "hrv":
        return F.col(column) <= 0
    return F.lit(False)


def recovery_view(rows: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Runs of consecutive days whose normal shares its segment and straddling flag."""
    shown = rows.filter(F.col(f"{measure}_normal").isNotNull())
    return days.series_runs(shown, keys, [f"{measure}_segment", "straddles"])


def combined_summary(activities: DataFrame, day_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Activities outside the calendar of each key's days."""
    ends = day_rows.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    joined = activities.join(ends, list(keys))
    return joined.groupBy(*keys).agg(
        F.sum(F.when(F.col("day") < F.col("_a"), 1).otherwise(0)).alias("before_first_day"),
        F.sum(F.when(F.col("day") > F.col("_b"), 1).otherwise(0)).alias("after_last_day"),
    )
