"""Speed-by-grade curve estimated from the intervals of many activities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeflow.functions import grades
from ridgeflow.operators import clocks, lookup, ordered, pace, quantiles, route, track
from ridgeflow.session import cut_lineage


@dataclass(frozen=True)
class CurveRules:
    """Thresholds of the estimation (m/s, s, bpm); ``value`` is pooled or median."""

    max_elapsed_speed_ms: float = 25 / 3.6
    max_ascent_speed_ms: float = 2500 / 3600
    max_descent_speed_ms: float = 5000 / 3600
    hr_center_bpm: float | None = None
    hr_width_bpm: float = 10.0
    hr_min_grade: float = -0.05
    hr_lag_s: float = 60.0
    hr_min_coverage: float = 0.8
    median_min_moving_s: float = 60.0
    shape_min_moving_s: float = 120.0
    shape_min_activities: int = 5
    value: str = "pooled"
    min_duration_s: float | None = None
    max_duration_s: float | None = None
    max_elapsed_s: float | None = None
    support_min: float = 10.0


# Fixed value: smallest distance to the flat of both ends of a support (fraction).
MIN_EDGE_GRADE = 0.01
# Decimals of a metre to which abscissas of one track are told apart.
PLACE_DIGITS = 6


def activity_intervals(
    records: DataFrame,
    keys: Sequence[str],
    heart_rate: DataFrame | None,
    rules: CurveRules,
    *,
    step_m: float = route.GRID_STEP_M,
    window_m: float = route.SMOOTHING_WINDOW_M,
) -> DataFrame:
    """Grid intervals of each activity with moving / stopped / unknown time.

    The activity's own profile gives lengths and grades; the instant of each grid
    abscissa is read on the realized distance, a stop keeping its last instant; the
    first and last bounds are those of the track."""
    series = track.build_series(records, keys)
    partition = clocks.clock_partition(series, keys)
    profile = route.build_profile(
        records.withColumn("seq", F.col("time_s")), keys, step_m=step_m, window_m=window_m
    )
    bounds = series.groupBy(*keys).agg(
        F.min("time_s").alias("_first_s"), F.max("time_s").alias("_last_s")
    )
    # Sums of haversine steps carry rounding noise: abscissas that are equal but for it are one
    # place, whose last instant counts.
    slim = ordered.without_chunks(series).select(
        *keys, "time_s", F.round("realized_m", PLACE_DIGITS).alias("realized_m")
    )
    for place in ("distance_m", "end_m"):
        profile = profile.withColumn(place, F.round(place, PLACE_DIGITS))
    timed = lookup.interpolated_at(
        ordered.without_chunks(profile),
        slim,
        keys,
        "distance_m",
        "realized_m",
        ["realized_m", "time_s"],
        ["time_s"],
    )
    timed = timed.join(bounds, list(keys)).withColumn(
        "at_s",
        F.when(F.col("i") == 0, F.col("_first_s"))
        .when(F.col("grade").isNull(), F.col("_last_s"))
        .otherwise(F.col("time_s_at")),
    )
    for helper in ("_stop", "_stop_m", "time_s_end"):
        timed = timed.withColumn(helper, F.lit(None).cast("double"))
    if rules.max_elapsed_s is not None:
        timed = _with_ceiling(timed, bounds, slim, keys, rules.max_elapsed_s)
    # Each grid point is read once; an interval is the difference to its successor.
    timed = timed.withColumn("at_s", F.least("at_s", F.coalesce("_stop", "at_s")))
    read = clocks.clocks_at(
        timed, clocks.cumulate_clocks(partition, keys), keys, "at_s", "_a"
    )
    c = clocks.CENTRAL
    following = {
        "end_s": F.col("at_s"),
        "_m": F.col(f"m_{c}_a"),
        "_mu": F.col(f"mu_{c}_a"),
    }
    led = ordered.shift(read, keys, ["i"], following, forward=True)
    spans = led.filter(F.col("grade").isNotNull())
    stop = F.col("_stop")
    across = F.coalesce((F.col("end_s") == stop) & (F.col("time_s_end") > stop), F.lit(False))
    length = F.when(across, F.col("_stop_m") - F.col("distance_m")).otherwise(
        F.col("end_m") - F.col("distance_m")
    )
    moving = F.col("_m") - F.col(f"m_{c}_a")
    known = F.col("_mu") - F.col(f"mu_{c}_a")
    elapsed = F.col("end_s") - F.col("at_s")
    out = spans.filter(stop.isNull() | (F.col("at_s") < stop)).select(
        *keys,
        "i",
        "grade",
        length.alias("length_m"),
        F.col("at_s").alias("start_s"),
        "end_s",
        (F.col("_last_s") - F.col("_first_s")).alias("activity_s"),
        across.alias("truncated"),
        elapsed.alias("elapsed_s"),
        moving.alias("moving_s"),
        (elapsed - known).alias("stopped_s"),
        (known - moving).alias("undetermined_s"),
    )
    out = out.filter(F.col("length_m") > 0)
    if heart_rate is None:
        return out.withColumn("hr_bpm", F.lit(None).cast("double"))
    lagged = out.withColumn("_ha", F.col("start_s") + rules.hr_lag_s).withColumn(
        "_hb", F.col("end_s") + rules.hr_lag_s
    )
    read = track.heart_rate_over(
        lagged, heart_rate, keys, "_ha", "_hb", coverage=rules.hr_min_coverage
    )
    return read.withColumnRenamed("hr_mean", "hr_bpm").drop(
        "_ha", "_hb", "hr_area", "hr_covered_s"
    )


def _with_ceiling(
    timed: DataFrame, bounds: DataFrame, slim: DataFrame, keys: Sequence[str], ceiling_s: float
) -> DataFrame:
    """Grid points with the ceiling instant and the distance reached there; the interval
    across the ceiling is cut, later ones are dropped by the caller."""
    stops = bounds.select(*keys, (F.col("_first_s") + ceiling_s).alias("_stop"))
    # Written: joined to frames of the same track as a plan, its columns came out null.
    reached = cut_lineage(
        lookup.interpolated_at(
            stops, slim, keys, "_stop", "time_s", ["time_s"], ["realized_m"]
        ).withColumnRenamed("realized_m_at", "_stop_m")
    )
    bare = timed.drop("_stop", "_stop_m", "time_s_end")
    full = ordered.shift(bare, keys, ["i"], {"time_s_end": F.col("at_s")}, forward=True)
    return full.join(reached, list(keys))


def interval_exclusion(rules: CurveRules, bin_column: Column | None = None) -> Column:
    """First reason that drops an interval, null when it is kept; a bin that is known already
    need not be found again."""
    length, grade, elapsed = F.col("length_m"), F.col("grade"), F.col("elapsed_s")
    safe = F.nullif(elapsed, F.lit(0.0))
    vertical = length * grade / safe
    reasons = [
        F.when((grades.bin_index(grade) if bin_column is None else bin_column).isNull(), "grade"),
        F.when(elapsed <= 0, "no_elapsed"),
        F.when(
            (length / safe > rules.max_elapsed_speed_ms)
            | (vertical > rules.max_ascent_speed_ms)
            | (vertical < -rules.max_descent_speed_ms),
            "aberrant",
        ),
    ]
    if rules.hr_center_bpm is not None:
        judged = grade >= rules.hr_min_grade
        off = F.abs(F.col("hr_bpm") - rules.hr_center_bpm) > rules.hr_width_bpm / 2
        reasons += [
            F.when(judged & F.col("hr_bpm").isNull(), "hr_undefined"),
            F.when(judged & off, "hr_outside"),
        ]
    return F.coalesce(*reasons)


def tag_intervals(intervals: DataFrame, rules: CurveRules) -> DataFrame:
    """Adds ``exclusion`` (activity duration first, then interval rules) and ``bin``."""
    duration = []
    if rules.min_duration_s is not None:
        duration.append(F.when(F.col("activity_s") < rules.min_duration_s, "short"))
    if rules.max_duration_s is not None:
        duration.append(F.when(F.col("activity_s") >= rules.max_duration_s, "long"))
    binned = intervals.withColumn("bin", grades.bin_index(F.col("grade")))
    reason = F.coalesce(*duration, interval_exclusion(rules, F.col("bin")))
    return binned.withColumn("exclusion", reason)


def cells(kept: DataFrame, curve_keys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Totals by activity and grade bin (first of the two aggregation levels)."""
    moving = F.col("moving_s") > 0

    def when_moving(value: Column) -> Column:
        return F.sum(F.when(moving, value).otherwise(0.0))

    hr = F.col("hr_bpm")
    return kept.groupBy(*curve_keys, *keys, "bin").agg(
        F.sum("length_m").alias("length_all_m"),
        F.sum("elapsed_s").alias("elapsed_s"),
        when_moving(F.col("length_m")).alias("length_moving_m"),
        when_moving(F.col("moving_s")).alias("moving_s"),
        when_moving(F.col("grade") * F.col("length_m")).alias("grade_length_m"),
        F.sum(F.when(moving & hr.isNotNull(), hr * F.col("moving_s")).otherwise(0.0)).alias(
            "hr_moving"
        ),
        F.sum(F.when(moving & hr.isNotNull(), F.col("moving_s")).otherwise(0.0)).alias(
            "hr_moving_s"
        ),
    )


def estimate_bins(
    cell_table: DataFrame, curve_keys: Sequence[str], rules: CurveRules
) -> DataFrame:
    """One row per estimated grade bin (second aggregation level).

    Pooled value: total length over total moving time; median value: median of the
    activity speeds with enough moving time in the bin."""
    m = F.col("moving_s")
    # Sums and medians read the cells; those of a large input are made once.
    if rules.value != "pooled" and ordered.input_bytes(cell_table) >= quantiles.WRITTEN_BYTES:
        cell_table = cut_lineage(cell_table)
    sums = cell_table.groupBy(*curve_keys, "bin").agg(
        F.sum("length_moving_m").alias("length_moving_m"),
        F.sum("moving_s").alias("moving_total_s"),
        F.sum("length_all_m").alias("length_all_m"),
        F.sum("elapsed_s").alias("elapsed_total_s"),
        F.sum("grade_length_m").alias("_gl"),
        F.sum("hr_moving").alias("_hm"),
        F.sum("hr_moving_s").alias("_hs"),
        F.sum(F.when(m > 0, 1).otherwise(0)).alias("moving_activities"),
        F.sum(m * m).alias("_m2"),
        F.max(m).alias("_mx"),
        F.sum(F.when(m >= rules.median_min_moving_s, m).otherwise(0.0)).alias("_carried"),
    )
    sums = sums.filter(F.col("moving_total_s") > 0)
    total = F.col("moving_total_s")
    out = (
        sums.withColumn("elapsed_speed_ms", F.col("length_all_m") / F.col("elapsed_total_s"))
        .withColumn("mean_hr_bpm", F.col("_hm") / F.nullif("_hs", F.lit(0.0)))
        .withColumn("n_eff", total * total / F.col("_m2"))
        .withColumn("max_share", F.col("_mx") / total)
        .withColumn("mean_grade", F.col("_gl") / F.col("length_moving_m"))
    )
    if rules.value == "pooled":
        out = out.select(
            "*",
            (F.col("length_moving_m") / total).alias("speed_ms"),
            total.alias("value_s"),
            F.col("moving_activities").alias("activities"),
        )
    else:
        able = cell_table.filter((m > 0) & (m >= rules.median_min_moving_s)).withColumn(
            "_speed", F.col("length_moving_m") / m
        )
        medians = quantiles.exact_median(able, [*curve_keys, "bin"], "_speed", "speed_ms")
        out = out.join(medians, [*curve_keys, "bin"]).select(
            *out.columns,
            "speed_ms",
            F.col("_carried").alias("value_s"),
            F.col("n").alias("activities"),
        )
    low, high = grades.bin_edges(F.col("bin"))
    return (
        out.withColumn("grade", grades.bin_center(F.col("bin")))
        .withColumn("lower_permille", low)
        .withColumn("upper_permille", high)
        .withColumn("time_min", F.col("value_s") / 60)
        .drop("_gl", "_hm", "_hs", "_m2", "_mx", "_carried")
    )


def select_support(
    bins: DataFrame, curve_keys: Sequence[str], threshold_min: float
) -> DataFrame:
    """Marks the bins of the usable support in ``kept`` and says why others are out.

    The core runs from the last negative to the first positive grade present; it must
    pass the threshold whole. The support extends outwards over present bins until one
    fails; a missing bin is no hole. ``curve_error`` is null for a usable curve."""
    grade, ok = F.col("grade"), F.col("time_min") >= threshold_min
    curve = Window.partitionBy(*curve_keys)
    tagged = (
        bins.withColumn("_ok", ok)
        .withColumn("_low", F.max(F.when(grade < 0, grade)).over(curve))
        .withColumn("_high", F.min(F.when(grade > 0, grade)).over(curve))
    )
    core = (grade >= F.col("_low")) & (grade <= F.col("_high"))
    outward_up = curve.orderBy("grade").rowsBetween(Window.unboundedPreceding, 0)
    outward_down = curve.orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0)
    right_fail = (grade > F.col("_high")) & ~F.col("_ok")
    left_fail = (grade < F.col("_low")) & ~F.col("_ok")
    tagged = (
        tagged.withColumn("_core_bad", F.max(core & ~F.col("_ok")).over(curve))
        .withColumn("_rf", F.sum(F.when(right_fail, 1).otherwise(0)).over(outward_up))
        .withColumn("_lf", F.sum(F.when(left_fail, 1).otherwise(0)).over(outward_down))
    )
    reach = (F.col("_rf") == 0) & (F.col("_lf") == 0)
    tagged = tagged.withColumn("_in", reach)
    edge_low = F.min(F.when(F.col("_in"), grade)).over(curve)
    edge_high = F.max(F.when(F.col("_in"), grade)).over(curve)
    tagged = tagged.withColumn(
        "_edge", F.least(F.abs(edge_low), F.abs(edge_high))
    )
    error = F.coalesce(
        F.when(F.col("_low").isNull(), "no_negative"),
        F.when(F.col("_high").isNull(), "no_positive"),
        F.when(F.col("_core_bad"), "core_below_threshold"),
        F.when(F.col("_edge") < MIN_EDGE_GRADE, "too_narrow"),
    )
    stopped_by = ((F.col("_rf") == 1) & right_fail) | ((F.col("_lf") == 1) & left_fail)
    reason = F.when(F.col("_in"), None).when(stopped_by, "low_support").otherwise("outside_range")
    return (
        tagged.withColumn("curve_error", error)
        .withColumn("kept", F.col("_in") & F.col("curve_error").isNull())
        .withColumn("discard_reason", F.when(F.col("curve_error").isNull(), reason))
        .drop("_ok", "_low", "_high", "_core_bad", "_rf", "_lf", "_in", "_edge")
    )


@dataclass(frozen=True)
class CurveEstimate:
    """Tables of one estimation (possibly of many curves at once)."""

    bins: DataFrame
    levels: DataFrame
    exclusions: DataFrame
    fates: DataFrame
    counts: DataFrame


def estimate(
    intervals: DataFrame,
    curve_keys: Sequence[str],
    keys: Sequence[str],
    rules: CurveRules,
) -> CurveEstimate:
    """Whole estimation of every curve in ``curve_keys``.

    ``levels``: rank quantiles 1/10, 1/2, 9/10 of ln(moving / predicted) per activity;
    ``bins`` gains the spread ``shape_iqr`` of the per-activity shape in each bin."""
    tagged = tag_intervals(intervals, rules)
    kept = tagged.filter(F.col("exclusion").isNull())
    table = cells(kept, curve_keys, keys)
    # Written: every table below reads the knots, which stand behind all intervals.
    bins = cut_lineage(
        select_support(estimate_bins(table, curve_keys, rules), curve_keys, rules.support_min)
    )
    knots = pace.knot_table(bins.filter("kept"), curve_keys)
    moving = kept.filter(F.col("moving_s") > 0)
    predicted = (
        moving.join(knots, list(curve_keys))
        if curve_keys
        else moving.crossJoin(F.broadcast(knots))
    ).withColumn(
        "predicted_s", F.col("length_m") * pace.curve_pace(F.col("grade"), F.col("knots"))
    )
    shares = predicted.groupBy(*curve_keys, *keys, "bin").agg(
        F.sum("predicted_s").alias("predicted_s"), F.sum("moving_s").alias("moving_s")
    )
    per_activity = shares.groupBy(*curve_keys, *keys).agg(
        F.log(F.sum("moving_s") / F.sum("predicted_s")).alias("level")
    )
    levels = quantiles.rank_quantiles(
        per_activity, curve_keys, "level", {"p10": (1, 10), "p50": (1, 2), "p90": (9, 10)}
    )
    shapes = (
        shares.filter(F.col("moving_s") >= rules.shape_min_moving_s)
        .join(per_activity, [*curve_keys, *keys])
        .withColumn("shape", F.log(F.col("predicted_s") / F.col("moving_s")) + F.col("level"))
    )
    spread = quantiles.rank_quantiles(
        shapes, [*curve_keys, "bin"], "shape", {"_q1": (1, 4), "_q3": (3, 4)}
    ).select(
        *curve_keys,
        "bin",
        F.col("n").alias("shape_activities"),
        F.when(
            F.col("n") >= rules.shape_min_activities, F.col("_q3") - F.col("_q1")
        ).alias("shape_iqr"),
    )
    bins = bins.join(spread, [*curve_keys, "bin"], "left").fillna(0, ["shape_activities"])
    exclusions = (
        tagged.filter(F.col("exclusion").isNotNull())
        .groupBy(*curve_keys, "exclusion")
        .agg(F.count(F.lit(1)).alias("intervals"), F.sum("length_m").alias("length_m"))
    )
    carrying_s = rules.median_min_moving_s if rules.value == "median" else 0.0
    contributes = table.groupBy(*curve_keys, *keys).agg(
        F.max((F.col("moving_s") > 0) & (F.col("moving_s") >= carrying_s)).alias("contributes")
    )
    duration = F.col("exclusion").isin("short", "long")
    fates = (
        tagged.groupBy(*curve_keys, *keys)
        .agg(
            F.max(F.when(duration, F.col("exclusion"))).alias("_d"),
            F.max(F.col("exclusion").isNull()).alias("_kept"),
        )
        .join(contributes, [*curve_keys, *keys], "left")
        .select(
            *curve_keys,
            *keys,
            F.coalesce(F.col("_d"), F.when(~F.col("_kept"), "no_interval")).alias("exclusion"),
            F.coalesce("contributes", F.lit(False)).alias("contributes"),
        )
    )
    counts = tagged.groupBy(*curve_keys).agg(
        F.count(F.lit(1)).alias("intervals"),
        F.sum(F.when(F.col("exclusion").isNull(), 1).otherwise(0)).alias("retained"),
        F.sum(
            F.when(F.col("exclusion").isNull() & (F.col("moving_s") <= 0), 1).otherwise(0)
        ).alias("retained_without_moving"),
        F.sum(F.when(F.col("exclusion").isNull(), F.col("length_m"))).alias("length_all_m"),
        F.sum(F.when(F.col("exclusion").isNull(), F.col("moving_s"))).alias("moving_s"),
        F.sum(F.when(F.col("exclusion").isNull(), F.col("elapsed_s"))).alias("elapsed_s"),
    ).withColumn("elapsed_moving_ratio", F.col("elapsed_s") / F.nullif("moving_s", F.lit(0.0)))
    return CurveEstimate(bins, levels, exclusions, fates, counts)


def curve_rows(bins: DataFrame, curve_keys: Sequence[str]) -> DataFrame:
    """Rows of a curve file: grade in percent, speeds, time, one per estimated bin."""
    return bins.select(
        *curve_keys,
        (F.col("grade") * 100).alias("grade_pct"),
        grades.ms_to_kmh(F.col("speed_ms")).alias("kmh"),
        F.col("mean_hr_bpm").alias("hr"),
        (F.col("speed_ms") * F.col("grade") * 3600).alias("vam_mh"),
        "time_min",
        grades.ms_to_kmh(F.col("elapsed_speed_ms")).alias("elapsed_kmh"),
        "activities",
        "shape_iqr",
    )


def check_curve_rows(rows: DataFrame, curve_keys: Sequence[str]) -> DataFrame:
    """What a reader would refuse in curve rows: reason of each unreadable row."""
    speed = F.col("kmh")
    repeated = F.count(F.lit(1)).over(Window.partitionBy(*curve_keys, "grade_pct")) > 1
    problem = F.coalesce(
        F.when(F.col("grade_pct").isNull() | F.isnan("grade_pct"), "grade"),
        F.when(speed.isNull() | F.isnan(speed) | (speed < 0.01), "speed"),
        F.when(F.col("time_min").isNull() | (F.col("time_min") < 0), "time"),
        F.when(repeated, "repeated_grade"),
    )
    return rows.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def select_candidates(
    index: DataFrame, types: Sequence[str], date_from: str, date_to: str
) -> DataFrame:
    """Index entries with a recording, of a listed type, whose local start day is in
    the closed range."""
    day = F.to_date("local_start")
    return index.filter(
        F.col("has_recording")
        & F.col("activity_type").isin(*types)
        & day.between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
