"""One row per calendar day: spine, admission, rolling normals, nights, merged exports.

Day tables have at most one row per (athlete, civil day); their windows therefore hold a
bounded number of rows, unlike point tables, which go through the ordered scans."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeflow.operators import islands, lookup, ordered, quantiles
from ridgeflow.session import cut_lineage

DAY_S = 86_400.0


def calendar_spine(rows: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """Every day from the first to the last of each key."""
    ends = rows.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))


def on_spine(rows: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """Day rows on the calendar spine; absent days have nulls."""
    return calendar_spine(rows, keys, day).join(rows, [*keys, day], "left")


def activity_columns(
    entries: DataFrame, keys: Sequence[str], families: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Per-day activity counts, load (null when all loads miss) and durations by sport.

    ``entries``: keys, ``day``, ``activity_type``, ``elapsed_s``, ``load``."""
    known = [t for types in families.values() for t in types]
    other = ~F.col("activity_type").isin(*known)

    def spent(condition: Column) -> Column:
        return F.sum(F.when(condition, F.coalesce("elapsed_s", F.lit(0.0))).otherwise(0.0))

    return entries.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("activity_count"),
        F.sum("load").alias("training_load"),
        F.sum(F.when(F.col("load").isNull(), 1).otherwise(0)).alias("activities_without_load"),
        *(
            spent(F.col("activity_type").isin(*types)).alias(f"{name}_elapsed_s")
            for name, types in families.items()
        ),
        spent(other).alias("other_elapsed_s"),
        F.sum(F.when(other, 1).otherwise(0)).alias("other_activity_count"),
        F.sum(F.when(F.col("elapsed_s").isNull(), 1).otherwise(0)).alias(
            "activities_without_elapsed"
        ),
    )


def empty_day_defaults(joined: DataFrame, families: Sequence[str]) -> DataFrame:
    """Zeroes on days without activity: there the load is 0, not unknown."""
    none = F.col("activity_count").isNull()
    out = joined.withColumn(
        "training_load", F.when(none, 0.0).otherwise(F.col("training_load"))
    )
    counts = ("activity_count", "activities_without_load", "other_activity_count")
    zero = [*counts, "activities_without_elapsed", "other_elapsed_s"]
    return out.fillna(0, [*zero, *(f"{f}_elapsed_s" for f in families)])


def admission_refusal(
    *,
    absent: Column,
    value: Column,
    invalid: Column,
    night: tuple[Column, Column, Column] | None,
    short_admitted: bool,
    journal: Column,
    exclude_altitude_stay: bool = True,
) -> Column:
    """First reason that keeps a day's value out of the normals, null when admitted.

    ``night`` (for measures of the night): state, short flag, shifted flag. Unknown
    flags exclude nothing."""
    rules = [
        F.when(absent, "absent_row"),
        F.when(value.isNull(), "no_value"),
        F.when(invalid, "invalid_value"),
    ]
    if night is not None:
        state, short, shifted = night
        rules.append(F.when(~state.eqNullSafe(F.lit("complete")), "night_not_complete"))
        if not short_admitted:
            rules.append(F.when(short, "short_night"))
        rules.append(F.when(shifted, "shifted_night"))
    rules += [
        F.when(F.array_contains(journal, "illness"), "illness"),
        F.when(F.array_contains(journal, "injury"), "injury"),
    ]
    if exclude_altitude_stay:
        rules.append(F.when(F.array_contains(journal, "altitude_stay"), "altitude_stay"))
    return F.coalesce(*rules)


@dataclass(frozen=True)
class NormalRules:
    """Window, minimum, factors and resolution of a rolling normal."""

    window_days: int = 28
    min_admitted: int = 14
    mad_factor: float = 1.4826
    range_k: float = 1.0
    resolution: float = 1.0
    log_scale: bool = False


def _array_median(values: Column) -> Column:
    sorted_values = F.sort_array(values)
    n = F.size(values)
    low = F.get(sorted_values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(sorted_values, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def day_axis(day: str) -> Column:
    return F.unix_date(day)


def rolling_normals(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    admitted: str,
    rules: NormalRules,
    *,
    day: str = "day",
    prefix: str = "",
) -> DataFrame:
    """Robust normal of the admitted values of the days before each day, never that day.

    Adds ``normal``, ``dispersion``, ``range_low``, ``range_high``, ``admitted_days``,
    ``absence`` and ``segment`` (number of absent normals before the day)."""
    scaled = F.when(F.col(admitted), F.log(value) if rules.log_scale else F.col(value))
    axis = Window.partitionBy(*keys).orderBy(day_axis(day))
    frame = axis.rangeBetween(-rules.window_days, -1)
    out = rows.withColumn("_x", scaled).withColumn("_w", F.collect_list("_x").over(frame))
    out = out.withColumn("_n", F.size("_w"))
    enough = F.col("_n") >= max(rules.min_admitted, 1)
    out = out.withColumn("_m", F.when(enough, _array_median(F.col("_w"))))
    deviations = F.transform("_w", lambda x: F.abs(x - F.col("_m")))
    mad = _array_median(deviations)
    if rules.log_scale:
        center = F.exp("_m")
        floor = F.log1p(rules.resolution / center)
    else:
        center = F.col("_m")
        floor = F.lit(rules.resolution)
    out = out.withColumn("_s", F.when(enough, F.greatest(rules.mad_factor * mad, floor)))

    def unscaled(x: Column) -> Column:
        return F.exp(x) if rules.log_scale else x

    half = rules.range_k * F.col("_s")
    absence = F.when(F.col("_n") == 0, "no_admitted_day").when(
        F.col("_n") < rules.min_admitted, "too_few_admitted_days"
    )
    out = out.withColumn(f"{prefix}absence", absence)
    past = axis.rowsBetween(Window.unboundedPreceding, -1)
    missing = F.when(F.col(f"{prefix}absence").isNotNull(), 1).otherwise(0)
    return (
        out.withColumn(f"{prefix}normal", center)
        .withColumn(f"{prefix}dispersion", F.col("_s"))
        .withColumn(f"{prefix}range_low", unscaled(F.col("_m") - half))
        .withColumn(f"{prefix}range_high", unscaled(F.col("_m") + half))
        .withColumn(f"{prefix}admitted_days", F.col("_n"))
        .withColumn(f"{prefix}segment", F.coalesce(F.sum(missing).over(past), F.lit(0)))
        .drop("_x", "_w", "_n", "_m", "_s")
    )


def ruptures(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    day: str = "day",
    ranks: str = "ranks",
    version: str | None = "version",
    window_days: int = 28,
) -> DataFrame:
    """Adds ``rank_rupture``, ``version_rupture``, ``rupture``, ``uncertain``, ``straddles``.

    A rank rupture is a day with a rank missing from the last day that had any; a version
    rupture a version different from the last known; uncertain days have two ranks, or
    none just before a rank rupture; a normal straddles when its window mixes the sides
    of a rupture or holds an uncertain day."""
    axis = Window.partitionBy(*keys).orderBy(day_axis(day))
    past = axis.rowsBetween(Window.unboundedPreceding, -1)
    ahead = axis.rowsBetween(1, Window.unboundedFollowing)
    size = F.size(F.coalesce(F.col(ranks), F.array().cast("array<int>")))
    out = rows.withColumn("_k", size).withColumn(
        "_before", F.last(F.when(F.col("_k") > 0, F.col(ranks)), ignorenulls=True).over(past)
    )
    fresh = F.size(F.array_except(F.col(ranks), F.col("_before"))) > 0
    out = out.withColumn(
        "rank_rupture",
        F.coalesce((F.col("_k") > 0) & F.col("_before").isNotNull() & fresh, F.lit(False)),
    )
    changed = F.lit(False)
    if version is not None:
        out = out.withColumn("_v", F.last(version, ignorenulls=True).over(past))
        changed = F.coalesce(F.col(version) != F.col("_v"), F.lit(False))
    out = out.withColumn("version_rupture", changed)
    out = out.withColumn("rupture", F.col("rank_rupture") | F.col("version_rupture"))
    following = F.first(F.when(F.col("_k") > 0, F.col("rank_rupture")), ignorenulls=True)
    out = out.withColumn("_next", following.over(ahead)).withColumn(
        "uncertain",
        (F.col("_k") >= 2) | ((F.col("_k") == 0) & F.coalesce("_next", F.lit(False))),
    )
    recent = F.max("rupture").over(axis.rangeBetween(-(window_days - 1), -1))
    doubt = F.max("uncertain").over(axis.rangeBetween(-window_days, -1))
    if window_days == 1:
        recent = F.lit(False)
    astride = F.coalesce(recent, F.lit(False)) | F.coalesce(doubt, F.lit(False))
    return out.withColumn("straddles", astride).drop("_k", "_before", "_v", "_next")


def series_runs(
    rows: DataFrame, keys: Sequence[str], same: Sequence[str], *, day: str = "day"
) -> DataFrame:
    """Numbers runs of consecutive days that share the columns ``same``."""
    axis = Window.partitionBy(*keys).orderBy(day_axis(day))
    stamp = F.struct(*same)
    starts = ~(F.lag(stamp).over(axis).eqNullSafe(stamp)) | (
        day_axis(day) - F.lag(day_axis(day)).over(axis) > 1
    )
    flag = F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)
    return rows.withColumn("_f", flag).withColumn("run", F.sum("_f").over(axis)).drop("_f")


def last_days(rows: DataFrame, keys: Sequence[str], n: int, *, day: str = "day") -> DataFrame:
    """The last ``n`` days of each key, as a filter on the last day: no ranking."""
    ends = rows.groupBy(*keys).agg(F.max(day).alias("_end"))
    joined = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))
    return joined.filter(F.datediff("_end", day) < n).drop("_end")


def lowest_window(
    points: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    width: int,
    min_fraction: float,
) -> DataFrame:
    """Earliest window ``[t ; t + width[`` of least mean among those with enough points.

    ``at`` is an integer axis. The needed count is the fraction of the points a full
    window would hold at the median step. Returns ``start``, ``mean`` and ``midpoint``."""
    back = ordered.shift(points, keys, [at], {"_p": F.col(at)})
    steps = back.withColumn("_step", (F.col(at) - F.col("_p")).cast("double"))
    medians = quantiles.exact_median(ordered.without_chunks(steps), keys, "_step", "_med")
    framed = ordered.framed(
        points,
        keys,
        at,
        0,
        width - 1,
        {
            "_mean": lambda w: F.avg(value).over(w),
            "_count": lambda w: F.count(value).over(w),
        },
    )
    needed = framed.join(medians.select(*keys, "_med"), list(keys)).filter(
        F.col("_count") >= min_fraction * width / F.col("_med")
    )
    best = needed.groupBy(*keys).agg(
        F.min(F.struct(F.col("_mean").alias("mean"), F.col(at).alias("start"))).alias("_b")
    )
    return best.select(
        *keys,
        F.col("_b.start").alias("start"),
        F.col("_b.mean").alias("mean"),
        (F.col("_b.start") + width / 2).alias("midpoint"),
    )


def night_state(max_unmeasured: float) -> Column:
    """First state that applies: missing, declared, in progress, partial, complete."""
    length = F.unix_micros("night_end") - F.unix_micros("night_start")
    share = F.col("unmeasurable_s") * 1e6 / length
    late = F.coalesce(F.col("night_end") > F.col("data_end"), F.lit(False))
    open_ = F.coalesce(~F.col("window_confirmed"), F.lit(False))
    return (
        F.when(F.col("night_start").isNull(), "missing")
        .when(F.coalesce(~F.col("from_device"), F.lit(False)), "declared")
        .when(late | open_, "in_progress")
        .when(share.isNull() | (share > max_unmeasured), "partial")
        .otherwise("complete")
    )


def measured_sleep() -> Column:
    """Deep plus light, plus REM where the device detects it; null if one is missing."""
    rem = F.when(F.coalesce("rem_capable", F.lit(False)), F.col("rem_s")).otherwise(0.0)
    return F.col("deep_s") + F.col("light_s") + rem


def circular_mean(sin_sum: Column, cos_sum: Column, count: Column) -> Column:
    """Circular mean on 24 h, null when the resultant vanishes."""
    flat = F.hypot(cos_sum, sin_sum) / F.nullif(count, F.lit(0)) <= 1e-12
    turn = F.atan2(sin_sum, cos_sum) / (2 * math.pi) * DAY_S
    mean = F.pmod(turn, F.lit(DAY_S))
    return F.when(~flat & (count > 0), F.when(mean >= DAY_S, 0.0).otherwise(mean))


def circular_distance(a: Column, b: Column) -> Column:
    gap = F.pmod(F.abs(a - b), F.lit(DAY_S))
    return F.least(gap, DAY_S - gap)


def assess_nights(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    max_unmeasured: float,
    short_sleep_s: float,
    shift_s: float,
    usual_window_days: int,
    usual_min_nights: int,
    day: str = "day",
    midpoint: str = "midpoint_s",
) -> DataFrame:
    """State of each night, short and shifted flags with the reason of an unknown one.

    The usual midpoint is the circular mean of the complete, not short nights of the
    previous days, from sums of sines and cosines over the frame."""
    rows = rows.withColumn("night_state", night_state(max_unmeasured)).withColumn(
        "measured_sleep_s", measured_sleep()
    )
    has_night = F.col("night_start").isNotNull()
    usual = (F.col("night_state") == "complete") & (F.col("measured_sleep_s") >= short_sleep_s)
    angle = F.col(midpoint) * (2 * math.pi / DAY_S)
    frame = (
        Window.partitionBy(*keys).orderBy(day_axis(day)).rangeBetween(-usual_window_days, -1)
    )
    out = (
        rows.withColumn("_sin", F.sum(F.when(usual, F.sin(angle))).over(frame))
        .withColumn("_cos", F.sum(F.when(usual, F.cos(angle))).over(frame))
        .withColumn("usual_nights", F.count(F.when(usual, F.lit(1))).over(frame))
    )
    mean = circular_mean(F.col("_sin"), F.col("_cos"), F.col("usual_nights"))
    out = out.withColumn("usual_midpoint_s", mean).withColumn(
        "midpoint_distance_s",
        F.when(has_night, circular_distance(F.col(midpoint), F.col("usual_midpoint_s"))),
    )
    why = F.coalesce(
        F.when(~has_night, "no_night"),
        F.when(F.col("usual_nights") < usual_min_nights, "below_usual_minimum"),
        F.when(F.col("usual_midpoint_s").isNull(), "dispersed_midpoints"),
    )
    short = F.when(has_night, F.col("measured_sleep_s") < short_sleep_s)
    return (
        out.withColumn("night_short", short)
        .withColumn(
            "night_short_absence",
            F.when(~has_night, "no_night").when(short.isNull(), "no_measured_sleep"),
        )
        .withColumn("night_shifted_absence", why)
        .withColumn(
            "night_shifted", F.when(why.isNull(), F.col("midpoint_distance_s") > shift_s)
        )
        .drop("_sin", "_cos")
    )


def resting_status(min_sleep_s: float) -> Column:
    """Status of a day's resting heart rate: absent, provisional, no_night or valid."""
    absent = F.col("resting_hr_bpm").isNull() | F.col("state").isin(
        "absent", "empty", "no_measurement"
    )
    slept = F.col("measured_sleep_s")
    return (
        F.when(F.coalesce(absent, F.lit(True)), "absent")
        .when(F.col("state") == "truncated", "provisional")
        .when(slept.isNull() | (slept < min_sleep_s), "no_night")
        .otherwise("valid")
    )


def day_end(start: Column, data_end: Column) -> Column:
    """End of a day window: the later of its start plus 24 h and its data end."""
    return F.greatest(start + F.expr("INTERVAL 24 HOURS"), data_end)


def stress_columns(min_fraction: float, parts: Sequence[str]) -> tuple[Column, Column]:
    """Measured stress seconds (null if a part is) and whether they cover the day."""
    measured = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    window = (
        F.unix_micros(day_end(F.col("window_start"), F.col("data_end")))
        - F.unix_micros("window_start")
    ) / 1e6
    return measured, measured >= min_fraction * window


def first_wins(
    points: DataFrame, keys: Sequence[str], instant: str, file_order: str
) -> tuple[DataFrame, DataFrame]:
    """(kept points, duplicates per key): one point per instant, the oldest file's."""
    others = [c for c in points.columns if c not in (*keys, instant, file_order)]
    packed = F.struct(file_order, *others)
    kept = points.groupBy(*keys, instant).agg(
        F.min_by(packed, F.struct(file_order, *others)).alias("_p"),
        F.count(F.lit(1)).alias("_n"),
    )
    rows = kept.select(*keys, instant, "_p.*")
    duplicates = kept.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicates"))
    return rows, duplicates


def coverage_of(
    spans: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    span_id: str,
    start: str,
    end: str,
    at: str,
    step_s: float,
    cell_s: float,
) -> DataFrame:
    """Points in each closed span and the share of it under the union of
    ``[t ; t + step[``: ``points`` and ``coverage``."""
    stamped = points.select(*keys, F.col(at).alias("_t0"), F.col(at).alias("_t1"))
    pairs = lookup.overlap_join(
        spans.select(*keys, span_id, start, end),
        stamped,
        keys,
        (start, end),
        ("_t0", "_t1"),
        cell_s,
        closed=True,
    )
    pieces = pairs.select(
        *keys,
        span_id,
        F.col("_t0").alias("_a"),
        F.least(F.col("_t0") + step_s, F.col(end)).alias("_b"),
    )
    covered = islands.covered_length(pieces, [*keys, span_id], "_a", "_b", "_c")
    counts = pieces.groupBy(*keys, span_id).agg(F.count(F.lit(1)).alias("points"))
    out = spans.join(covered, [*keys, span_id], "left").join(counts, [*keys, span_id], "left")
    return (
        out.withColumn(
            "coverage", F.coalesce("_c", F.lit(0.0)) / (F.col(end) - F.col(start))
        )
        .withColumn("points", F.coalesce("points", F.lit(0)))
        .drop("_c")
    )


def sleep_within(
    spans: DataFrame,
    episodes: DataFrame,
    segments: DataFrame,
    keys: Sequence[str],
    cell_s: float = DAY_S,
) -> DataFrame:
    """Sleep of the whole episodes finished by each span's end that reach its start.

    ``spans``: keys, ``span_id``, ``start_s``, ``end_s``. ``episodes``: keys, ``episode``,
    ``e0``, ``e1``, ``sleep_s``, ``unmeasurable_s`` (0 for a nap). ``segments``: keys,
    ``episode``, ``s0``, ``s1``, ``asleep`` (a nap is one asleep segment). Overlapping
    episodes form a group that counts the smaller of its summed sleep and the union of
    its asleep segments."""
    keys = list(keys)
    finished = (F.col("e1") <= F.col("end_s")) & (F.col("e1") >= F.col("start_s"))
    marked = episodes.withColumn("_z0", F.col("e1")).withColumn("_z1", F.col("e1"))
    pairs = lookup.overlap_join(
        spans, marked, keys, ("start_s", "end_s"), ("_z0", "_z1"), cell_s, closed=True
    ).filter(finished)
    probe = [*keys, "span_id"]
    # Written: both are read several times, and each reading passed over what stands before.
    grouped = cut_lineage(islands.interval_groups(cut_lineage(pairs), probe, "e0", "e1"))
    groups = grouped.groupBy(*probe, "grp").agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum("sleep_s").alias("_sum"),
        F.max(F.col("sleep_s").isNull()).alias("_no_sleep"),
        F.sum("unmeasurable_s").alias("_un"),
        F.max(F.col("unmeasurable_s").isNull()).alias("_no_un"),
        F.min("e0").alias("_g0"),
        F.max("e1").alias("_g1"),
    )
    # Only groups of several episodes take a union of their segments.
    several = groups.filter(F.col("_k") > 1).select(*probe, "grp")
    inside = grouped.select(*probe, "grp", "episode").join(several, [*probe, "grp"], "left_semi")
    known = cut_lineage(
        inside.join(segments, [*keys, "episode"]).filter(F.col("s1") > F.col("s0"))
    )
    asleep = islands.covered_length(
        known.filter("asleep"), [*probe, "grp"], "s0", "s1", "_union"
    )
    dark = islands.covered_length(
        known.filter(~F.col("asleep")), [*probe, "grp"], "s0", "s1", "_dark"
    )
    joined = groups.join(asleep, [*probe, "grp"], "left").join(dark, [*probe, "grp"], "left")
    many = F.col("_k") > 1
    slept = F.when(many, F.least("_sum", F.coalesce("_union", F.lit(0.0)))).otherwise(
        F.col("_sum")
    )
    unmeasured = F.when(many, F.coalesce("_dark", F.lit(0.0))).otherwise(F.col("_un"))
    sums = joined.groupBy(*probe).agg(
        F.sum("_k").alias("episodes"),
        F.sum(slept).alias("_sleep"),
        F.max("_no_sleep").alias("_no_sleep"),
        F.max(~many & F.col("_no_un")).alias("_no_un"),
        F.sum(F.col("_g1") - F.col("_g0")).alias("_window"),
        F.sum(unmeasured).alias("_unmeasured"),
    )
    out = spans.join(sums, probe, "left")
    none = F.col("episodes").isNull()
    share = F.greatest(
        F.lit(0.0), (F.col("_window") - F.col("_unmeasured")) / F.nullif("_window", F.lit(0.0))
    )
    return out.select(
        *spans.columns,
        F.coalesce("episodes", F.lit(0)).alias("episodes"),
        F.when(~F.col("_no_sleep"), F.col("_sleep")).alias("sleep_s"),
        F.when(none, "no_episode").when(F.col("_no_sleep"), "no_measured_sleep").alias(
            "sleep_absence"
        ),
        F.when(~F.col("_no_un"), share).alias("coverage"),
        F.when(none, "no_episode").when(F.col("_no_un"), "no_unmeasurable").alias(
            "coverage_absence"
        ),
    )


def battery_at(
    probes: DataFrame,
    day_points: DataFrame,
    night_points: DataFrame,
    nights: DataFrame,
    keys: Sequence[str],
    at: str,
    *,
    strict: bool = False,
) -> DataFrame:
    """Last point of the merged day and night series known at each probe.

    Night points count inside their own closed night window, day points outside every
    window, and only nights finished by the probe count. ``day_points`` / ``night_points``:
    keys, ``t``, ``level``, ``file_day`` (night points also ``n0``, ``n1``); ``nights``:
    keys, ``n0``, ``n1``.

    A day point is masked from the first end of the windows that hold it, so each side is
    one as-of: the last point of the finished nights, the last unmasked day point, and for a
    probe inside a night the last day point of any kind. Only where windows lie in one
    another can an earlier day point be live when a later one is masked; only such points
    meet the probes of their days."""
    keys = list(keys)
    oldest = "_old"
    spans = nights.select(*keys, F.col("n0").alias("_w0"), F.col("n1").alias("_w1"))
    instants = day_points.select(*keys, F.col("t").alias("_t0"), F.col("t").alias("_t1")).distinct()
    held = lookup.overlap_join(
        instants, spans, keys, ("_t0", "_t1"), ("_w0", "_w1"), DAY_S, closed=True
    )
    ends = held.groupBy(*keys, F.col("_t0").alias("t")).agg(F.min("_w1").alias("_w1"))
    flagged = (
        day_points.join(ends, [*keys, "t"], "left")
        .withColumn("masked", F.col("_w1").isNotNull())
        .withColumn(oldest, -F.unix_date("file_day"))
    )
    free = flagged.filter(~F.col("masked"))
    own = night_points.filter((F.col("t") >= F.col("n0")) & (F.col("t") <= F.col("n1")))
    known = own.withColumn(oldest, -F.unix_date("file_day"))

    def take(points: DataFrame, tag: str) -> DataFrame:
        return points.select(
            *keys,
            F.col("t").alias(f"{tag}_t"),
            F.col("level").alias(f"{tag}_level"),
            F.col(oldest).alias(f"{tag}_old"),
        )

    last_night = known.groupBy(*keys, "n0", "n1").agg(
        F.max(F.struct("t", oldest, "level")).alias("_p")
    )
    finished = last_night.select(
        *keys,
        F.col("n1").alias("night_done"),
        F.col("_p.t").alias("night_t"),
        F.col("_p.level").alias("night_level"),
        F.col(f"_p.{oldest}").alias("night_old"),
    )
    finished = ordered.running(
        finished, keys, ["night_done", "night_t"],
        {"_top": ("max", F.struct("night_t", "night_old", "night_level"))},
    )
    finished = ordered.without_chunks(finished).select(*keys, "night_done", "_top.*")
    out = lookup.asof(
        probes, finished, keys, at, "night_done", ["night_t", "night_level", "night_old"],
        strict=strict, tie=["night_t", "night_old"],
    )
    out = lookup.asof(
        out, take(free, "free"), keys, at, "free_t", ["free_t", "free_level", "free_old"],
        strict=strict, tie=["free_old"],
    )
    masked = flagged.filter("masked").select(
        *keys,
        F.col("t").alias("masked_t"),
        F.col("level").alias("masked_level"),
        F.col(oldest).alias("masked_old"),
        F.col("_w1").alias("masked_until"),
    )
    out = lookup.asof(
        out, masked, keys, at, "masked_t", ["masked_t", "masked_level", "masked_old", "masked_until"],
        strict=strict, tie=["masked_old"],
    )
    hidden = F.col("masked_until") < F.col(at) if strict else F.col("masked_until") <= F.col(at)
    # Day points that outlive a later one, and the last of them live at an instant.
    outliving = ordered.running(
        masked, keys, ["masked_t"], {"_least": ("min", F.col("masked_until"))}, inclusive=False, reverse=True
    ).filter(F.col("masked_until") > F.col("_least"))
    asked = out.filter(hidden).select(*keys, F.col(at).alias("_a0"), F.col(at).alias("_a1")).distinct()
    met = lookup.overlap_join(
        asked,
        ordered.without_chunks(outliving),
        keys,
        ("_a0", "_a1"),
        ("masked_t", "masked_until"),
        DAY_S,
        closed=True,
    ).filter(
        (F.col("masked_t") < F.col("_a0")) & (F.col("masked_until") >= F.col("_a0"))
        if strict
        else F.col("masked_until") > F.col("_a0")
    )
    earlier = met.groupBy(*keys, F.col("_a0").alias(at)).agg(
        F.max(
            F.struct(
                F.col("masked_t").alias("t"), F.col("masked_old").alias("o"),
                F.col("masked_level").alias("l"), F.lit(False).alias("night"),
            )
        ).alias("_earlier")
    )
    out = out.join(earlier, [*keys, at], "left")
    live = F.when(~hidden, F.struct(
        F.col("masked_t").alias("t"), F.col("masked_old").alias("o"), F.col("masked_level").alias("l"), F.lit(False).alias("night")))
    live = F.coalesce(live, F.col("_earlier"))
    night = F.when(F.col("night_t").isNotNull(), F.struct(
        F.col("night_t").alias("t"), F.col("night_old").alias("o"), F.col("night_level").alias("l"), F.lit(True).alias("night")))
    day = F.when(F.col("free_t").isNotNull(), F.struct(
        F.col("free_t").alias("t"), F.col("free_old").alias("o"), F.col("free_level").alias("l"), F.lit(False).alias("night")))
    best = F.greatest(live, night, day)
    return out.withColumn("_best", best).select(
        *probes.columns,
        F.col("_best.t").alias("point_t"),
        F.col("_best.l").alias("level"),
        F.col("_best.night").alias("from_night"),
        (F.col(at) - F.col("_best.t")).alias("age_s"),
    )


def nights_after(
    probes: DataFrame, nights: DataFrame, keys: Sequence[str], at: str, probe_id: str, count: int
) -> DataFrame:
    """The first ``count`` nights that end strictly after each probe.

    Nights are numbered by their end; one forward as-of finds the first and the rest are
    its next numbers: ``count`` rows per probe, never all later nights."""
    keys = list(keys)
    axis = Window.partitionBy(*keys).orderBy("night_end_s", "day")
    numbered = nights.withColumn("_no", F.row_number().over(axis))
    first = lookup.asof(
        probes,
        numbered.groupBy(*keys, "night_end_s").agg(F.min("_no").alias("_first")),
        keys,
        at,
        "night_end_s",
        ["_first"],
        strict=True,
        forward=True,
    ).filter(F.col("_first").isNotNull())
    wanted = first.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn(
        "_no", F.col("_first") + F.col("rank") - 1
    )
    return wanted.join(numbered, [*keys, "_no"]).select(
        *keys,
        probe_id,
        "rank",
        "day",
        (F.col("night_end_s") - F.col(at)).alias("delay_s"),
    )


def readiness_on_waking(
    nights: DataFrame, entries: DataFrame, naps: DataFrame, keys: Sequence[str], tolerance_s: float
) -> DataFrame:
    """First waking entry of each day from the night's end minus a tolerance up to the
    next nap. All tables carry keys, ``day`` and instants in seconds."""
    keys = [*keys, "day"]
    bound = (
        nights.join(naps.select(*keys, "nap_start_s"), keys, "left")
        .groupBy(*keys, "night_end_s")
        .agg(
            F.min(
                F.when(F.col("nap_start_s") >= F.col("night_end_s"), F.col("nap_start_s"))
            ).alias("_until")
        )
    )
    allowed = (
        (F.col("context") == "waking")
        & (F.col("night_end_s") - F.col("entry_s") <= tolerance_s)
        & (F.col("_until").isNull() | (F.col("entry_s") < F.col("_until")))
    )
    joined = bound.join(entries, keys, "left")
    found = joined.groupBy(*keys, "night_end_s").agg(
        F.min_by(F.when(allowed, F.struct("entry_s", "score")), F.when(allowed, F.col("entry_s"))).alias("_e")
    )
    return found.select(
        *keys,
        F.col("_e.entry_s").alias("entry_s"),
        F.col("_e.score").alias("score"),
        F.when(F.col("_e").isNull(), "no_entry_after_night").alias("absence"),
    )


# Preference order of the states of a day in an export.
STATE_RANK = {"complete": 1, "truncated": 2, "no_measurement": 3}


def export_state(window_s: Column, measured: Column, has_window: Column) -> Column:
    """State of a day in one export."""
    return (
        F.when(~has_window, "empty")
        .when(~measured, "no_measurement")
        .when(window_s < DAY_S, "truncated")
        .otherwise("complete")
    )


def reference_exports(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reference export of each day: complete with detail, complete, truncated, without
    measurement, else any; the most recent (``position``) at each step.

    One ``min`` over a small struct: the exports of a day are never listed."""
    rank = F.when((F.col("state") == "complete") & F.col("detail"), 0)
    for state, order in STATE_RANK.items():
        rank = rank.when(F.col("state") == state, order)
    rank = rank.otherwise(9)
    return days.groupBy(*keys).agg(
        F.min_by(
            F.struct("position", "state", "window_start"), F.struct(rank, -F.col("position"))
        ).alias("reference"),
        F.count(F.lit(1)).alias("exports"),
    ).select(
        *keys,
        F.col("reference.position").alias("reference_position"),
        F.col("reference.state").alias("state"),
        F.col("reference.window_start").alias("reference_window_start"),
        "exports",
    )


def merge_families(
    families: DataFrame, references: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Family carried by each day: the reference's own, else lent by the most recent
    other export that has it, and only by it, when the day windows agree.

    ``families``: keys, ``family``, ``position``, ``window_start``, payload columns.
    Adds ``origin`` (own, borrowed, refused)."""
    joined = families.join(references, list(keys))
    own = F.col("position") == F.col("reference_position")
    chosen = joined.groupBy(*keys, "family").agg(
        F.max(F.when(own, F.col("position"))).alias("_own"),
        F.max(F.when(~own, F.col("position"))).alias("_lender"),
    )
    picked = chosen.withColumn("position", F.coalesce("_own", "_lender"))
    rows = families.join(
        picked.select(*keys, "family", "position", F.col("_own").isNull().alias("_lent")),
        [*keys, "family", "position"],
    ).join(references, list(keys))
    clash = F.col("window_start").isNotNull() & F.col("reference_window_start").isNotNull() & (
        F.col("window_start") != F.col("reference_window_start")
    )
    origin = F.when(~F.col("_lent"), "own").when(clash, "refused").otherwise("borrowed")
    return rows.withColumn("origin", origin).drop("_lent")


def compare_exports(
    leaves: DataFrame, references: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Leaf differences between the reference export of a day and the others, counted
    once per day by (family, path, kind).

    ``leaves``: keys, ``position``, ``family``, ``path``, ``value``. A leaf is a borrowing
    when only others have it, a degradation when a later export lost it, a revision when
    the values differ."""
    tagged = leaves.join(references.select(*keys, "reference_position"), list(keys))
    is_ref = F.col("position") == F.col("reference_position")
    folded = tagged.groupBy(*keys, "family", "path").agg(
        F.max(F.when(is_ref, F.col("value"))).alias("_ref"),
        F.min(F.when(~is_ref, F.col("value"))).alias("_low"),
        F.max(F.when(~is_ref, F.col("value"))).alias("_high"),
        F.count(F.when(~is_ref, F.lit(1))).alias("_others"),
        F.count(F.when(is_ref, F.lit(1))).alias("_own"),
    )
    kind = (
        F.when((F.col("_own") == 0) & (F.col("_others") > 0), "borrowing")
        .when((F.col("_own") > 0) & (F.col("_others") == 0), "degradation")
        .when((F.col("_low") != F.col("_ref")) | (F.col("_high") != F.col("_ref")), "revision")
    )
    classed = folded.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return classed.groupBy("family", "path", "kind").agg(F.count(F.lit(1)).alias("days"))


def pick_status_blocks(
    blocks: DataFrame, references: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """One status block per kind and day: the reference export's if it has it, else the
    most recent other; inside it the file of the block's own day, else the oldest.

    Its own instant: the stamp, else the day's end, else the next day's start, else the
    local midnight that follows."""
    joined = blocks.join(references.select(*keys, "day", "reference_position"), [*keys, "day"], "left")
    order = F.struct(
        F.when(F.col("position") == F.col("reference_position"), 0).otherwise(1),
        -F.col("position"),
        F.when(F.col("file_day") == F.col("day"), 0).otherwise(1),
        F.col("file_day"),
    )
    payload = F.struct(*[c for c in blocks.columns if c not in (*keys, "kind", "day")])
    best = joined.groupBy(*keys, "kind", "day").agg(F.min_by(payload, order).alias("_b"))
    rows = best.select(*keys, "kind", "day", "_b.*")
    return rows.withColumn(
        "proper_instant",
        F.coalesce("stamp", "day_end", "next_start", "next_midnight"),
    )


def edge_counts(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points before, on the edges of, and after their day window."""
    t = F.col("instant")

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    return points.groupBy(*keys).agg(
        count(t < F.col("window_start")).alias("before"),
        count(t == F.col("window_start")).alias("at_start"),
        count(t == F.col("window_end")).alias("at_end"),
        count(t > F.col("window_end")).alias("after"),
    )


# Fixed value: tolerance between a night's window and the sum of its stages, seconds.
NIGHT_TOLERANCE_S = 210.0


def night_mismatch() -> Column:
    """The night's length and its stage durations differ beyond the tolerance."""
    length = (F.unix_micros("night_end") - F.unix_micros("night_start")) / 1e6
    stages = sum(
        (F.coalesce(c, F.lit(0.0)) for c in ("light_s", "rem_s", "awake_s", "unmeasurable_s")),
        F.coalesce("deep_s", F.lit(0.0)),
    )
    return F.abs(length - stages) > NIGHT_TOLERANCE_S


def journal_by_day(journal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Event types of each day from spans ``start`` to ``end`` inclusive."""
    spread = journal.select(
        *keys,
        F.explode(F.sequence("start", F.coalesce("end", "start"))).alias("day"),
        "type",
    )
    return spread.groupBy(*keys, "day").agg(F.sort_array(F.collect_set("type")).alias("types"))
