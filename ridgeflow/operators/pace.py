"""Pace from a speed-by-grade curve, baselines and projected timelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.functions.grades import is_invalid_output
from ridgeflow.operators import lookup, ordered

# Fixed values of the baselines: flat speeds, climb cost, peak offset and decay.
CONSTANT_SPEED_MS = 1.0
NAISMITH_SPEED_MS = 5.0 / 3.6
NAISMITH_CLIMB_S_PER_M = 6.0
TOBLER_PEAK_MS = 6.0 / 3.6
TOBLER_DECAY = 3.5
TOBLER_OFFSET = 0.05
BASELINES = ("constant", "naismith", "tobler")


def knot_table(
    bins: DataFrame, curve_keys: Sequence[str], grade: str = "grade", speed: str = "speed_ms"
) -> DataFrame:
    """One row per curve: its ``knots`` sorted by grade (grade, seconds per metre).

    A curve has at most the number of grade bins (38), so the array is bounded."""
    knot = F.struct(F.col(grade).alias("g"), (1.0 / F.col(speed)).alias("p"))
    return bins.groupBy(*curve_keys).agg(F.sort_array(F.collect_list(knot)).alias("knots"))


def literal_knots(grades: Sequence[float], speeds_ms: Sequence[float]) -> Column:
    """Knots of one curve given by the caller, as a constant."""
    pairs = sorted(zip(grades, speeds_ms, strict=True))
    return F.array(
        *(F.struct(F.lit(float(g)).alias("g"), F.lit(1.0 / v).alias("p")) for g, v in pairs)
    )


def curve_pace(grade: Column, knots: Column) -> Column:
    """Seconds per metre at a grade: pace linear between knots, exact on them; beyond
    the ends the vertical speed of the end knot is kept."""
    first, last = F.get(knots, F.lit(0)), F.try_element_at(knots, F.lit(-1))

    def between(below: Column, above: Column) -> Column:
        share = (grade - below["g"]) / F.nullif(above["g"] - below["g"], F.lit(0.0))
        return F.when(below["g"] == grade, below["p"]).otherwise(
            (1.0 - share) * below["p"] + share * above["p"]
        )

    # The knots are searched once a row: the number found is bound by a list of one.
    held = F.array(F.size(F.filter(knots, lambda k: k["g"] <= grade)))
    inside = F.get(F.transform(held, lambda n: between(F.get(knots, n - 1), F.get(knots, n))), F.lit(0))
    frozen_low = F.abs(grade) * first["p"] / F.abs(first["g"])
    frozen_high = F.abs(grade) * last["p"] / F.abs(last["g"])
    return F.when(grade < first["g"], frozen_low).when(grade > last["g"], frozen_high).otherwise(inside)


def literal_curve_pace(
    grade: Column, grades: Sequence[float], speeds_ms: Sequence[float]
) -> Column:
    """:func:`curve_pace` of a constant curve as one ``CASE``: stays inside codegen."""
    pairs = sorted(zip(grades, speeds_ms, strict=True))
    (g0, v0), (gn, vn) = pairs[0], pairs[-1]
    out = F.when(grade < g0, F.abs(grade) / abs(v0 * g0)).when(
        grade > gn, F.abs(grade) / abs(vn * gn)
    )
    for (low, slow), (high, fast) in zip(pairs, pairs[1:], strict=False):
        share = (grade - low) / (high - low)
        out = out.when(
            grade <= high, (1.0 - share) * (1.0 / slow) + share * (1.0 / fast)
        )
    return out


def is_extrapolated(grade: Column, knots: Column) -> Column:
    """Outside the curve; its end knots are inside."""
    return (grade < F.get(knots, F.lit(0))["g"]) | (grade > F.try_element_at(knots, F.lit(-1))["g"])


def baseline_pace(grade: Column, baseline: str) -> Column:
    """Seconds per metre of a baseline at a grade; infinite where its speed underflows."""
    if baseline == "constant":
        return F.lit(1.0 / CONSTANT_SPEED_MS)
    if baseline == "naismith":
        climb = NAISMITH_CLIMB_S_PER_M * F.greatest(grade, F.lit(0.0))
        return F.lit(1.0 / NAISMITH_SPEED_MS) + climb
    if baseline == "tobler":
        speed = TOBLER_PEAK_MS * F.exp(-TOBLER_DECAY * F.abs(grade + TOBLER_OFFSET))
        return F.when(speed == 0, F.lit(float("inf"))).otherwise(
            1.0 / F.nullif(speed, F.lit(0.0))
        )
    raise ValueError(f"unknown baseline: {baseline}")


def timeline(
    profile: DataFrame,
    keys: Sequence[str],
    pace: Column,
    *,
    effort: Column | float = 1.0,
    extrapolated: Column | None = None,
    checked: bool = False,
) -> DataFrame:
    """Projected time along a profile, one row per grid interval (``checked``: keys above
    the target have just been looked for).

    Adds ``pace``, ``extrapolated``, ``interval_s`` and the cumulated time at both ends
    (``from_s``, ``to_s``). ``pace`` may use any profile column, so a candidate engine is
    just another column expression."""
    outside = F.lit(False) if extrapolated is None else extrapolated
    steps = profile.filter(F.col("grade").isNotNull()).withColumn("pace", pace / effort)
    steps = steps.withColumn("extrapolated", outside).withColumn(
        "interval_s", (F.col("end_m") - F.col("distance_m")) * F.col("pace")
    )
    steps = steps if checked else ordered.assign_chunks(steps, keys, "i")
    summed = ordered.running(steps, keys, ["i"], {"to_s": ("sum", F.col("interval_s"))}, checked=True)
    return summed.withColumn("from_s", F.col("to_s") - F.col("interval_s"))


def valid_timelines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops whole timelines where some pace is not finite and positive."""
    bad = lines.filter(is_invalid_output(F.col("pace"))).select(*keys).distinct()
    return lines.join(bad, list(keys), "left_anti")


def baseline_timelines(
    profile: DataFrame, keys: Sequence[str], baselines: Sequence[str] = BASELINES
) -> DataFrame:
    """Timelines of the baselines, with the name in ``model``; models without a finite
    pace everywhere have no row."""
    table = F.array(
        *(
            F.struct(F.lit(b).alias("model"), baseline_pace(F.col("grade"), b).alias("_p"))
            for b in baselines
        )
    )
    steps = profile.filter(F.col("grade").isNotNull())
    long = steps.select("*", F.inline(table))
    lines = timeline(long, [*keys, "model"], F.col("_p")).drop("_p")
    return valid_timelines(lines, [*keys, "model"])


def time_at(
    probes: DataFrame, lines: DataFrame, keys: Sequence[str], at: str, name: str
) -> DataFrame:
    """Probes with the projected time at an abscissa, exact at grid points."""
    found = lookup.asof(
        probes,
        lines.select(
            *keys,
            F.col("distance_m").alias("_from_m"),
            F.col("from_s").alias("_from_s"),
            F.col("to_s").alias("_to_s"),
            F.col("end_m").alias("_end_m"),
            F.col("pace").alias("_pace"),
        ),
        keys,
        at,
        "_from_m",
        ["_from_m", "_from_s", "_to_s", "_end_m", "_pace"],
    )
    inside = F.col("_from_s") + (F.col(at) - F.col("_from_m")) * F.col("_pace")
    value = F.when(F.col(at) >= F.col("_end_m"), F.col("_to_s")).otherwise(inside)
    return found.select(*ordered.without_chunks(probes).columns, value.alias(name))


def projection_summary(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length, time, extreme grades and out-of-support shares of each timeline."""
    length = F.col("end_m") - F.col("distance_m")
    outside_m = F.sum(F.when(F.col("extrapolated"), length).otherwise(0.0))
    outside_s = F.sum(F.when(F.col("extrapolated"), F.col("interval_s")).otherwise(0.0))
    out = lines.groupBy(*keys).agg(
        F.max("end_m").alias("length_m"),
        F.sum("interval_s").alias("time_s"),
        outside_m.alias("outside_m"),
        outside_s.alias("outside_s"),
        F.min("grade").alias("grade_min"),
        F.max("grade").alias("grade_max"),
    )
    return out.withColumn(
        "outside_distance_share", F.col("outside_m") / F.nullif("length_m", F.lit(0.0))
    ).withColumn("outside_time_share", F.col("outside_s") / F.nullif("time_s", F.lit(0.0)))


def portion_outside_share(
    lines: DataFrame, keys: Sequence[str], start: Column, end: Column
) -> DataFrame:
    """Share of projected time spent outside the curve on a portion of the route."""
    low = F.greatest(F.col("distance_m"), start)
    high = F.least(F.col("end_m"), end)
    term = F.greatest(high - low, F.lit(0.0)) * F.col("pace")
    sums = lines.groupBy(*keys).agg(
        F.sum(F.when(F.col("extrapolated"), term).otherwise(0.0)).alias("_out"),
        F.sum(term).alias("_all"),
    )
    return sums.select(*keys, (F.col("_out") / F.nullif("_all", F.lit(0.0))).alias("share"))


def passages(
    lines: DataFrame, places: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Passage times: the places of a route (``name``, ``at_m``) plus its two ends."""
    ends = lines.groupBy(*keys).agg(F.max("end_m").alias("_len"))
    synthetic = ends.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("start").alias("name"), F.lit(0.0).alias("at_m")),
                F.struct(F.lit("finish").alias("name"), F.col("_len").alias("at_m")),
            )
        ),
    )
    wanted = synthetic.unionByName(places.select(*keys, "name", "at_m"))
    return time_at(wanted, lines, keys, "at_m", "passage_s")


def interval_speeds(lines: DataFrame) -> DataFrame:
    return lines.withColumn("speed_ms", 1.0 / F.col("pace"))


PaceExpression = Callable[[Column], Column]
