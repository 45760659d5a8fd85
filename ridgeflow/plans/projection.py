"""Projected passage times of routes, with a file curve or one known at an origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.operators import curve, ordered, origin, pace, route
from ridgeflow.operators.curve import CurveRules
from ridgeflow.session import cut_lineage


def profiles(points: DataFrame, keys: Sequence[str], **grid: float) -> DataFrame:
    """Route profiles, written once for every later use."""
    return cut_lineage(ordered.without_chunks(route.build_profile(points, keys, **grid)))


def with_knots(profile: DataFrame, knots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Profile rows with the curve of their key (one short array per curve)."""
    return profile.join(knots, list(keys)) if keys else profile.crossJoin(F.broadcast(knots))


def curve_timelines(
    profile: DataFrame,
    bins: DataFrame,
    keys: Sequence[str],
    curve_keys: Sequence[str] = (),
    effort: float = 1.0,
) -> DataFrame:
    """Timelines of profiles under speed-by-grade curves.

    ``curve_keys`` join a curve to its profiles (none: one curve for all)."""
    knots = pace.knot_table(bins, curve_keys)
    rows = with_knots(profile.filter(F.col("grade").isNotNull()), knots, curve_keys)
    lines = pace.timeline(
        rows,
        keys,
        pace.curve_pace(F.col("grade"), F.col("knots")),
        effort=effort,
        extrapolated=pace.is_extrapolated(F.col("grade"), F.col("knots")),
    )
    return lines.drop("knots")


def engine_timelines(
    profile: DataFrame, keys: Sequence[str], pace_expr: Column
) -> DataFrame:
    """Timelines of any other engine: its pace as a column of profile rows."""
    return pace.valid_timelines(pace.timeline(profile, keys, pace_expr), keys)


def project_routes(
    points: DataFrame,
    places: DataFrame | None,
    bins: DataFrame,
    keys: Sequence[str] = ("route_id",),
    effort: float = 1.0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, timelines, summaries) of routes under one curve."""
    profile = profiles(points, keys)
    lines = cut_lineage(curve_timelines(profile, bins, keys, effort=effort))
    if places is None:
        named = lines.select(*keys, F.lit("").alias("name"), F.col("end_m").alias("at_m")).limit(0)
    else:
        segments = ordered.without_chunks(
            route.polyline_steps(route.polyline(points, keys), keys)
        )
        named = route.place_passages(places, segments, profile, keys)
    return (
        pace.passages(lines, named, keys),
        lines,
        pace.projection_summary(lines, keys),
    )


def curves_at_origins(
    activities: DataFrame,
    origins: DataFrame,
    intervals: DataFrame,
    athlete: Sequence[str],
    rules: CurveRules,
) -> tuple[curve.CurveEstimate, DataFrame]:
    """Curves known at every (origin, window): (estimate, outcome per origin).

    An activity counts whole or not at all. ``intervals`` is any table of measured
    intervals (the materialised one, or the caller's own). Outcomes: no curve, not
    projectable, projectable."""
    keys = [*athlete, "origin", "window"]
    chosen = origin.select_at_origins(activities, origins, athlete).filter(
        F.col("decision") == "candidate"
    )
    rows = intervals.join(
        chosen.select(*athlete, "activity_ref", "origin", "window"), [*athlete, "activity_ref"]
    )
    estimate = curve.estimate(rows, keys, ["activity_ref"], rules)
    found = estimate.bins.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bins"), F.max("kept").alias("projectable")
    )
    outcome = origins.join(found, keys, "left").select(
        *origins.columns,
        F.coalesce("bins", F.lit(0)).alias("bins"),
        F.when(F.col("bins").isNull(), "no_curve")
        .when(F.col("projectable"), "projectable")
        .otherwise("not_projectable")
        .alias("outcome"),
    )
    return estimate, outcome


def curve_in_range(
    index: DataFrame,
    intervals: DataFrame,
    types: Sequence[str],
    date_from: str,
    date_to: str,
    rules: CurveRules,
    athlete: Sequence[str] = (),
) -> curve.CurveEstimate:
    """Curve of the activities of a date range and of given types."""
    chosen = curve.select_candidates(index, types, date_from, date_to)
    rows = intervals.join(chosen.select(*athlete, "activity_ref"), [*athlete, "activity_ref"])
    return curve.estimate(rows, list(athlete), ["activity_ref"], rules)
