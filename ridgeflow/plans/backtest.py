"""Backtest of models on matched outings: matching, scores, calibration, bands, drift,
rolling windows, sensitivity and admission experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.operators import (
    calibration,
    clocks,
    drift,
    effects,
    experiments,
    matching,
    ordered,
    pace,
    passages,
    route,
    scoring,
    track,
)
from ridgeflow.operators.matching import MatchRules
from ridgeflow.plans import projection
from ridgeflow.session import cut_lineage

OUTING = ["outing_id"]


@dataclass(frozen=True)
class Matched:
    """Everything observed of the outings, independent of any model."""

    profile: DataFrame
    points: DataFrame
    segments: DataFrame
    coverage: DataFrame
    passages: DataFrame
    partition: DataFrame
    segment_times: DataFrame
    targets: DataFrame
    trace_profile: DataFrame


def match_outings(
    route_points: DataFrame,
    places: DataFrame,
    records: DataFrame,
    keys: Sequence[str] = OUTING,
    rules: MatchRules = MatchRules(),
) -> Matched:
    """Routes and traces of all outings at once to score points, segments, passages.

    Tables that several steps read are written once on the way."""
    keys = list(keys)
    line = cut_lineage(ordered.without_chunks(route.polyline(route_points, keys)))
    profile = projection.profiles(route_points, keys)
    series = cut_lineage(matching.indexed(track.build_series(records, keys), keys))
    partition = cut_lineage(clocks.clock_partition(series.drop("i"), keys))
    points = cut_lineage(matching.match_points(line, series, keys, rules))
    segments = cut_lineage(
        matching.observe_segments(points, line, profile, series, keys, rules)
    )
    cover = cut_lineage(matching.coverage(segments, points, keys))
    parts = ordered.without_chunks(route.polyline_steps(line, keys))
    named = cut_lineage(route.place_passages(places, parts, profile, keys))
    observed = cut_lineage(
        passages.observe(
            named.select(*keys, "name", "at_m"), points, cover, line, series, partition, keys, rules
        )
    )
    times, targets = passages.observe_outing(segments, observed, points, cover, partition, keys)
    as_route = records.withColumn("seq", F.col("time_s"))
    return Matched(
        profile,
        points,
        segments,
        cover,
        observed,
        partition,
        cut_lineage(times),
        cut_lineage(targets),
        projection.profiles(as_route, keys),
    )


def forecasts(
    matched: Matched, usage: DataFrame, control: DataFrame, keys: Sequence[str] = OUTING
) -> tuple[DataFrame, DataFrame]:
    """(segment forecasts, target forecasts) of the timelines of several models.

    ``usage`` timelines run on the reference profile, ``control`` ones on the trace's
    own; both carry ``model``. A forecast is the difference of two readings."""
    keys = list(keys)
    line_keys = [*keys, "model"]
    models = usage.select("model").distinct()
    parts = []
    for scenario, lines, a, b in (
        ("usage", usage, "start_m", "end_m"),
        ("control", control, "realized_start_m", "realized_end_m"),
    ):
        # Models are a handful of names: the frame of segments times models is declared.
        asked = matched.segment_times.select(*keys, "k", "klass", a, b, "times").join(
            F.broadcast(models)
        )
        bounds = F.array(
            F.struct(F.lit(-1.0).alias("_sign"), F.col(a).alias("_m")),
            F.struct(F.lit(1.0).alias("_sign"), F.col(b).alias("_m")),
        )
        read = pace.time_at(asked.select("*", F.inline(bounds)), lines, line_keys, "_m", "_s")
        rows = read.groupBy(*line_keys, "k", "klass", "times").agg(
            F.sum(F.col("_sign") * F.col("_s")).alias("p")
        )
        parts.append(rows.withColumn("scenario", F.lit(scenario)))
    wanted = matched.targets.join(F.broadcast(models))
    at = pace.time_at(wanted, usage, line_keys, "s_m", "_p")
    base = pace.time_at(at, usage, line_keys, "origin_m", "_o")
    targets = base.withColumn("p", F.col("_p") - F.col("_o")).drop("_p", "_o")
    return parts[0].unionByName(parts[1]), targets


def score(
    segments: DataFrame, keys: Sequence[str] = OUTING, clock: Column | None = None
) -> scoring.SupportScores:
    """Scores of segment forecasts under every clock (or one)."""
    long = scoring.explode_clocks(segments)
    if clock is not None:
        long = long.filter(F.col("clock") == clock)
    return scoring.support_scores(long, [*keys, "model", "scenario", "clock"])


def usage_scores(
    targets: DataFrame, keys: Sequence[str], base_model: str, clock: int = 0
) -> DataFrame:
    """Usage targets of every model with the base model's forecast as weight."""
    base = targets.filter(F.col("model") == base_model).select(*keys, "k", F.col("p").alias("p0"))
    rows = targets.join(base, [*keys, "k"]).withColumn("t", F.get("times", F.lit(clock)))
    return scoring.usage_target(rows, [*keys, "model"])


def report_clocks(matched: Matched, keys: Sequence[str] = OUTING) -> DataFrame:
    """Clocks of the report: elapsed, moving under the lowest convention, moving or
    unknown under the highest."""
    totals = clocks.totals(matched.partition, keys)
    ends = clocks.convention_extremes(totals, keys)
    return ends.select(
        *keys,
        F.array(
            F.lit(0), F.col("low_convention") + 1, F.col("high_convention") + 6
        ).alias("clocks"),
    )


@dataclass(frozen=True)
class Backtest:
    """Tables of a backtest."""

    scores: scoring.SupportScores
    usage: DataFrame
    calibration: DataFrame
    calibrated: scoring.SupportScores
    bands: DataFrame
    drift: DataFrame
    means: DataFrame


def evaluate(
    matched: Matched,
    segments: DataFrame,
    targets: DataFrame,
    performances: DataFrame,
    *,
    athlete: Sequence[str] = ("athlete_id",),
    base_model: str = "curve",
    effort_models: Sequence[str] = ("curve",),
    clock: int = 0,
) -> Backtest:
    """Scores, calibration on the past, calibrated scores, bands, drift and means.

    ``performances``: ``outing_id``, athlete, ``civil_date``, ``origin``, ``end_time``
    (seconds), ``is_training``, ``is_race``, ``dataset``."""
    athlete = list(athlete)
    raw = score(segments)
    usage = usage_scores(targets, OUTING, base_model, clock)
    timed = segments.filter(F.col("scenario") == "usage").withColumn(
        "t", F.get("times", F.lit(clock))
    )
    totals = calibration.member_totals(timed, [*OUTING, "model"])
    members = cut_lineage(totals.join(performances, OUTING))
    keyed = [*athlete, "model"]
    fitted = calibration.calibrate(
        members.select(*keyed, *OUTING, "origin"), members, keyed, by_effort=True
    )
    effort = F.col("model").isin(*effort_models)
    fitted = cut_lineage(
        fitted.withColumn("factor", F.when(effort, F.col("factor")).otherwise(F.exp("beta")))
    )
    factors = fitted.select(*OUTING, "model", "factor", "calibration_motif")
    scaled = segments.join(factors, [*OUTING, "model"]).withColumn(
        "p", F.col("p") * F.col("factor")
    )
    calibrated = score(scaled.filter(F.col("calibration_motif").isNull()))
    known = calibration.prefix_ranks(
        members.select(*keyed, *OUTING, "origin"),
        calibration.reservoir(
            members.drop("factor"), fitted.select(*keyed, *OUTING, "factor", "calibration_motif"),
            keyed, OUTING,
        ),
        keyed, "origin", "end_time", "z", calibration.BAND_ORDERS,
    ).filter(F.col("n_known").isNotNull())
    base = targets.filter(F.col("model") == base_model)
    share = base.groupBy(*OUTING).agg(F.sum("p").alias("_all"))
    weights = base.join(share, OUTING).select(
        *OUTING, "k", F.col("p").alias("p0"), (F.col("p") / F.col("_all")).alias("w")
    )
    asked = (
        targets.join(weights, [*OUTING, "k"])
        .join(factors, [*OUTING, "model"])
        .withColumn("p", F.col("p") * F.col("factor"))
        .withColumn("t", F.get("times", F.lit(clock)))
    )
    _, bands = calibration.bands(
        asked.drop(*athlete), known.select(*OUTING, "model", "n_known", *calibration.BAND_ORDERS), [*OUTING, "model"]
    )
    slopes = drift.outing_drift(
        with_regimes(matched, asked, base_model), [*OUTING, "model"]
    )
    values = raw.overall.filter((F.col("scenario") == "usage") & (F.col("clock") == clock)).join(
        performances.select(*OUTING, "dataset"), OUTING
    )
    means = scoring.mean_with_missing(
        values.select("dataset", "model", F.abs("log_ratio").alias("value"), F.col("level_motif").alias("motif")),
        ["dataset", "model"],
    )
    return Backtest(raw, usage, fitted, calibrated, bands, slopes, means)


def with_regimes(matched: Matched, targets: DataFrame, base_model: str) -> DataFrame:
    """Targets with the base model's projected seconds per regime since the previous one."""
    spans = ordered.shift(
        matched.targets.select(*OUTING, "k", "s_m", "origin_m"),
        OUTING,
        ["k"],
        {"_prev": F.col("s_m")},
    )
    spans = ordered.without_chunks(spans).select(
        *OUTING, "k", F.coalesce("_prev", "origin_m").alias("start_m"), F.col("s_m").alias("end_m")
    )
    unit = matched.profile.withColumn("_pace", F.lit(1.0))
    shares = matching.regime_lengths(spans, unit, OUTING, 250.0, seconds="_pace")
    return targets.join(shares, [*OUTING, "k"], "left").fillna(
        0.0, ["ascent_s", "flat_s", "descent_s"]
    )


def repeatability(
    matched: Matched, outings: DataFrame, clock: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Leave-one-day-out references of routes run on several days.

    ``outings``: ``outing_id``, ``route_id``, ``civil_date``, ``single`` (one outing that
    day)."""
    cells = matched.segment_times.join(outings.filter("single"), OUTING).select(
        "route_id", F.col("civil_date").alias("day"), "k", "klass", F.get("times", F.lit(clock)).alias("t")
    )
    return effects.leave_one_day_out(cells, ["route_id"])


def rolling(
    matched: Matched,
    curves: Mapping[str, DataFrame],
    performances: DataFrame,
    athlete: Sequence[str] = ("athlete_id",),
) -> dict[str, Backtest]:
    """Each performance judged with the curve known at its own origin, per window.

    ``curves[window]``: kept bins keyed by ``outing_id``. An outing without a curve is
    scored by the baselines only. Windows are a short declared list."""
    baselines = pace.baseline_timelines(matched.profile, OUTING)
    own = pace.baseline_timelines(matched.trace_profile, OUTING)
    out = {}
    for window, bins in curves.items():
        usage = projection.curve_timelines(matched.profile, bins, OUTING, OUTING).withColumn(
            "model", F.lit("curve")
        )
        control = projection.curve_timelines(matched.trace_profile, bins, OUTING, OUTING).withColumn(
            "model", F.lit("curve")
        )
        segments, targets = forecasts(
            matched,
            usage.unionByName(baselines, allowMissingColumns=True),
            control.unionByName(own, allowMissingColumns=True),
        )
        out[window] = evaluate(
            matched, cut_lineage(segments), cut_lineage(targets), performances, athlete=athlete
        )
    return out


@dataclass(frozen=True)
class Effect:
    """A candidate effect: a pace engine written as a column of profile rows."""

    name: str
    pace: Column
    target: str = "usage"
    clock: int = 0
    weights: Mapping[str, float] = field(default_factory=dict)


def assess_effect(
    base: DataFrame, candidate: DataFrame, references: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Gain of a candidate over the base on the target metric of each performance.

    ``base`` / ``candidate``: keys, ``value``, ``motif``; ``references``: keys, ``f``."""
    joined = (
        base.select(*keys, F.col("value").alias("_b"), F.col("motif").alias("_bm"))
        .join(candidate.select(*keys, F.col("value").alias("_c"), F.col("motif").alias("_cm")), list(keys))
        .join(references.select(*keys, "f"), list(keys), "left")
    )
    return joined.select(
        *keys,
        (F.abs("_b") - F.abs("_c")).alias("gain"),
        experiments.gain_threshold(F.col("f")).alias("threshold"),
        F.coalesce("_bm", "_cm").alias("motif"),
    )


def declared_run(log: DataFrame, path: str, declaration: DataFrame, run, payload: Sequence[str]):
    """Appends a declaration to a chained log, runs, then appends a result or a failure.

    ``declaration`` is one row with the payload columns; the declaration is written
    before anything is computed. A failure is recorded and raised again."""
    from ridgeflow.sources.tables import append_events

    spark = log.sparkSession
    opened = cut_lineage(experiments.next_events(log, declaration, payload))
    append_events(opened, path)
    number = opened.select("number").collect()[0][0]
    result, failure = None, None
    try:
        result = run()
    except Exception as error:  # noqa: BLE001 recorded below, then raised
        failure = error
    kind = "result" if failure is None else "failure"
    current = spark.read.parquet(path)
    answer = declaration.withColumn("kind", F.lit(kind)).withColumn("declared", F.lit(number))
    append_events(
        cut_lineage(
            experiments.next_events(current, answer.select(*declaration.columns), payload)
        ),
        path,
    )
    if failure is not None:
        raise failure
    return result
