"""Sensitivity of a backtest: nineteen configurations as rows, nine matchings, one evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeflow.operators import clocks, experiments, matching, ordered, passages, route, scoring, track
from ridgeflow.operators.matching import MatchRules
from ridgeflow.plans import projection
from ridgeflow.session import cut_lineage

# Steps between score points and lateral tolerances (m), the central pair, the
# number of clocks, and the reserves of a sensitivity in their order.
STEPS_M = (100.0, 250.0, 500.0)
TOLERANCES_M = (15.0, 30.0, 45.0)
CENTRAL_M = (250.0, 30.0)
CLOCKS = 11
RESERVES = ("sign_changed", "verdict_changed", "evaluability_lost", "sign_unverifiable")


@dataclass(frozen=True)
class Configuration:
    """A pair of matching rules and the clock that is read under it."""

    number: int
    step_m: float
    tolerance_m: float
    clock: int


def configurations() -> list[Configuration]:
    """Nine pairs under elapsed time, then the central pair under the ten moving clocks."""
    elapsed = [(step, tolerance, 0) for step in STEPS_M for tolerance in TOLERANCES_M]
    moving = [(*CENTRAL_M, clock) for clock in range(1, CLOCKS)]
    return [Configuration(n, *c) for n, c in enumerate([*elapsed, *moving])]


def configuration_table(spark: SparkSession) -> DataFrame:
    rows = [(c.number, c.step_m, c.tolerance_m, c.clock) for c in configurations()]
    return spark.createDataFrame(rows, "configuration int, step_m double, tolerance_m double, clock int")


def comparator() -> int:
    """The configuration that others are compared with: the central pair under elapsed time."""
    return next(c.number for c in configurations() if (c.step_m, c.tolerance_m, c.clock) == (*CENTRAL_M, 0))


def observe_pairs(
    route_points: DataFrame,
    places: DataFrame,
    records: DataFrame,
    keys: Sequence[str],
    rules: MatchRules = MatchRules(),
    pairs: Sequence[tuple[float, float]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(segment times, targets) of every pair of matching rules, with ``step_m`` and
    ``tolerance_m`` as columns.

    What no pair changes is made once and written: the polyline, the profile, the track with
    its realized distances and the clocks of its intervals. A pair only crosses the traces and
    cuts the segments; the ten moving clocks need no matching of their own."""
    keys = list(keys)
    line = cut_lineage(ordered.without_chunks(route.polyline(route_points, keys)))
    profile = projection.profiles(route_points, keys)
    series = cut_lineage(matching.indexed(track.build_series(records, keys), keys))
    partition = cut_lineage(clocks.clock_partition(series.drop("i"), keys))
    steps = ordered.without_chunks(route.polyline_steps(line, keys))
    named = cut_lineage(route.place_passages(places, steps, profile, keys)).select(*keys, "name", "at_m")
    times, targets = [], []
    for step, tolerance in pairs or dict.fromkeys((c.step_m, c.tolerance_m) for c in configurations()):
        own = replace(rules, step_m=step, tolerance_m=tolerance)
        points = cut_lineage(matching.match_points(line, series, keys, own))
        segments = cut_lineage(matching.observe_segments(points, line, profile, series, keys, own))
        cover = cut_lineage(matching.coverage(segments, points, keys))
        seen = passages.observe(named, points, cover, line, series, partition, keys, own)
        found = passages.observe_outing(segments, cut_lineage(seen), points, cover, partition, keys)
        for table, out in zip(found, (times, targets), strict=True):
            out.append(table.withColumn("step_m", F.lit(step)).withColumn("tolerance_m", F.lit(tolerance)))
    stacked = (reduce(lambda a, b: a.unionByName(b), tables) for tables in (times, targets))
    return tuple(cut_lineage(t) for t in stacked)


def configured_scores(
    forecast: DataFrame, keys: Sequence[str], models: str = "model", deal: ordered.Deal | None = None
) -> DataFrame:
    """Values of every configuration from stacked forecasts, read twice where they lie.

    ``forecast``: keys, ``model``, ``step_m``, ``tolerance_m``, ``k``, ``klass``, ``p`` and ``times`` (a
    duration per clock). A row is read under the clocks of the configurations of its pair.
    ``deal``: how the rows lie if they are dealt by keys and ``k``; else they are dealt here.
    The rows of a configuration are made in the tasks that add them up, so that neither
    shuffles nor sorts grow with the number of configurations.
    Returns keys, ``model``, ``configuration``, ``metric``, ``value``, ``motif`` and ``signature``, a
    digest of the segments that stand behind a value, whatever their order."""
    if deal is None:
        forecast, deal = ordered.deal(forecast, keys, "k")
    keys = [*keys, models]
    table = F.broadcast(configuration_table(forecast.sparkSession))  # nineteen rows
    rows = forecast.join(table, ["step_m", "tolerance_m"]).withColumn("t", F.get("times", "clock"))
    rows = rows.filter(F.col("t").isNotNull()).drop("times")
    own = [*keys, "configuration"]
    scores = scoring.support_scores(rows, own, written=True, deal=deal, member="k")
    level = scores.overall.select(
        *own, F.lit("level").alias("metric"), F.col("log_ratio").alias("value"), F.col("level_motif").alias("motif"), "signature"
    )
    by_class = [
        scores.classes.select(
            *own, F.concat("klass", F.lit(f"_{name}")).alias("metric"), F.col(column).alias("value"), "motif", "signature"
        )
        for name, column in (("level", "class_level"), ("dispersion", "class_dispersion"))
    ]
    # Written: a comparison reads the values twice.
    return cut_lineage(reduce(lambda a, b: a.unionByName(b), by_class, level))


def comparisons(values: DataFrame, keys: Sequence[str], against: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(values beside those of the comparator, counts per configuration and metric)."""
    against = comparator() if against is None else against
    base = values.filter(F.col("configuration") == against)
    compared = experiments.compare_values(values, base, [*keys, "metric"])
    return compared, experiments.axis_counts(compared, ["configuration", "metric"])


def compared_gains(assessments: DataFrame, keys: Sequence[str], against: int | None = None) -> DataFrame:
    """Gain of each performance under each configuration beside the comparator's.

    ``assessments``: ``configuration``, keys of a performance, ``gain``, ``motif``. Adds the sign
    classes, ``comparable`` (both gains stand), ``entering`` and ``leaving`` (evaluable on one
    side only)."""
    against = comparator() if against is None else against
    keys = list(keys)
    base = assessments.filter(F.col("configuration") == against).select(
        *keys, F.col("gain").alias("base_gain"), F.col("motif").alias("base_motif")
    )
    both = assessments.join(base, keys)

    def sign(gain: str):
        return F.when(F.col(gain).isNotNull(), experiments.sign_class(F.col(gain)))

    return both.withColumn("sign", sign("gain")).withColumn("base_sign", sign("base_gain")).select(
        "configuration",
        *keys,
        "gain",
        "motif",
        "sign",
        "base_gain",
        "base_motif",
        "base_sign",
        (F.col("gain").isNotNull() & F.col("base_gain").isNotNull()).alias("comparable"),
        (F.col("motif").isNull() & F.col("base_motif").isNotNull()).alias("entering"),
        (F.col("motif").isNotNull() & F.col("base_motif").isNull()).alias("leaving"),
    )


def reserves(
    gains: DataFrame, admissions: DataFrame, guards: DataFrame, against: int | None = None
) -> DataFrame:
    """Reserves of every configuration, with its common set.

    ``gains``: of ``compared_gains``; ``admissions``: of ``experiments.admit`` by configuration
    (``mean_gain``, ``verdict``; ``not_evaluable`` is no decision); ``guards``: ``configuration``,
    ``metric``, ``harm`` (null where it could not be computed). One row per configuration:
    ``comparable``, ``entering``, ``leaving``, the two means over the comparable performances, and
    the four reserves."""
    against = comparator() if against is None else against
    count = lambda c: F.sum(F.col(c).cast("long"))
    both = F.col("comparable")
    sums = gains.groupBy("configuration").agg(
        *(count(c).alias(c) for c in ("comparable", "entering", "leaving")),
        F.avg(F.when(both, F.col("base_gain"))).alias("common_base_gain"),
        F.avg(F.when(both, F.col("gain"))).alias("common_gain"),
        F.max(both & (F.col("sign") != F.col("base_sign"))).alias("_moved"),
    )
    decided = admissions.select(
        "configuration",
        F.when(F.col("verdict") != "not_evaluable", F.col("verdict")).alias("verdict"),
        F.when(
            (F.col("verdict") != "not_evaluable") & F.col("mean_gain").isNotNull(), experiments.sign_class(F.col("mean_gain"))
        ).alias("mean_sign"),
    )
    base = decided.filter(F.col("configuration") == against).select(
        F.col("verdict").alias("base_verdict"), F.col("mean_sign").alias("base_mean_sign")
    )
    # A guard stands in a decision only; of the comparator's, those that a configuration lacks.
    computed = guards.groupBy("configuration", "metric").agg((F.max(F.col("harm").isNull()) == F.lit(False)).alias("ok"))
    computed = computed.filter("ok").join(decided.filter(F.col("verdict").isNotNull()).select("configuration"), "configuration", "left_semi")
    needed = computed.filter(F.col("configuration") == against).select("metric")
    have = computed.join(needed, "metric", "left_semi").groupBy("configuration").agg(F.count(F.lit(1)).alias("_have"))
    wanted = needed.agg(F.count(F.lit(1)).alias("_wanted"))
    out = (
        sums.join(decided, "configuration", "left")
        .crossJoin(F.broadcast(base.agg(F.first("base_verdict").alias("base_verdict"), F.first("base_mean_sign").alias("base_mean_sign"))))  # one row
        .crossJoin(F.broadcast(wanted))  # one row
        .join(have, "configuration", "left")
    )
    turned = F.coalesce(F.col("mean_sign") != F.col("base_mean_sign"), F.lit(False))
    lost = F.col("base_verdict").isNotNull() & ((F.col("leaving") > 0) | (F.coalesce("_have", F.lit(0)) < F.col("_wanted")))
    return out.select(
        "configuration",
        "comparable",
        "entering",
        "leaving",
        "common_base_gain",
        "common_gain",
        "verdict",
        (turned | F.coalesce("_moved", F.lit(False))).alias("sign_changed"),
        (~F.col("verdict").eqNullSafe(F.col("base_verdict"))).alias("verdict_changed"),
        lost.alias("evaluability_lost"),
        (F.col("comparable") == 0).alias("sign_unverifiable"),
    )


def qualification(declared: bool, outcome: DataFrame | None) -> tuple[str, list[str]]:
    """What a sensitivity says of its central run, and the reserves that some configuration has."""
    if not declared:
        if outcome is not None:
            raise ValueError("an outcome without a declaration")
        return "sensitivity_remaining", []
    if outcome is None:
        return "sensitivity_incomplete", []
    found = outcome.agg(*(F.max(r).alias(r) for r in RESERVES)).first()
    held = [r for r in RESERVES if found[r]]
    return ("sensitivity_reserved" if held else "sensitivity_done"), held
