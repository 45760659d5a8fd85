"""Experiment log, sensitivity comparisons and admission of an effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.operators import ordered

GENESIS = ""


def with_line_hash(events: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Adds the fingerprint of each line (all payload columns, in order)."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload))
    return events.withColumn("line_sha256", F.sha2(line, 256))


def chain_violations(
    events: DataFrame, log: Sequence[str], payload: Sequence[str]
) -> DataFrame:
    """Lines whose number does not follow, or whose previous fingerprint is not that of
    the line before."""
    hashed = with_line_hash(events, payload)
    back = ordered.shift(
        hashed, log, ["number"], {"_n": F.col("number"), "_h": F.col("line_sha256")}
    )
    expected = F.coalesce("_h", F.lit(GENESIS))
    reason = F.coalesce(
        F.when(F.col("number") != F.coalesce("_n", F.lit(0)) + 1, "number"),
        F.when(F.col("previous_sha256") != expected, "hash"),
    )
    return ordered.without_chunks(back).withColumn("reason", reason).filter(
        F.col("reason").isNotNull()
    ).drop("_n", "_h")


def next_events(log: DataFrame, additions: DataFrame, payload: Sequence[str]) -> DataFrame:
    """One addition as the next event of a log: numbered and chained to its last line."""
    last = with_line_hash(log, payload).agg(
        F.coalesce(F.max("number"), F.lit(0)).alias("_n"),
        F.max_by("line_sha256", "number").alias("_h"),
    )
    return additions.crossJoin(F.broadcast(last)).select(  # one row
        (F.col("_n") + 1).alias("number"),
        F.coalesce("_h", F.lit(GENESIS)).alias("previous_sha256"),
        *additions.columns,
    )


def unanswered_results(log: DataFrame) -> DataFrame:
    """Results or failures whose declaration is missing or comes later."""
    declarations = log.filter(F.col("kind") == "declaration").select(
        F.col("number").alias("declared"), F.lit(True).alias("_ok")
    )
    answers = log.filter(F.col("kind").isin("result", "failure"))
    joined = answers.join(declarations, "declared", "left")
    return joined.filter(F.col("_ok").isNull() | (F.col("declared") >= F.col("number"))).drop("_ok")


def trial_counts(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Declarations, corrections, sensitivities and declarations without effect."""
    declared = log.filter(F.col("kind") == "declaration")
    sensitivity = F.col("is_sensitivity")
    return declared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("declarations"),
        F.count("corrects").alias("corrections"),
        F.sum(F.when(sensitivity, 1).otherwise(0)).alias("sensitivities"),
        F.sum(F.when(~sensitivity & F.col("effect").isNull(), 1).otherwise(0)).alias(
            "without_effect"
        ),
    )


def trials_by_effect(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    declared = log.filter(
        (F.col("kind") == "declaration") & ~F.col("is_sensitivity") & F.col("effect").isNotNull()
    )
    return declared.groupBy(*keys, "effect", "target").agg(F.count(F.lit(1)).alias("trials"))


def compare_values(
    configurations: DataFrame, comparator: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Each configuration's value beside the comparator's: availability, change of the
    support signature, difference."""
    base = comparator.select(
        *keys, F.col("value").alias("base_value"), F.col("signature").alias("base_signature")
    )
    joined = configurations.join(base, list(keys), "left")
    has, had = F.col("value").isNotNull(), F.col("base_value").isNotNull()
    availability = (
        F.when(has & had, "both").when(had, "lost").when(has, "gained").otherwise("neither")
    )
    return (
        joined.withColumn("availability", availability)
        .withColumn("support_changed", ~F.col("signature").eqNullSafe(F.col("base_signature")))
        .withColumn("difference", F.col("value") - F.col("base_value"))
    )


def axis_counts(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of the availability axis and of changed supports per configuration."""
    return compared.groupBy(*keys).agg(
        *(
            F.sum(F.when(F.col("availability") == a, 1).otherwise(0)).alias(a)
            for a in ("both", "lost", "gained", "neither")
        ),
        F.sum(F.when(F.col("support_changed"), 1).otherwise(0)).alias("support_changed"),
        F.max(F.abs("difference")).alias("largest_difference"),
    )


# Gain floor and share, harm floor, share and limit, passage tolerance.
GAIN_FLOOR, GAIN_SHARE = 0.010, 0.25
HARM_FLOOR, HARM_SHARE, HARM_MAX_FACTOR = 0.005, 0.10, 2.0
PASSAGE_TOLERANCE = 0.01
NUMERIC_TOLERANCE = 1e-6


def sign_class(gain: Column) -> Column:
    return (
        F.when(gain > NUMERIC_TOLERANCE, 1).when(gain < -NUMERIC_TOLERANCE, -1).otherwise(0)
    )


def gain_threshold(reference: Column, floor: float = GAIN_FLOOR, share: float = GAIN_SHARE) -> Column:
    """Larger of a floor and a share of the repeatability reference (floor without one)."""
    return F.greatest(F.lit(floor), share * F.coalesce(reference, F.lit(0.0)))


def admit(
    assessments: DataFrame, guards: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Verdict on an effect from its assessed performances and guard values.

    ``assessments``: keys, ``gain``, ``threshold``, ``motif`` (null = evaluable);
    ``guards``: keys, ``metric``, ``harm``, ``threshold``. Provisional when the mean gain
    passes the mean threshold, three quarters of the performances gain, none loses more
    than its threshold and no guard is broken; to review when a value is missing."""
    keys = list(keys)
    evaluable = F.col("motif").isNull()
    gain = F.col("gain")
    positive = F.sum(F.when(evaluable & (gain > NUMERIC_TOLERANCE), 1).otherwise(0))
    n = F.sum(F.when(evaluable, 1).otherwise(0))
    known = F.count(F.when(evaluable, gain))
    loss = F.sum(
        F.when(evaluable & (gain < -F.col("threshold") - NUMERIC_TOLERANCE), 1).otherwise(0)
    )
    sums = assessments.groupBy(*keys).agg(
        n.alias("evaluable"),
        known.alias("gains"),
        F.avg(F.when(evaluable, gain)).alias("_mean"),
        F.avg(F.when(evaluable, F.col("threshold"))).alias("mean_threshold"),
        positive.alias("positive"),
        loss.alias("losses"),
    )
    by_metric = guards.groupBy(*keys, "metric").agg(
        F.avg("harm").alias("_h"),
        F.avg("threshold").alias("_t"),
        F.max(F.col("harm") > HARM_MAX_FACTOR * F.col("threshold") + NUMERIC_TOLERANCE).alias("_x"),
        F.max(F.col("harm").isNull()).alias("_gone"),
    )
    broken = (F.col("_h") > F.col("_t") + NUMERIC_TOLERANCE) | F.col("_x")
    guard = by_metric.groupBy(*keys).agg(
        F.sum(F.when(F.coalesce(broken, F.lit(False)), 1).otherwise(0)).alias("guards_broken"),
        F.max("_gone").alias("_guard_gone"),
    )
    out = sums.join(guard, keys, "left").fillna(0, ["guards_broken"])
    whole = F.col("gains") == F.col("evaluable")
    out = out.withColumn("mean_gain", F.when(whole, F.col("_mean"))).withColumn(
        "required", F.ceil(F.col("evaluable") * 3 / F.lit(4))
    )
    review = ~whole | F.coalesce("_guard_gone", F.lit(False))
    missing = F.col("evaluable") - F.col("gains")
    failed = (
        (F.coalesce(F.col("mean_gain") < F.col("mean_threshold") - NUMERIC_TOLERANCE, F.lit(False)))
        | (F.col("positive") + missing < F.col("required"))
        | (F.col("losses") > 0)
        | (F.col("guards_broken") > 0)
    )
    verdict = (
        F.when(F.col("evaluable") == 0, "not_evaluable")
        .when(review, "to_review")
        .when(failed, "rejected")
        .otherwise("provisional")
    )
    return out.withColumn("verdict", verdict).drop("_mean", "_guard_gone")


def latest_run(runs: DataFrame, keys: Sequence[str], provenance: Column) -> DataFrame:
    """Most recent readable run whose provenance is the current one, and how many could
    not be read."""
    usable = F.col("readable") & (F.col("provenance") == provenance)
    return runs.groupBy(*keys).agg(
        F.max_by(F.when(usable, F.col("run")), F.when(usable, F.col("written_at"))).alias("latest"),
        F.sum(F.when(F.col("readable"), 0).otherwise(1)).alias("unreadable"),
    )


def decisive_exports(entries: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(activities of the latest export that has them, retired ones).

    ``entries``: keys, ``activity_ref``, ``position`` (order of acquisition), ``sha``. An
    activity absent from the last export of its key is retired."""
    keys = list(keys)
    last = entries.groupBy(*keys).agg(F.max("position").alias("_last"))
    per = entries.groupBy(*keys, "activity_ref").agg(
        F.max("position").alias("decisive"),
        F.count(F.lit(1)).alias("exports"),
        F.count_distinct("sha").alias("versions"),
    )
    joined = per.join(last, keys) if keys else per.crossJoin(F.broadcast(last))
    current = F.col("decisive") == F.col("_last")
    return joined.filter(current).drop("_last"), joined.filter(~current).drop("_last")
