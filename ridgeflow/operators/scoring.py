"""Scores of forecasts against observed times, as two-level aggregations.

Segment tables: key columns (outing, model, scenario, clock ...), projected ``p``,
observed ``t`` and regime ``klass``. Motifs of unavailable values follow the order
observation first, then model."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.functions.grades import is_invalid_output, is_thin
from ridgeflow.operators import ordered
from ridgeflow.session import cut_lineage, joins_in_place

INSUFFICIENT = "insufficient_support"
ZERO_TIME = "zero_time"
MODEL_ERROR = "model_error"
NOT_CALIBRATED = "not_calibrated"


@dataclass(frozen=True)
class SupportScores:
    """``overall``: one row per key; ``classes``: one row per key and class."""

    overall: DataFrame
    classes: DataFrame


def log_ratio(p: Column, t: Column) -> Column:
    """ln(p / t) of two positive numbers, null otherwise."""
    return F.when((p > 0) & (t > 0), F.log(p / F.nullif(t, F.lit(0.0))))


def support_scores(
    segments: DataFrame,
    keys: Sequence[str],
    p: str = "p",
    t: str = "t",
    klass: str = "klass",
    *,
    written: bool = False,
    deal: ordered.Deal | None = None,
    member: str | None = None,
) -> SupportScores:
    """Level L, dispersion A, within W, between B, compensation, and per class E, D.

    Totals by class combine on the map side; only they are joined back to the segments,
    whose weighted deviations are then summed again. ``written`` cuts both tables of
    classes, so that the results, read however often, pass over the segments twice in all.
    Segments dealt by some of the keys (``deal``) are summed and joined where they lie: only
    tables of classes move. ``member`` names a segment; both results then have a ``signature``
    of the key's segments."""
    keys = list(keys)
    bad = is_invalid_output(F.col(p))
    marks = {} if member is None else dict(zip(("sum", "xor"), _fingerprint(F.xxhash64(member)), strict=True))
    by_class = segments.groupBy(*keys, klass).agg(
        F.count(F.lit(1)).alias("n_c"),
        F.sum(F.when(~bad, F.col(p))).alias("p_c"),
        F.sum(t).alias("t_c"),
        F.max(bad).alias("bad_c"),
        F.max(F.col(t) == 0).alias("zero_c"),
        *(mark.alias(f"{name}_c") for name, mark in marks.items()),
    )
    if written:
        by_class = cut_lineage(by_class)
    if deal is not None:
        by_class = by_class.repartition(deal.pieces, *(k for k in deal.by if k in keys))
    totals = by_class.groupBy(*keys).agg(
        F.sum("n_c").alias("n"),
        F.sum("p_c").alias("p_all"),
        F.sum("t_c").alias("t_all"),
        F.max("bad_c").alias("model_error"),
        F.max("zero_c").alias("has_zero"),
        *((F.sum if name == "sum" else F.bit_xor)(f"{name}_c").alias(f"{name}_hash") for name in marks),
    )
    if marks:
        totals = totals.withColumn("signature", F.concat_ws("-", "n", "sum_hash", "xor_hash")).drop("sum_hash", "xor_hash")
    level_motif = F.when(F.col("t_all") == 0, ZERO_TIME).when(
        F.col("model_error"), MODEL_ERROR
    )
    vector_motif = F.when(F.col("has_zero"), ZERO_TIME).when(
        F.col("model_error"), MODEL_ERROR
    )
    totals = totals.withColumn("level_motif", level_motif).withColumn(
        "vector_motif", vector_motif
    ).withColumn(
        "log_ratio", F.when(level_motif.isNull(), log_ratio(F.col("p_all"), F.col("t_all")))
    )
    centers = by_class.join(totals, keys).withColumn(
        "class_level",
        F.when(F.col("vector_motif").isNull(), log_ratio(F.col("p_c"), F.col("t_c"))),
    )
    usable = centers.filter(F.col("vector_motif").isNull()).select(
        *keys, klass, "class_level", "log_ratio"
    )
    r = F.log(F.col(p) / F.nullif(F.col(t), F.lit(0.0)))
    near, far = F.abs(r - F.col("class_level")), F.abs(r - F.col("log_ratio"))
    lift = F.abs(F.col("class_level") - F.col("log_ratio"))
    at = [*keys, klass]
    if deal is not None:
        at += [k for k in deal.by if k not in keys]
        # A few rows a key are looked up, the segments are not sorted.
        usable = (usable if deal.hot is None else deal.spread(usable)).hint("shuffle_hash")
    deviations = (
        segments.select(*at, p, t)
        .join(usable, at)
        .groupBy(*keys, klass)
        .agg(
            F.sum(F.col(t) * far).alias("_a"),
            F.sum(F.col(t) * near).alias("_d"),
            F.sum(F.col(t) * ((near + lift) - far)).alias("_c"),
        )
    )
    full = centers.join(deviations, [*keys, klass], "left")
    if written:
        with nullcontext() if deal is None else joins_in_place(full.sparkSession):
            full = cut_lineage(full)
    classes = full.select(
        *keys,
        klass,
        F.col("n_c").alias("n"),
        is_thin(F.col("n_c")).alias("thin"),
        "class_level",
        (F.col("_d") / F.nullif(F.col("t_c"), F.lit(0.0))).alias("class_dispersion"),
        (F.col("class_level") - F.col("log_ratio")).alias("class_offset"),
        F.col("vector_motif").alias("motif"),
        *(["signature"] if marks else []),
    )
    weight = F.col("t_c") / F.nullif(F.col("t_all"), F.lit(0.0))
    same = [c for c in totals.columns if c not in keys] if written else []
    sums = full.groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in same),
        (F.sum("_a") / F.nullif(F.max("t_all"), F.lit(0.0))).alias("dispersion"),
        F.sum(weight * F.col("_d") / F.nullif(F.col("t_c"), F.lit(0.0))).alias("within"),
        F.sum(weight * lift).alias("between"),
        (F.sum("_c") / F.nullif(F.max("t_all"), F.lit(0.0))).alias("compensation"),
    )
    overall = (sums if written else totals.join(sums, keys)).select(
        *keys,
        "n",
        "model_error",
        "log_ratio",
        "level_motif",
        "dispersion",
        "within",
        "between",
        "compensation",
        "vector_motif",
        *(["signature"] if marks else []),
    )
    return SupportScores(overall, classes)


def positive_time_scores(
    segments: DataFrame, keys: Sequence[str], p: str = "p", t: str = "t", klass: str = "klass"
) -> SupportScores:
    """The same scores on segments of positive time; an invalid output anywhere in the
    whole support still makes them unavailable."""
    keys = list(keys)
    flags = segments.groupBy(*keys).agg(F.max(is_invalid_output(F.col(p))).alias("_err"))
    kept = segments.filter(F.col(t) > 0).join(flags, keys)
    forced = kept.withColumn(p, F.when(~F.col("_err"), F.col(p))).drop("_err")
    return support_scores(forced, keys, p, t, klass)


def level_envelope(p: Column, low_s: Column, high_s: Column) -> dict[str, Column]:
    """Interval of ln(P / T) when the admissible time runs over [low ; high]."""
    open_ = (high_s > 0) & ~is_invalid_output(p)
    lower = F.when(open_, F.log(p / F.nullif(high_s, F.lit(0.0))))
    upper = F.when(open_ & (low_s == 0), F.lit(float("inf"))).when(
        open_, F.log(p / F.nullif(low_s, F.lit(0.0)))
    )
    crosses = (lower <= 0) & (upper >= 0)
    smallest = F.when(crosses, 0.0).otherwise(F.least(F.abs(lower), F.abs(upper)))
    motif = (
        F.when(high_s == 0, ZERO_TIME)
        .when(is_invalid_output(p), MODEL_ERROR)
        .when(low_s == 0, ZERO_TIME)
    )
    return {
        "lower": lower,
        "upper": upper,
        "min_abs": F.when(open_, smallest),
        "envelope_motif": motif,
    }


def passage_errors(points: DataFrame, p: str = "p", t: str = "t", motif: str = "motif") -> DataFrame:
    """Adds ``error`` (P - T) and ``error_motif`` to each point."""
    bad = is_invalid_output(F.col(p))
    return points.withColumn(
        "error", F.when(F.col(t).isNotNull() & ~bad, F.col(p) - F.col(t))
    ).withColumn(
        "error_motif", F.when(F.col(t).isNull(), F.col(motif)).when(bad, MODEL_ERROR)
    )


def passage_summary(
    points: DataFrame, keys: Sequence[str], p: str = "p", t: str = "t", motif: str = "motif"
) -> DataFrame:
    """Largest absolute, largest and smallest passage error of each key."""
    errors = passage_errors(points, p, t, motif)
    sums = errors.groupBy(*keys).agg(
        F.count(t).alias("observed"),
        F.max(is_invalid_output(F.col(p))).alias("model_error"),
        F.max(F.abs("error")).alias("_abs"),
        F.max("error").alias("_max"),
        F.min("error").alias("_min"),
    )
    status = F.when(F.col("observed") == 0, INSUFFICIENT).when(
        F.col("model_error"), MODEL_ERROR
    )
    shown = {"max_abs_error": "_abs", "max_error": "_max", "min_error": "_min"}
    return sums.select(
        *keys,
        "observed",
        "model_error",
        *(F.when(status.isNull(), F.col(c)).alias(n) for n, c in shown.items()),
        status.alias("status"),
    )


def default_targets(passages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Default usage targets: each intermediate passage, then one arrival per key (the
    first passage of that role, or none)."""
    middle = passages.filter(F.col("role") == "intermediate").select(
        *keys, "rank", F.lit(False).alias("is_arrival")
    )
    ends = passages.groupBy(*keys).agg(
        F.min(F.when(F.col("role") == "arrival", F.col("rank"))).alias("rank")
    )
    return middle.unionByName(ends.select(*keys, "rank", F.lit(True).alias("is_arrival")))


def usage_target(
    targets: DataFrame,
    keys: Sequence[str],
    *,
    p: str = "p",
    base: str = "p0",
    t: str = "t",
    motif: str = "motif",
    order: str = "k",
    weight: str | None = None,
    base_motif: str | None = None,
) -> DataFrame:
    """Weighted mean relative error over the targets, whole and on the observed ones.

    Default weights are base shares, so the sums need no second pass over the rows. The
    first missing target names the reason the whole is unavailable; ``base_motif`` is
    the reason of an absent base, after the observation and before the model."""
    bad_p, bad_b = is_invalid_output(F.col(p)), is_invalid_output(F.col(base))
    seen = F.col(t).isNotNull()
    w = F.col(base) if weight is None else F.col(weight)
    term = w * F.abs(F.col(p) - F.col(t)) / F.when(F.col(base) != 0, F.col(base))
    missing = F.when(F.col(motif).isNotNull(), F.col(order))
    late = F.lit(None).cast("string") if base_motif is None else F.max(base_motif)
    sums = targets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("targets"),
        F.count(t).alias("available"),
        F.sum(F.when(seen & (F.col(t) > 0), 1).otherwise(0)).alias("comparable"),
        F.max(bad_p | bad_b).alias("model_error"),
        F.max(bad_b).alias("_bad_base"),
        F.sum(w).alias("_w"),
        F.sum(F.when(seen, w)).alias("_w_seen"),
        F.sum(term).alias("_whole"),
        F.min_by(motif, missing).alias("_first"),
        late.alias("_late"),
    )
    whole_motif = F.coalesce(
        F.col("_first"), F.col("_late"), F.when(F.col("model_error"), MODEL_ERROR)
    )
    no_weight = ~F.col("_bad_base") & (F.coalesce("_w_seen", F.lit(0.0)) == 0)
    prefix_motif = F.coalesce(
        F.when(F.col("available") == 0, INSUFFICIENT),
        F.when(no_weight, INSUFFICIENT),
        F.col("_late"),
        F.when(F.col("model_error"), MODEL_ERROR),
    )
    total = F.col("_w") if weight is None else F.lit(1.0)
    return sums.select(
        *keys,
        "targets",
        "available",
        "comparable",
        "model_error",
        F.when(whole_motif.isNull(), F.col("_whole") / total).alias("usage"),
        whole_motif.alias("usage_motif"),
        F.when(
            prefix_motif.isNull(), F.col("_whole") / F.nullif("_w_seen", F.lit(0.0))
        ).alias("usage_prefix"),
        prefix_motif.alias("prefix_motif"),
    )


def common_usage(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of absolute errors over the sum of a common base forecast."""
    return rows.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("p") - F.col("t"))) / F.sum("p0")).alias("usage_common")
    )


def explode_clocks(segment_times: DataFrame, times: str = "times") -> DataFrame:
    """One row per segment and clock from an array of durations (``clock``, ``t``)."""
    columns = [c for c in segment_times.columns if c != times]
    return segment_times.select(*columns, F.posexplode(times).alias("clock", "t"))


def outing_envelope(
    segment_times: DataFrame, forecasts: DataFrame, keys: Sequence[str], outing: Sequence[str]
) -> DataFrame:
    """Envelope of L over the ten moving clocks of each forecast."""
    sums = (
        explode_clocks(segment_times)
        .filter(F.col("clock") > 0)
        .groupBy(*outing, "clock")
        .agg(F.sum("t").alias("t"))
        .groupBy(*outing)
        .agg(F.min("t").alias("low_s"), F.max("t").alias("high_s"))
    )
    projected = forecasts.groupBy(*keys).agg(
        F.when(~F.max(is_invalid_output(F.col("p"))), F.sum("p")).alias("p")
    )
    joined = projected.join(sums, list(outing))
    bounds = level_envelope(F.col("p"), F.col("low_s"), F.col("high_s"))
    return joined.select(*keys, "low_s", "high_s", *(c.alias(n) for n, c in bounds.items()))


def mean_with_missing(
    values: DataFrame, keys: Sequence[str], value: str = "value", motif: str = "motif"
) -> DataFrame:
    """Equal-weight mean of a metric over performances, missing ones counted by reason.

    Returns ``mean``, ``count`` and ``missing`` (sorted reason/number pairs): counts per
    reason come first, so the collected list is as short as the list of reasons."""
    per_reason = values.groupBy(*keys, motif).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_m")
    )
    return per_reason.groupBy(*keys).agg(
        (F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"),
        F.sum("_n").alias("count"),
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col(motif).isNotNull(),
                    F.struct(F.col(motif).alias("reason"), F.col("_m").alias("n")),
                )
            )
        ).alias("missing"),
    )


def common_set_mean(
    values: DataFrame, keys: Sequence[str], performance: str, model: str, models: int
) -> DataFrame:
    """Mean by model over the performances where every one of ``models`` has a value."""
    present = values.filter(F.col("value").isNotNull())
    whole = (
        present.groupBy(*keys, performance)
        .agg(F.count_distinct(model).alias("_k"))
        .filter(F.col("_k") == models)
        .drop("_k")
    )
    return (
        present.join(whole, [*keys, performance])
        .groupBy(*keys, model)
        .agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    )


def paired_difference(
    pairs: DataFrame, keys: Sequence[str], earlier: str, later: str, t_table: DataFrame
) -> DataFrame:
    """Paired differences later - earlier: mean, Student 95 % interval, sign counts
    (better = smaller absolute value) and the smallest effect the size can detect.

    ``t_table``: ``df``, ``t975``, ``t80`` (at most 101 rows, the last for larger df)."""
    d = F.col(later) - F.col(earlier)
    better = F.abs(F.col(later)) < F.abs(F.col(earlier))
    worse = F.abs(F.col(earlier)) < F.abs(F.col(later))
    sums = pairs.groupBy(*keys).agg(
        F.count(d).alias("n"),
        F.avg(d).alias("mean"),
        F.stddev_samp(d).alias("_s"),
        F.sum(F.when(better, 1).otherwise(0)).alias("later_better"),
        F.sum(F.when(worse, 1).otherwise(0)).alias("earlier_better"),
        F.sum(F.when(~better & ~worse, 1).otherwise(0)).alias("ties"),
    )
    sized = sums.withColumn("df", F.least(F.col("n") - 1, F.lit(101)).cast("int"))
    joined = sized.join(F.broadcast(t_table), "df", "left")
    half = F.col("t975") * F.col("_s") / F.sqrt("n")
    return joined.select(
        *keys,
        "n",
        "mean",
        (F.col("mean") - half).alias("low"),
        (F.col("mean") + half).alias("high"),
        "later_better",
        "earlier_better",
        "ties",
        ((F.col("t975") + F.col("t80")) * MDE_SPREAD / F.sqrt("n")).alias("detectable"),
    )


# Fixed value: spread of paired differences used for the smallest detectable effect.
MDE_SPREAD = 0.0253


def comparison_conclusion(low: Column, high: Column) -> Column:
    """Aggregate: true when every computed interval holds 0, null when none exists."""
    return F.min(F.when(low.isNotNull(), (low <= 0) & (high >= 0)))


def geometry_gap(rows: DataFrame, keys: Sequence[str], klass: str = "klass") -> DataFrame:
    """ln of usage over control projected time, by class and overall (null class)."""
    sums = rows.groupBy(*keys, klass).agg(F.sum("p_usage").alias("_u"), F.sum("p_control").alias("_c"))
    whole = sums.groupBy(*keys).agg(F.sum("_u").alias("_u"), F.sum("_c").alias("_c"))
    both = sums.unionByName(whole.withColumn(klass, F.lit(None).cast("string")))
    return both.select(*keys, klass, F.log(F.col("_u") / F.col("_c")).alias("gap"))


# Grades (fraction) of a rolling and of a steep descent.
ROLLING_DESCENT = (-0.15, -0.05)


def descent_subclass(grade: Column) -> Column:
    """Rolling or steep part of a descent cell, null elsewhere."""
    low, high = ROLLING_DESCENT
    return F.when((grade >= low) & (grade < high), "rolling").when(grade < low, "steep")


def descent_fractions(overlaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of a segment's length in rolling and steep descent, from its grid overlaps
    (``length_m``, ``grade``)."""
    sub = descent_subclass(F.col("grade"))
    total = F.sum("length_m")
    return overlaps.groupBy(*keys).agg(
        (F.sum(F.when(sub == "rolling", F.col("length_m")).otherwise(0.0)) / total).alias(
            "rolling_fraction"
        ),
        (F.sum(F.when(sub == "steep", F.col("length_m")).otherwise(0.0)) / total).alias(
            "steep_fraction"
        ),
    )


def window_sets(shares: DataFrame, threshold: float, marker: float) -> DataFrame:
    """Covered (share at most the threshold) and beyond (above the marker) days."""
    return shares.withColumn("covered", F.col("share") <= threshold).withColumn(
        "beyond", F.col("share") > marker
    )


def covered_under_all(sets: DataFrame, keys: Sequence[str], windows: int) -> DataFrame:
    """Keys covered in every one of ``windows`` windows."""
    return (
        sets.filter(F.col("covered"))
        .groupBy(*keys)
        .agg(F.count_distinct("window").alias("_w"))
        .filter(F.col("_w") == windows)
        .drop("_w")
    )


def pair_beyond(sets: DataFrame, keys: Sequence[str], window: Column, other: Column) -> DataFrame:
    """Keys beyond the marker under one window that have a curve under another."""
    beyond = sets.filter(F.col("beyond") & (F.col("window") == window)).select(*keys)
    curve = sets.filter(F.col("has_curve") & (F.col("window") == other)).select(*keys)
    return beyond.intersect(curve)


def segment_gaps(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulated gap P - T at each point and the gap gained since the previous one."""
    from ridgeflow.operators import ordered

    gapped = points.withColumn("gap_s", F.col("p") - F.col("t"))
    back = ordered.shift(gapped, keys, ["k"], {"_g": F.col("gap_s")})
    return back.withColumn(
        "step_gap_s", F.col("gap_s") - F.coalesce("_g", F.lit(0.0))
    ).drop("_g")


def support_signature(segments: DataFrame, keys: Sequence[str], k: str = "k") -> DataFrame:
    """Fingerprint of the set of scored segments of each key.

    Order-free: the sum and xor of 64-bit hashes combine on the map side, so no set is
    collected."""
    total, mixed = _fingerprint(F.xxhash64(k))
    return segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), total.alias("sum_hash"), mixed.alias("xor_hash")
    )


def _fingerprint(h: Column) -> tuple[Column, Column]:
    """Order-free sum and xor of 64-bit hashes."""
    return F.sum(F.pmod(h, F.lit(2**31 - 1))), F.bit_xor(h)


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
