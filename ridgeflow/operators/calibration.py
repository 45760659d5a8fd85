"""Calibration on past performances, prediction bands and their scores.

The population of a performance is every member finished strictly before its origin.
Means over it are differences of running sums read as of the origin, and its rank
quantiles are read off the sorted members of a small key, or found digit by digit, so members are
never paired with performances in rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.functions.grades import is_invalid_output
from ridgeflow.operators import lookup, ordered
from ridgeflow.operators.scoring import (
    INSUFFICIENT,
    MODEL_ERROR,
    NOT_CALIBRATED,
    ZERO_TIME,
)
from ridgeflow.session import cut_lineage

# Bounds of the effort, and the interval score penalty (2 / alpha).
EFFORT_BOUNDS = (0.5, 1.5)
BAND_PENALTY = 10.0
# Orders of the four band quantiles.
BAND_ORDERS: Mapping[str, tuple[int, int]] = {
    "q_low": (1, 10),
    "q_median": (1, 2),
    "q_prudent": (2, 3),
    "q_high": (9, 10),
}


def member_totals(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed and projected totals of each member: ``t_all``, ``p_all`` (null when an
    output is invalid) and the ``withdrawal`` of an empty or timeless support."""
    sums = segments.groupBy(*keys).agg(
        F.count("t").alias("n"),
        F.sum("t").alias("t_all"),
        F.sum("p").alias("_p"),
        F.max(is_invalid_output(F.col("p"))).alias("_bad"),
    )
    return sums.select(
        *keys,
        "n",
        "t_all",
        F.when(~F.col("_bad"), F.col("_p")).alias("p_all"),
        F.when(F.col("n") == 0, INSUFFICIENT)
        .when(~(F.col("t_all") > 0), ZERO_TIME)
        .alias("withdrawal"),
    )


def calibrate(
    performances: DataFrame,
    members: DataFrame,
    keys: Sequence[str],
    *,
    origin: str = "origin",
    end: str = "end_time",
    by_effort: bool = True,
) -> DataFrame:
    """Calibration of each performance on the members finished before its origin.

    ``members``: keys, ``end``, ``t_all``, ``p_all``, ``withdrawal``, ``is_training``,
    ``is_race``. Adds the population counts, ``beta`` = mean ln(T / P), then ``effort``
    and ``saturated`` (effort models) and ``factor`` = 1 / effort or exp(beta)."""
    training = F.col("is_training")
    effective = training & F.col("withdrawal").isNull()
    valid = effective & F.col("p_all").isNotNull()
    flags = members.select(
        *keys,
        F.col(end).alias("_end"),
        F.when(training, 1).otherwise(0).alias("members"),
        F.when(~training & F.col("is_race"), 1).otherwise(0).alias("excluded_race"),
        F.when(~training & ~F.col("is_race"), 1).otherwise(0).alias("excluded_unlabelled"),
        F.when(training & F.col("withdrawal").isNotNull(), 1).otherwise(0).alias("withdrawn"),
        F.when(effective, 1).otherwise(0).alias("population"),
        F.when(effective & F.col("p_all").isNull(), 1).otherwise(0).alias("invalid"),
        F.when(valid, F.log(F.col("t_all") / F.col("p_all"))).otherwise(0.0).alias("log_sum"),
    )
    counted = [c for c in flags.columns if c not in (*keys, "_end")]
    # Members of one instant are first summed: the running table has distinct instants.
    flags = flags.groupBy(*keys, "_end").agg(*(F.sum(c).alias(c) for c in counted))
    flags = flags.withColumn("_at", F.col("_end").cast("double"))
    flags = ordered.assign_chunks(flags, keys, "_at")
    running = ordered.running(
        flags, keys, ["_at"], {f"_s_{c}": ("sum", F.col(c)) for c in counted}, checked=True
    )
    known = lookup.asof(
        performances,
        ordered.without_chunks(running).select(*keys, "_at", *(f"_s_{c}" for c in counted)),
        keys,
        origin,
        "_at",
        [f"_s_{c}" for c in counted],
        strict=True,
    )
    zero = {c: F.coalesce(F.col(f"_s_{c}"), F.lit(0)) for c in counted}
    out = known.select(*ordered.without_chunks(performances).columns, *(z.alias(c) for c, z in zero.items()))
    status = F.when(F.col("population") == 0, NOT_CALIBRATED).when(
        F.col("invalid") > 0, MODEL_ERROR
    )
    out = out.withColumn("calibration_motif", status).withColumn(
        "beta",
        F.when(status.isNull(), F.col("log_sum") / F.nullif("population", F.lit(0))),
    )
    low, high = EFFORT_BOUNDS
    raw = F.exp(-F.col("beta"))
    if by_effort:
        effort = F.greatest(F.lit(low), F.least(F.lit(high), raw))
        out = (
            out.withColumn("effort", F.when(F.col("beta").isNotNull(), effort))
            .withColumn("factor", 1.0 / F.col("effort"))
            .withColumn("saturated", (raw < low) | (raw > high))
        )
    else:
        out = out.withColumn("factor", F.exp("beta"))
    return out.drop("log_sum", "invalid")


def calibrated(p: Column, effort: Column | None, factor: Column) -> Column:
    """Calibrated output: divided by the effort, or multiplied by the factor."""
    return p * factor if effort is None else p / effort


_RADIX = 16
#: Points of a key up to which its probes read them as one sorted array.
SMALL_KEY = 256


def prefix_ranks(
    probes: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    probe_at: str,
    point_at: str,
    value: str,
    orders: Mapping[str, tuple[int, int]],
) -> DataFrame:
    """Rank quantiles of the values known strictly before each probe.

    The points of a key of at most ``SMALL_KEY`` are one array sorted by value, and each of its
    probes keeps what it knows of it. Larger keys are ranked digit by digit
    (:func:`_digit_ranks`). Exact for any number of points."""
    keys = list(keys)
    # Written: sizes, arrays and ranks read the points.
    known = cut_lineage(
        points.filter(F.col(value).isNotNull()).select(
            *keys, F.col(point_at).cast("double").alias("_at"), F.col(value).alias("_v")
        )
    )
    others = [c for c in probes.columns if c not in keys]
    names = ["n_known", *orders]
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(sizes.filter(F.col("_n") > SMALL_KEY).select(*keys))
    some = large.limit(1).count() > 0
    small, asked = known, probes
    if some:
        small = known.join(large, keys, "left_anti")
        asked = probes.join(large, keys, "left_anti")
    arrays = small.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_v", "_at"))).alias("_points")
    )
    seen = asked.join(arrays, keys, "left").withColumn("_id", F.col(probe_at).cast("double"))
    seen = seen.withColumn("_points", F.filter("_points", lambda p: p["_at"] < F.col("_id")))
    size = F.nullif(F.size("_points").cast("long"), F.lit(0).cast("long"))
    seen = seen.withColumn("n_known", F.when(F.col("_points").isNotNull(), size))

    def at(a: int, b: int) -> Column:
        rank = F.floor((F.col("n_known") * a + b - 1) / b).cast("int")
        return F.get("_points", rank - 1)["_v"]

    out = seen.select(*keys, *others, "n_known", *(at(a, b).alias(n) for n, (a, b) in orders.items()))
    if not some:
        return out
    rest = _digit_ranks(
        probes.join(large, keys, "left_semi"), known.join(large, keys, "left_semi"), keys, probe_at, orders
    )
    return out.unionByName(rest.select(*keys, *others, *names))


def _digit_ranks(
    probes: DataFrame,
    known: DataFrame,
    keys: Sequence[str],
    probe_at: str,
    orders: Mapping[str, tuple[int, int]],
) -> DataFrame:
    """:func:`prefix_ranks` of keys of any size; ``known``: keys, ``_at``, ``_v``.

    Values get their rank inside the key; the wanted rank among the known ones is then
    found one base-16 digit at a time, from running counts per digit read as of the
    probe. The largest rank gives the number of digits. No pair of probe and point is built;
    a large key is ranked in slices."""
    keys = list(keys)
    counted = ordered.running(known, keys, ["_v", "_at"], {"_n": ("count", F.lit(1))})
    ranked = cut_lineage(
        ordered.without_chunks(counted).withColumn("_rank", F.col("_n") - 1).drop("_n")
    )
    top = ranked.agg(F.max("_rank")).first()[0] or 0
    levels = max(1, -(-int(top).bit_length() // 4))
    numbered = probes.withColumn("_id", F.col(probe_at).cast("double"))
    wanted = numbered.select(*keys, "_id").distinct()
    order_table = F.array(
        *(
            F.struct(F.lit(n).alias("_q"), F.lit(a).alias("_a"), F.lit(b).alias("_b"))
            for n, (a, b) in orders.items()
        )
    )
    state = wanted.select("*", F.inline(order_table)).withColumn("_node", F.lit(0).cast("long"))
    for level in range(levels):
        shift = 4 * (levels - 1 - level)
        node = F.shiftright(F.col("_rank"), shift + 4).cast("long")
        digit = F.shiftright(F.col("_rank"), shift).bitwiseAND(F.lit(_RADIX - 1))
        placed = ranked.select(*keys, "_at", node.alias("_node"), digit.alias("_digit"))
        ones = [F.when(F.col("_digit") <= d, 1).otherwise(0) for d in range(_RADIX)]
        per_instant = placed.groupBy(*keys, "_node", "_at").agg(
            *(F.sum(o).alias(f"_h{d}") for d, o in enumerate(ones))
        )
        climbed = ordered.running(
            per_instant,
            [*keys, "_node"],
            ["_at"],
            {f"_c{d}": ("sum", F.col(f"_h{d}")) for d in range(_RADIX)},
        ).withColumn("_counts", F.array(*(F.col(f"_c{d}") for d in range(_RADIX))))
        state = lookup.asof(
            state,
            climbed.select(*keys, "_node", "_at", "_counts"),
            [*keys, "_node"],
            "_id",
            "_at",
            ["_counts"],
            strict=True,
        )
        if level == 0:
            size = F.element_at("_counts", _RADIX)
            a, b = F.col("_a"), F.col("_b")
            state = state.withColumn("_size", size).withColumn(
                "_left", F.floor((size * a + b - 1) / b)
            )
        found = F.size(F.filter("_counts", lambda c: c < F.col("_left")))
        below = F.coalesce(F.get("_counts", F.col("_found") - 1), F.lit(0))
        state = (
            state.filter(F.col("_counts").isNotNull())
            .withColumn("_found", found)
            .withColumn("_left", F.col("_left") - below)
            .withColumn("_node", F.col("_node") * _RADIX + F.col("_found"))
            .drop("_counts", "_found")
        )
    values = ranked.select(*keys, F.col("_rank").cast("long").alias("_node"), "_v")
    read = state.join(values, [*keys, "_node"])
    wide = read.groupBy(*keys, "_id").agg(
        F.max("_size").alias("n_known"),
        *(F.max(F.when(F.col("_q") == n, F.col("_v"))).alias(n) for n in orders),
    )
    return numbered.join(wide, [*keys, "_id"], "left").drop("_id")


def interval_score(lower: Column, upper: Column, observed: Column) -> Column:
    """Width plus ten times the distance of the observation outside the interval."""
    zero = F.lit(0.0)
    return (
        (upper - lower)
        + BAND_PENALTY * F.greatest(lower - observed, zero)
        + BAND_PENALTY * F.greatest(observed - upper, zero)
    )


def reservoir(
    members: DataFrame, calibration: DataFrame | None, keys: Sequence[str], perf: Sequence[str]
) -> DataFrame:
    """Residual ``z`` = ln(T / P) of each member under its own calibration.

    ``calibration`` (keys + perf + ``effort``/``factor``/``calibration_motif``) is left
    out for the raw model."""
    base = members
    projected = F.col("p_all")
    motif = F.col("withdrawal")
    late = F.when(projected.isNull(), MODEL_ERROR)
    if calibration is not None:
        base = members.join(
            calibration.select(*keys, *perf, "factor", "calibration_motif"), [*keys, *perf], "left"
        )
        projected = projected * F.col("factor")
        late = F.coalesce(late, F.col("calibration_motif"))
    motif = F.coalesce(motif, late, F.when(is_invalid_output(projected), MODEL_ERROR))
    return base.withColumn("residual_motif", motif).withColumn(
        "z", F.when(motif.isNull(), F.log(F.col("t_all") / projected))
    )


def bands(
    targets: DataFrame,
    quantiles: DataFrame,
    keys: Sequence[str],
    *,
    p: str = "p",
    base: str = "p0",
    t: str = "t",
    weight: str = "w",
) -> tuple[DataFrame, DataFrame]:
    """Bands around the targets and their scores per key.

    ``quantiles``: keys, ``n_known`` and the four residual quantiles. An element is
    never said covered when the reservoir has a single residual."""
    joined = targets.join(quantiles, list(keys))
    elements = joined
    for name, quantile in (
        ("lower_s", "q_low"),
        ("median_s", "q_median"),
        ("prudent_s", "q_prudent"),
        ("upper_s", "q_high"),
    ):
        elements = elements.withColumn(name, F.col(p) * F.exp(quantile))
    seen = F.col(t).isNotNull()
    score = F.when(seen, interval_score(F.col("lower_s"), F.col("upper_s"), F.col(t)))
    inside = (F.col(t) >= F.col("lower_s")) & (F.col(t) <= F.col("upper_s"))
    elements = (
        elements.withColumn("width_s", F.col("upper_s") - F.col("lower_s"))
        .withColumn("score_s", score)
        .withColumn("covered", F.when(seen & (F.col("n_known") > 1), inside))
    )
    whole = F.min(seen)
    summary = elements.groupBy(*keys).agg(
        F.max("n_known").alias("n_known"),
        F.when(whole, F.sum(F.col(weight) * F.col("score_s"))).alias("interval_score_s"),
        F.when(whole, F.sum(F.col(weight) * F.col("score_s") / F.col(base))).alias(
            "normalised_score"
        ),
        F.when(
            whole, F.sum(F.when(F.col("covered"), F.col(weight)).otherwise(0.0))
        ).alias("coverage"),
        F.min("covered").alias("all_covered"),
        F.when(whole, F.max(F.abs(F.col("median_s") - F.col(t)))).alias("median_max_abs_error_s"),
    )
    return elements, summary


def contributor_means(terms: DataFrame, contributing: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Mean ln(T / P) of the members that carried the curve and of the others."""
    marked = terms.join(
        contributing.select(*keys, member).distinct().withColumn("_in", F.lit(True)),
        [*keys, member],
        "left",
    ).withColumn("_l", F.log(F.col("t_all") / F.col("p_all")))
    inside = F.col("_in").isNotNull()
    return marked.groupBy(*keys).agg(
        F.sum(F.when(inside, 1).otherwise(0)).alias("contributors"),
        F.count(F.lit(1)).alias("members"),
        F.avg(F.when(inside, F.col("_l"))).alias("contributing_mean"),
        F.avg(F.when(~inside, F.col("_l"))).alias("other_mean"),
    )
