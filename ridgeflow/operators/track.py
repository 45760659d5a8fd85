"""Recorded tracks: holes, blocks, smoothing, realized distance, channel views.

A track table has one row per record: key columns, ``time_s`` (strictly increasing
seconds), ``lat``, ``lon``, ``ele``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeflow.functions.geo import haversine_m
from ridgeflow.operators import islands, ordered

# A longer step between records is a hole; half width of the smoothing.
MAX_STEP_S = 10.0
SMOOTHING_HALF_WIDTH = 2


def with_blocks(
    df: DataFrame, keys: Sequence[str], at: str = "time_s", max_step: float = MAX_STEP_S
) -> DataFrame:
    """Adds ``hole_before`` and ``block``: a step strictly above ``max_step`` is a hole."""
    df = ordered.assign_chunks(df, keys, at)
    stepped = ordered.shift(df, keys, [at], {"_pt": F.col(at)})
    marked = stepped.withColumn(
        "hole_before", F.coalesce(F.col(at) - F.col("_pt") > max_step, F.lit(False))
    ).drop("_pt")
    return islands.number_runs(marked, keys, [at], F.col("hole_before"), "block")


def centred_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    block: str,
    columns: Sequence[str],
    half: int = SMOOTHING_HALF_WIDTH,
    suffix: str = "_s",
    complete: str = "smooth_ok",
) -> DataFrame:
    """Centred mean over ``2 half + 1`` rows cut at block edges, and its completeness."""
    if not ordered.is_chunked(df):
        frame = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(-half, half)
        return df.select(
            "*",
            *(F.avg(c).over(frame).alias(c + suffix) for c in columns),
            (F.count(F.lit(1)).over(frame) == 2 * half + 1).alias(complete),
        )
    out = df
    near: list[Column] = [F.struct(block, *columns)]
    for forward in (False, True):
        previous = F.struct(block, *columns)
        for distance in range(1, half + 1):
            name = f"_near{int(forward)}{distance}"
            out = ordered.shift(out, keys, [order], {name: previous}, forward=forward)
            previous = F.col(name)
            near.append(F.col(name))
    inside = [n[block].eqNullSafe(F.col(block)) for n in near]
    size = reduce(lambda a, b: a + b, [F.when(i, 1).otherwise(0) for i in inside])

    def mean(column: str) -> Column:
        terms = [
            F.when(i, n[column]).otherwise(0.0) for i, n in zip(inside, near, strict=True)
        ]
        return reduce(lambda a, b: a + b, terms) / size

    smoothed = out.select(
        "*",
        *(mean(c).alias(c + suffix) for c in columns),
        (size == 2 * half + 1).alias(complete),
    )
    helper = [c for c in smoothed.columns if c.startswith("_near")]
    return smoothed.drop(*helper)


def with_realized_distance(
    df: DataFrame, keys: Sequence[str], at: str = "time_s"
) -> DataFrame:
    """Adds ``step_m`` and ``realized_m``: haversine length from the first record."""
    df = ordered.assign_chunks(df, keys, at)
    back = ordered.shift(df, keys, [at], {"_plat": F.col("lat"), "_plon": F.col("lon")})
    stepped = back.withColumn(
        "step_m",
        F.coalesce(
            haversine_m(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon")),
            F.lit(0.0),
        ),
    ).drop("_plat", "_plon")
    return ordered.running(stepped, keys, [at], {"realized_m": ("sum", F.col("step_m"))})


def build_series(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All derived columns of a track: blocks, smoothing and realized distance."""
    blocked = with_blocks(df, keys)
    smooth = centred_mean(blocked, keys, "time_s", "block", ["lat", "lon", "ele"])
    return with_realized_distance(smooth, keys)


def record_steps(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elementary intervals: each record with the values of the next one.

    ``end_s``, ``dt``, ``rise_m`` (smoothed), ``hole`` and the next positions."""
    following = {
        "end_s": F.col("time_s"),
        "_nhole": F.col("hole_before"),
        "next_lat": F.col("lat"),
        "next_lon": F.col("lon"),
        "next_ele": F.col("ele"),
        "next_ele_s": F.col("ele_s"),
        "next_realized_m": F.col("realized_m"),
    }
    led = ordered.shift(series, keys, ["time_s"], following, forward=True)
    return (
        led.filter(F.col("end_s").isNotNull())
        .withColumn("dt", F.col("end_s") - F.col("time_s"))
        .withColumn("rise_m", F.col("next_ele_s") - F.col("ele_s"))
        .withColumnRenamed("_nhole", "hole")
    )


def channel_view(
    channels: DataFrame, keys: Sequence[str], wanted: Sequence[str]
) -> DataFrame:
    """Position instants where every wanted channel has a value at the same instant.

    ``channels`` is long: keys, ``channel``, ``time_s``, ``value``, ``lat``, ``lon``.
    One conditional aggregation on (keys, instant) replaces a join per channel. Times
    are shifted to start at the first kept instant (``offset_s`` keeps the shift)."""
    asked = channels.filter(F.col("channel").isin("position", *wanted))
    lined = asked.groupBy(*keys, "time_s").agg(
        F.max(F.when(F.col("channel") == "position", F.col("lat"))).alias("lat"),
        F.max(F.when(F.col("channel") == "position", F.col("lon"))).alias("lon"),
        *(
            F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in wanted
        ),
    )
    full = lined.filter(
        reduce(
            lambda a, b: a & b,
            [F.col(c).isNotNull() for c in ("lat", "lon", *wanted)],
        )
    )
    offsets = full.groupBy(*keys).agg(F.min("time_s").alias("offset_s"))
    return full.join(offsets, list(keys)).withColumn(
        "recording_s", F.col("time_s")
    ).withColumn("time_s", F.col("time_s") - F.col("offset_s"))


def channel_drops(
    channels: DataFrame, keys: Sequence[str], wanted: Sequence[str]
) -> DataFrame:
    """Position instants dropped by :func:`channel_view`, counted by key."""
    per_instant = (
        channels.filter(F.col("channel").isin("position", *wanted))
        .groupBy(*keys, "time_s")
        .agg(
            F.max(F.when(F.col("channel") == "position", 1).otherwise(0)).alias("_pos"),
            F.count_distinct("channel").alias("_all"),
        )
    )
    return per_instant.groupBy(*keys).agg(
        F.sum("_pos").alias("positions"),
        F.sum(
            F.when((F.col("_pos") == 1) & (F.col("_all") <= len(wanted)), 1).otherwise(0)
        ).alias("dropped"),
    )


def heart_rate_steps(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulated trapezoid integral and covered time of a heart-rate channel.

    ``samples``: keys, ``time_s``, ``bpm``. Steps longer than a hole add nothing."""
    samples = ordered.assign_chunks(samples, keys, "time_s")
    back = ordered.shift(
        samples, keys, ["time_s"], {"_pt": F.col("time_s"), "_pv": F.col("bpm")}
    )
    step = F.col("time_s") - F.col("_pt")
    linked = step <= MAX_STEP_S
    pieces = back.withColumn(
        "_area", F.when(linked, (F.col("_pv") + F.col("bpm")) / 2 * step).otherwise(0.0)
    ).withColumn("_cover", F.when(linked, step).otherwise(0.0))
    summed = ordered.running(
        pieces,
        keys,
        ["time_s"],
        {
            "area": ("sum", F.col("_area")),
            "covered_s": ("sum", F.col("_cover")),
        },
    )
    led = ordered.shift(
        summed,
        keys,
        ["time_s"],
        {"next_s": F.col("time_s"), "next_bpm": F.col("bpm")},
        forward=True,
    )
    return led.drop("_pt", "_pv", "_area", "_cover")


def heart_rate_over(
    spans: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    *,
    coverage: float,
    clip: bool = False,
    tolerance_s: float = 1e-6,
) -> DataFrame:
    """Exact mean heart rate over spans: adds ``hr_area``, ``hr_covered_s``, ``hr_mean``.

    The mean is the integral divided by the covered time, null when the span leaves the
    series or is covered below ``coverage``. ``clip`` cuts spans to the series."""
    from ridgeflow.operators.lookup import asof

    steps = heart_rate_steps(samples, keys)
    bounds = samples.groupBy(*keys).agg(
        F.min("time_s").alias("_t0"), F.max("time_s").alias("_t1"), F.count("*").alias("_hn")
    )
    probes = spans.join(bounds.filter(F.col("_hn") >= 2), list(keys), "left")
    low = F.greatest(F.col(start), F.col("_t0")) if clip else F.col(start)
    high = F.least(F.col(end), F.col("_t1")) if clip else F.col(end)
    probes = probes.withColumn("_lo", low).withColumn("_hi", high)
    take = ["time_s", "bpm", "area", "covered_s", "next_s", "next_bpm"]
    renamed = steps.select(*keys, *(F.col(c).alias(f"h_{c}") for c in take))

    def read(probe: DataFrame, at: str, tag: str) -> DataFrame:
        cols = [f"h_{c}" for c in take]
        hit = asof(probe, renamed, keys, at, "h_time_s", cols)
        ahead = F.col(at) - F.col("h_time_s")
        step = F.col("h_next_s") - F.col("h_time_s")
        linked = (step <= MAX_STEP_S) & (ahead > 0)
        slope = (F.col("h_next_bpm") - F.col("h_bpm")) / step
        part = (F.col("h_bpm") + (F.col("h_bpm") + slope * ahead)) / 2 * ahead
        return hit.withColumn(
            f"_area{tag}", F.col("h_area") + F.when(linked, part).otherwise(0.0)
        ).withColumn(
            f"_cov{tag}", F.col("h_covered_s") + F.when(linked, ahead).otherwise(0.0)
        ).drop(*cols)

    both = read(read(probes, "_lo", "0"), "_hi", "1")
    inside = (F.col("_t0") <= F.col("_lo")) & (F.col("_hi") <= F.col("_t1"))
    usable = inside & (F.col("_hi") > F.col("_lo"))
    area = F.when(usable, F.col("_area1") - F.col("_area0")).otherwise(0.0)
    covered = F.when(usable, F.col("_cov1") - F.col("_cov0")).otherwise(0.0)
    enough = covered >= coverage * (F.col("_hi") - F.col("_lo")) - tolerance_s
    return (
        both.withColumn("hr_area", area)
        .withColumn("hr_covered_s", covered)
        .withColumn("hr_mean", F.when(usable & (covered > 0) & enough, area / covered))
        .drop("_t0", "_t1", "_hn", "_lo", "_hi", "_area0", "_area1", "_cov0", "_cov1")
    )
