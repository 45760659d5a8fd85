"""Moving / stopped / undetermined clocks of a track under five conventions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.functions.geo import local_x, local_y
from ridgeflow.operators import islands, lookup, ordered, track


@dataclass(frozen=True)
class Convention:
    """Largest still speeds (m/s) and shortest confirmed stop (s)."""

    horizontal_ms: float
    vertical_ms: float
    min_stop_s: float


# Fixed values, in order: the five conventions; the second one is the central one.
CONVENTIONS: tuple[Convention, ...] = (
    Convention(0.05, 0.015, 60.0),
    Convention(0.10, 0.03, 60.0),
    Convention(0.15, 0.045, 60.0),
    Convention(0.10, 0.03, 30.0),
    Convention(0.10, 0.03, 90.0),
)
CENTRAL = 1
HALF_WINDOW_S = 15.0
RELATIVE_TOLERANCE = 1e-6
MOVING, STOPPED, UNDETERMINED = "M", "S", "U"
STATES = (MOVING, STOPPED, UNDETERMINED)
MOBILE, IMMOBILE, INDETERMINATE = "mobile", "immobile", "indeterminate"


def exceeds(value: Column, threshold: float) -> Column:
    """Above a threshold beyond its relative rounding tolerance."""
    return value - threshold > RELATIVE_TOLERANCE * threshold


def qualify(
    v_h: Column, v_z: Column, d_h: Column, d_z: Column, convention: Convention
) -> Column:
    """Judgement of a window; an invalid window (null speeds) is indeterminate."""
    span = 2 * HALF_WINDOW_S
    h, z = convention.horizontal_ms, convention.vertical_ms
    still = ~exceeds(d_h, span * h) & ~exceeds(d_z, span * z)
    return (
        F.when(v_h.isNull(), INDETERMINATE)
        .when(exceeds(v_h, h) | exceeds(v_z, z), MOBILE)
        .when(still, IMMOBILE)
        .otherwise(INDETERMINATE)
    )


def window_measures(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elementary intervals with the measures of their exact 30 s window.

    Adds ``v_h``, ``v_z`` and, where no convention is exceeded, ``d_h``, ``d_z``; all
    null for a hole or a window that leaves its block or a complete smoothing. Steps are
    at most 10 s, so ``[t - 25 ; t + 30]`` holds every record a window reads."""
    record = F.struct(
        F.col("time_s").alias("t"),
        F.col("block").alias("b"),
        F.col("lat_s").alias("lat"),
        F.col("lon_s").alias("lon"),
        F.col("ele_s").alias("z"),
        F.col("smooth_ok").alias("ok"),
    )
    reach = track.MAX_STEP_S
    records = ordered.framed(
        series,
        keys,
        "time_s",
        -int(HALF_WINDOW_S + reach),
        int(HALF_WINDOW_S + 2 * reach),
        {"_near": lambda w: F.collect_list(record).over(w)},
    )
    steps = track.record_steps(records, keys)
    return _measured(steps)


def _measured(steps: DataFrame) -> DataFrame:
    middle = (F.col("time_s") + F.col("end_s")) / 2
    own = steps.withColumn("_lo", middle - HALF_WINDOW_S).withColumn(
        "_hi", middle + HALF_WINDOW_S
    )
    own = own.withColumn(
        "_blk", F.filter("_near", lambda p: p["b"] == F.col("block"))
    )
    own = (
        own.withColumn("_l0", F.try_element_at(F.filter("_blk", lambda p: p["t"] <= F.col("_lo")), F.lit(-1)))
        .withColumn("_l1", F.get(F.filter("_blk", lambda p: p["t"] >= F.col("_lo")), F.lit(0)))
        .withColumn("_h0", F.try_element_at(F.filter("_blk", lambda p: p["t"] <= F.col("_hi")), F.lit(-1)))
        .withColumn("_h1", F.get(F.filter("_blk", lambda p: p["t"] >= F.col("_hi")), F.lit(0)))
    )
    used = F.filter(
        "_blk", lambda p: (p["t"] >= F.col("_l0.t")) & (p["t"] <= F.col("_h1.t"))
    )
    valid = (
        ~F.col("hole")
        & F.col("_l0").isNotNull()
        & F.col("_h1").isNotNull()
        & F.forall(used, lambda p: p["ok"])
    )

    def read(low: str, high: str, at: str, field: str) -> Column:
        a, b = F.col(f"{low}.{field}"), F.col(f"{high}.{field}")
        span = F.col(f"{high}.t") - F.col(f"{low}.t")
        share = (F.col(at) - F.col(f"{low}.t")) / F.nullif(span, F.lit(0.0))
        return F.when(span == 0, a).otherwise(a + share * (b - a))

    own = own.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    for tag, low, high, at in (("lo", "_l0", "_l1", "_lo"), ("hi", "_h0", "_h1", "_hi")):
        for field in ("lat", "lon", "z"):
            own = own.withColumn(f"_{field}_{tag}", read(low, high, at, field))

    def plane(lat: Column, lon: Column) -> Column:
        return F.struct(
            local_x(F.col("_lat_lo"), F.col("_lon_lo"), lon).alias("x"),
            local_y(F.col("_lat_lo"), lat).alias("y"),
        )

    own = own.withColumn("_end", plane(F.col("_lat_hi"), F.col("_lon_hi")))
    span = 2 * HALF_WINDOW_S
    own = own.withColumn(
        "v_h",
        F.when(F.col("_valid"), F.hypot(F.col("_end.x"), F.col("_end.y")) / span),
    ).withColumn("v_z", F.when(F.col("_valid"), F.abs(F.col("_z_hi") - F.col("_z_lo")) / span))
    fastest = max(c.horizontal_ms for c in CONVENTIONS)
    steepest = max(c.vertical_ms for c in CONVENTIONS)
    slow = F.col("_valid") & ~exceeds(F.col("v_h"), fastest) & ~exceeds(
        F.col("v_z"), steepest
    )
    inner = F.filter(
        "_blk", lambda p: (p["t"] > F.col("_lo")) & (p["t"] < F.col("_hi"))
    )
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    spots = F.concat(
        F.array(start),
        F.transform(inner, lambda p: plane(p["lat"], p["lon"])),
        F.array(F.col("_end")),
    )
    heights = F.concat(
        F.array(F.col("_z_lo")), F.transform(inner, lambda p: p["z"]), F.array(F.col("_z_hi"))
    )
    # Diameters only where every convention needs them.
    own = own.withColumn("_spots", F.when(slow, spots)).withColumn(
        "_heights", F.when(slow, heights)
    )
    widest = F.array_max(
        F.transform(
            "_spots",
            lambda a: F.array_max(
                F.transform("_spots", lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
            ),
        )
    )
    out = own.withColumn("d_h", widest).withColumn(
        "d_z", F.array_max("_heights") - F.array_min("_heights")
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def confirm(
    steps: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    immobile: Column,
    name: str,
) -> DataFrame:
    """:func:`confirm_all` of one condition."""
    return confirm_all(steps, keys, start, end, {name: immobile})


def confirm_all(
    steps: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    immobile: Mapping[str, Column],
) -> DataFrame:
    """Adds ``<name>_start`` and ``<name>_end`` for every ``immobile`` condition: the bounds of
    the maximal run of immobile intervals each immobile interval belongs to (null elsewhere).

    All conditions share the scans: neighbours, run starts, and run ends in reverse."""
    flagged = steps.select(
        "*", *(F.coalesce(c, F.lit(False)).alias(f"_still_{n}") for n, c in immobile.items())
    )
    back = ordered.shift(flagged, keys, [start], {f"_before_{n}": F.col(f"_still_{n}") for n in immobile})
    both = ordered.shift(
        back, keys, [start], {f"_after_{n}": F.col(f"_still_{n}") for n in immobile}, forward=True
    )

    def edge(name: str, side: str, at: str) -> Column:
        alone = F.col(f"_still_{name}") & ~F.coalesce(F.col(f"_{side}_{name}"), F.lit(False))
        return F.when(alone, F.col(at))

    first = ordered.running(
        both, keys, [start], {f"_open_{n}": ("last", edge(n, "before", start)) for n in immobile}
    )
    last = ordered.running(
        first,
        keys,
        [start],
        {f"_close_{n}": ("last", edge(n, "after", end)) for n in immobile},
        reverse=True,
    )
    kept = [*steps.columns, *(c for c in ordered.HELPERS if c in last.columns and c not in steps.columns)]
    bounds = [
        F.when(F.col(f"_still_{n}"), F.col(f"_{edge_}_{n}")).alias(f"{n}_{side}")
        for n in immobile
        for side, edge_ in (("start", "open"), ("end", "close"))
    ]
    return last.select(*kept, *bounds)


def state_of(judged: Column, run_start: Column, run_end: Column, min_stop: float) -> Column:
    """Confirmed state: long enough immobile runs stop, mobile moves, else unknown."""
    return (
        F.when(judged == MOBILE, MOVING)
        .when((judged == IMMOBILE) & (run_end - run_start >= min_stop), STOPPED)
        .otherwise(UNDETERMINED)
    )


def clock_partition(
    series: DataFrame,
    keys: Sequence[str],
    conventions: Sequence[Convention] = CONVENTIONS,
) -> DataFrame:
    """Intervals with their state under each convention in ``state_0 .. state_k``.

    Conventions that share speeds share one judgement and one run search; only the
    duration test differs."""
    steps = window_measures(series, keys)
    measures = [F.col(c) for c in ("v_h", "v_z", "d_h", "d_z")]
    families: dict[tuple[float, float], str] = {}
    for convention in conventions:
        speeds = (convention.horizontal_ms, convention.vertical_ms)
        if speeds in families:
            continue
        tag = f"q{len(families)}"
        families[speeds] = tag
        steps = steps.withColumn(tag, qualify(*measures, convention))
    still = {f"{tag}_run": F.col(tag) == IMMOBILE for tag in families.values()}
    steps = confirm_all(steps, keys, "time_s", "end_s", still)
    for k, convention in enumerate(conventions):
        tag = families[(convention.horizontal_ms, convention.vertical_ms)]
        state = state_of(
            F.col(tag),
            F.col(f"{tag}_run_start"),
            F.col(f"{tag}_run_end"),
            convention.min_stop_s,
        )
        steps = steps.withColumn(f"state_{k}", state)
    helpers = [
        name
        for tag in families.values()
        for name in (tag, f"{tag}_run_start", f"{tag}_run_end")
    ]
    return steps.drop(*helpers)


def totals(partition: DataFrame, keys: Sequence[str], count: int = len(CONVENTIONS)) -> DataFrame:
    """One row per key and convention: elapsed, moving, stopped, undetermined seconds."""
    sums = [
        F.sum(F.when(F.col(f"state_{k}") == s, F.col("dt")).otherwise(0.0)).alias(f"{s}_{k}")
        for k in range(count)
        for s in STATES
    ]
    wide = partition.groupBy(*keys).agg(F.sum("dt").alias("elapsed_s"), *sums)
    rows = F.array(
        *(
            F.struct(
                F.lit(k).alias("convention"),
                F.col(f"{MOVING}_{k}").alias("moving_s"),
                F.col(f"{STOPPED}_{k}").alias("stopped_s"),
                F.col(f"{UNDETERMINED}_{k}").alias("undetermined_s"),
            )
            for k in range(count)
        )
    )
    return wide.select(*keys, "elapsed_s", F.inline(rows))


def convention_extremes(totals_by_convention: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First convention of least moving time, first of most moving-or-unknown time, and
    the range of moving time they leave open."""
    k = F.col("convention")
    unknown = F.col("moving_s") + F.col("undetermined_s")
    return totals_by_convention.groupBy(*keys).agg(
        F.min_by("convention", F.struct("moving_s", k)).alias("low_convention"),
        F.max_by("convention", F.struct(unknown, -k)).alias("high_convention"),
        F.min("moving_s").alias("range_low_s"),
        (F.max("elapsed_s") - F.min("stopped_s")).alias("range_high_s"),
    )


def stop_episodes(
    partition: DataFrame, keys: Sequence[str], convention: int = CENTRAL
) -> DataFrame:
    """Maximal stopped runs: ``start_s``, ``end_s`` and their number of intervals."""
    stopped = F.col(f"state_{convention}") == STOPPED
    runs = confirm(partition, keys, "time_s", "end_s", stopped, "_e")
    return (
        runs.filter(F.col("_e_start").isNotNull())
        .groupBy(*keys, F.col("_e_start").alias("start_s"))
        .agg(F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("intervals"))
    )


def clock_columns() -> list[tuple[str, int | None, tuple[str, ...] | None]]:
    """The eleven clocks in order: elapsed, then moving and moving-or-unknown under
    each convention."""
    rest = [
        (f"{kind}_{k}", k, states)
        for kind, states in (("m", (MOVING,)), ("mu", (MOVING, UNDETERMINED)))
        for k in range(len(CONVENTIONS))
    ]
    return [("elapsed", None, None), *rest]


def cumulate_clocks(partition: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Interval rows with the clock readings at their start (``c_m_0`` .. ``c_mu_4``)
    and the slope of each clock inside the interval (``r_*``, 0 or 1)."""
    rates = {
        name: F.when(F.col(f"state_{k}").isin(*states), 1.0).otherwise(0.0)
        for name, k, states in clock_columns()
        if k is not None
    }
    rated = partition.select("*", *(r.alias(f"r_{n}") for n, r in rates.items()))
    summed = ordered.running(
        rated,
        keys,
        ["time_s"],
        {f"_c_{n}": ("sum", F.col("dt") * F.col(f"r_{n}")) for n in rates},
    )
    return summed.select(
        "*", *((F.col(f"_c_{n}") - F.col("dt") * F.col(f"r_{n}")).alias(f"c_{n}") for n in rates)
    ).drop(*(f"_c_{n}" for n in rates))


def clocks_at(
    probes: DataFrame, cumulated: DataFrame, keys: Sequence[str], at: str, suffix: str
) -> DataFrame:
    """Probes with the eleven clock readings at an instant (``elapsed`` is the instant)."""
    names = [n for n, k, _ in clock_columns() if k is not None]
    take = ["time_s", *(f"c_{n}" for n in names), *(f"r_{n}" for n in names)]
    found = lookup.asof(
        probes,
        cumulated.select(*keys, *(F.col(c).alias(f"k_{c}") for c in [*take, "end_s"])),
        keys,
        at,
        "k_time_s",
        [f"k_{c}" for c in [*take, "end_s"]],
    )
    inside = F.least(F.col(at), F.col("k_end_s")) - F.col("k_time_s")
    return found.select(
        *ordered.without_chunks(probes).columns,
        F.col(at).alias(f"elapsed{suffix}"),
        *((F.col(f"k_c_{n}") + F.col(f"k_r_{n}") * inside).alias(n + suffix) for n in names),
    )


def span_clocks(
    spans: DataFrame, partition: DataFrame, keys: Sequence[str], start: str, end: str
) -> DataFrame:
    """Spans with ``times``: their durations under the eleven clocks, in order."""
    cumulated = cumulate_clocks(partition, keys)
    base = ordered.without_chunks(spans).columns
    bounds = F.array(
        F.struct(F.lit(0).alias("_side"), F.col(start).alias("_at")),
        F.struct(F.lit(1).alias("_side"), F.col(end).alias("_at")),
    )
    # One look-up reads both bounds.
    read = clocks_at(
        ordered.without_chunks(spans).select("*", F.inline(bounds)), cumulated, keys, "_at", "_c"
    )
    names = [n for n, _, _ in clock_columns()]
    signed = F.when(F.col("_side") == 1, 1.0).otherwise(-1.0)
    sums = read.groupBy(*base).agg(*(F.sum(signed * F.col(f"{n}_c")).alias(f"_{n}") for n in names))
    return sums.select(*base, F.array(*(F.col(f"_{n}") for n in names)).alias("times"))


def islands_of_state(
    partition: DataFrame, keys: Sequence[str], convention: int = CENTRAL
) -> DataFrame:
    """Runs of equal state: one row per run with its bounds."""
    numbered = islands.runs_of(partition, keys, ["time_s"], F.col(f"state_{convention}"))
    return numbered.groupBy(*keys, "run", F.col(f"state_{convention}").alias("state")).agg(
        F.min("time_s").alias("start_s"), F.max("end_s").alias("end_s")
    )
