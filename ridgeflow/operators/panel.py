"""Efficiency panel: climbs joined to days with ordered exclusions, groups of routes,
design columns and declared trials."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeflow.functions import geo
from ridgeflow.operators import days as day_rules
from ridgeflow.operators import effects, ordered, trend
from ridgeflow.session import cut_lineage

# Radius (m) and gain ratio of climbs of one route.
ROUTE_RADIUS_M = 100.0
ROUTE_GAIN_RATIO = 1.10


def principal_device(activities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Device with the most distinct days per key, and whether it is tied (an error)."""
    known = activities.filter(F.col("manufacturer").isNotNull() & F.col("product").isNotNull())
    counts = known.groupBy(*keys, "manufacturer", "product").agg(
        F.count_distinct("day").alias("days")
    )
    best = counts.groupBy(*keys).agg(F.max("days").alias("_m"))
    top = (counts.join(best, list(keys)) if keys else counts.crossJoin(F.broadcast(best))).filter(
        F.col("days") == F.col("_m")
    )
    return top.groupBy(*keys).agg(
        F.min(F.struct("manufacturer", "product")).alias("device"),
        F.max("days").alias("days"),
        (F.count(F.lit(1)) > 1).alias("tied"),
    )


def watch_normals(
    rows: DataFrame, keys: Sequence[str], value: str, admitted: str, *, window_days: int, min_days: int
) -> DataFrame:
    """Median of admitted values in the days before, cut at the last watch change.

    The change number is one more partition key of the rolling normal."""
    axis = Window.partitionBy(*keys).orderBy(day_rules.day_axis("day"))
    marked = rows.withColumn(
        "_era", F.sum(F.when(F.col("rank_rupture"), 1).otherwise(0)).over(axis)
    )
    rules = day_rules.NormalRules(window_days=window_days, min_admitted=min_days)
    out = day_rules.rolling_normals(marked, [*keys, "_era"], value, admitted, rules, prefix="watch_")
    return out.drop("_era")


def climb_motif(rules: Sequence[tuple[str, Column]]) -> Column:
    """First exclusion motif whose condition holds, in the given order."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules))


def climb_rules(
    *,
    device: Column,
    principal: Column,
    sessions: Column,
    journal: Column,
    regimes: Sequence[str],
    excluded_flags: Sequence[str],
    short_gain_m: float,
    min_coverage: float,
) -> list[tuple[str, Column]]:
    flags = F.arrays_overlap("flags", F.array(*(F.lit(f) for f in excluded_flags)))
    speed = F.col("vertical_speed_ms")
    return [
        ("device", ~device.eqNullSafe(principal)),
        ("sessions", F.coalesce(sessions, F.lit(1)) > 1),
        ("journal", journal),
        ("outside_regimes", ~F.col("regime").isin(*regimes)),
        ("flag", flags),
        ("no_speed", speed.isNull() | (speed <= 0) | F.col("moving_mean_elevation_m").isNull()),
        ("short_gain", (F.col("regime") == "short_climb") & (F.col("gain_m") <= short_gain_m)),
        (
            "no_heart_rate",
            F.col("hr_bpm").isNull() | (F.col("hr_coverage") < min_coverage),
        ),
    ]


def day_rules_step5() -> list[tuple[str, Column]]:
    """Motifs that leave a day without its resting-rate deviation."""
    return [
        ("resting_invalid", ~F.col("resting_hr_status").eqNullSafe(F.lit("valid"))),
        ("no_normal", F.col("watch_normal").isNull()),
        ("straddling", F.size("ranks") >= 2),
        ("uncertain", F.col("uncertain")),
        ("resting_after", F.col("lowest_midpoint_s") >= F.col("first_start_s")),
    ]


def day_rules_step6() -> list[tuple[str, Column]]:
    """Motifs that leave a day without its heart-rate reserve."""
    return [
        ("reserve_no_normal", F.col("watch_normal").isNull()),
        ("reserve_straddling", F.size("ranks") >= 2),
        ("reserve_uncertain", F.col("uncertain")),
    ]


def panel(
    climbs: DataFrame, activities: DataFrame, day_table: DataFrame, keys: Sequence[str],
    climb_conditions: Sequence[tuple[str, Column]],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept climbs, excluded climbs, climbs without activity).

    Climbs join activities on their reference and days on the local day; every climb
    keeps its first motif."""
    keys = list(keys)
    orphans = climbs.join(activities.select(*keys, "activity_ref"), [*keys, "activity_ref"], "left_anti")
    joined = climbs.join(activities, [*keys, "activity_ref"]).join(day_table, [*keys, "day"], "left")
    tagged = joined.withColumn("motif", climb_motif(climb_conditions))
    tagged = tagged.withColumn("step5", climb_motif(day_rules_step5())).withColumn(
        "step6", climb_motif(day_rules_step6())
    )
    deviation = F.when(F.col("step5").isNull(), F.col("resting_hr_bpm") - F.col("watch_normal"))
    tagged = tagged.withColumn("e_s", deviation).withColumn(
        "reserve_bpm",
        F.when(F.col("step6").isNull(), F.col("hr_bpm") - F.col("watch_normal")),
    )
    return tagged.filter(F.col("motif").isNull()), tagged.filter(F.col("motif").isNotNull()), orphans


def flow_counts(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exclusion flow: counts per motif with totals per key."""
    counts = tagged.groupBy(*keys, F.coalesce("motif", F.lit("kept")).alias("motif")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    return counts.unionByName(totals.withColumn("motif", F.lit("all")).select(*keys, "motif", "n"))


def representatives(climbs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest-gain climb of each day, earliest on ties: one min over a small struct."""
    others = [c for c in climbs.columns if c not in (*keys, "day")]
    best = climbs.groupBy(*keys, "day").agg(
        F.min_by(F.struct(*others), F.struct(-F.col("gain_m"), "start_s", "climb_id")).alias("_c")
    )
    return best.select(*keys, "day", "_c.*")


def route_links(climbs: DataFrame, keys: Sequence[str], radius_m: float, ratio: float) -> DataFrame:
    """Links between climbs of one route: both ends strictly within a radius and gains
    within a ratio. Enough links to connect exactly what all pairs would connect.

    Positions are binned so finely that climbs sharing both bins are within the radius:
    inside a bin only the next larger gain is linked, so a bin of any size costs a sort.
    Between neighbouring bins, pieces of such chains meet by their first climbs; only where
    these are not linked are the climbs of two pieces compared, and one link is kept."""
    keys = list(keys)
    cell = radius_m / math.sqrt(2.0) * 0.99 / geo.EARTH_RADIUS_M * 57.29577951308232

    def band(lat: str) -> Column:
        return F.floor(F.col(lat) / cell)

    def column(lat: str, lon: str) -> Column:
        # Bins of a latitude band share one width, that of the band's wider edge.
        low, high = F.abs(band(lat) * cell), F.abs((band(lat) + 1) * cell)
        scale = F.greatest(F.cos(F.radians(F.least(low, high))), F.lit(0.02))
        return F.floor(F.col(lon) * scale / cell)

    binned = climbs.select(
        *keys,
        "climb_id",
        "gain_m",
        "start_lat",
        "start_lon",
        "end_lat",
        "end_lon",
        band("start_lat").alias("_sy"),
        column("start_lat", "start_lon").alias("_sx"),
        band("end_lat").alias("_ey"),
        column("end_lat", "end_lon").alias("_ex"),
    )
    bins = [*keys, "_sy", "_sx", "_ey", "_ex"]
    order = ["gain_m", "climb_id"]
    seen = ordered.shift(binned, bins, order, {"_pg": F.col("gain_m"), "_pid": F.col("climb_id")})
    joined = F.coalesce(F.col("gain_m") / F.col("_pg") <= ratio, F.lit(False))
    chained = ordered.running(seen, bins, order, {"_chain": ("sum", F.when(joined, 0).otherwise(1))})
    rows = cut_lineage(ordered.without_chunks(chained).withColumn("_in", joined))
    inside = rows.filter("_in").select(F.col("_pid").alias("a"), F.col("climb_id").alias("b"))

    # A piece: the climbs of one chain and one level of gain, all linked to each other. One
    # link between two pieces is as good as all, and first climbs often have it.
    level = F.floor(F.log("gain_m") / math.log(ratio)).cast("long")
    rows = rows.withColumn("_piece", F.struct(*bins, "_chain", level.alias("_lv")))
    ends = ("start_lat", "start_lon", "end_lat", "end_lon")
    heads = rows.groupBy(*keys, "_piece").agg(
        F.min_by(F.struct("climb_id", "gain_m", *ends), F.struct("gain_m", "climb_id")).alias("_h")
    )
    heads = heads.select(*keys, "_piece", "_h.*")

    def side(table: DataFrame, mark: str) -> DataFrame:
        named = [F.col(c).alias(f"{mark}_{c}") for c in ("_piece", "climb_id", "gain_m", *ends)]
        return table.select(*keys, *named)

    def apart(end: str) -> Column:
        at = (F.col(f"a_{end}_lat"), F.col(f"a_{end}_lon"), F.col(f"b_{end}_lat"), F.col(f"b_{end}_lon"))
        return geo.haversine_m(*at)

    gains = F.greatest("a_gain_m", "b_gain_m") / F.least("a_gain_m", "b_gain_m") <= ratio
    close = (apart("start") < radius_m) & (apart("end") < radius_m) & gains

    # First climbs near enough for their pieces to hold a link: cells of the doubled reach,
    # and every cell that the reach around a climb touches.
    reach = 3.0 * radius_m / geo.EARTH_RADIUS_M * 57.29577951308232
    wide = 2.0 * reach

    def zone_scale(zone: Column) -> Column:
        low, high = F.abs(zone * wide), F.abs((zone + 1) * wide)
        return F.greatest(F.cos(F.radians(F.greatest(low, high))), F.lit(0.02))

    def touched(table: DataFrame, end: str) -> DataFrame:
        lat, lon = F.col(f"a_{end}_lat"), F.col(f"a_{end}_lon")
        zones = F.sequence(F.floor((lat - reach) / wide), F.floor((lat + reach) / wide))
        table = table.withColumn(f"_z_{end}", F.explode(zones))
        # East to west, a degree is shortest on the side of the zone towards the pole.
        scale = zone_scale(F.col(f"_z_{end}"))
        cells = F.sequence(F.floor((lon * scale - 1.1 * reach) / wide), F.floor((lon * scale + 1.1 * reach) / wide))
        return table.withColumn(f"_c_{end}", F.explode(cells))

    def own(table: DataFrame, end: str) -> DataFrame:
        zone = F.floor(F.col(f"b_{end}_lat") / wide)
        cell_of = F.floor(F.col(f"b_{end}_lon") * zone_scale(zone) / wide)
        return table.withColumn(f"_z_{end}", zone).withColumn(f"_c_{end}", cell_of)

    a_level, b_level = F.col("a__piece._lv"), F.col("b__piece._lv")
    left = touched(touched(side(heads, "a"), "start"), "end").withColumn(
        "_l", F.explode(F.sequence(a_level - 1, a_level + 1))
    )
    right = own(own(side(heads, "b"), "start"), "end").withColumn("_l", b_level)
    a_piece, b_piece = F.col("a__piece"), F.col("b__piece")
    same_bin = F.lit(True)
    for c in ("_sy", "_sx", "_ey", "_ex"):
        same_bin = same_bin & (F.col(f"a__piece.{c}") == F.col(f"b__piece.{c}"))
    cells = ["_z_start", "_c_start", "_z_end", "_c_end", "_l"]
    met = left.join(right, [*keys, *cells]).filter(
        (a_piece < b_piece) & ~same_bin & (apart("start") < 3 * radius_m) & (apart("end") < 3 * radius_m)
    )
    met = cut_lineage(met.withColumn("_close", close).drop(*cells))
    by_heads = met.filter("_close").select(F.col("a_climb_id").alias("a"), F.col("b_climb_id").alias("b"))
    # Elsewhere, any pair of the two pieces; climbs of one gain and one place stand for each other.
    open_ = met.filter(~F.col("_close")).select(*keys, "a__piece", "b__piece")
    spots = rows.groupBy(*keys, "_piece", "gain_m", *ends).agg(F.min("climb_id").alias("climb_id"))
    detail = open_.join(side(spots, "a"), [*keys, "a__piece"]).join(side(spots, "b"), [*keys, "b__piece"])
    by_pairs = detail.filter(close).groupBy("a__piece", "b__piece").agg(
        F.min(F.struct(F.col("a_climb_id").alias("a"), F.col("b_climb_id").alias("b"))).alias("_l")
    )
    return inside.unionByName(by_heads).unionByName(by_pairs.select("_l.*")).distinct()


def route_groups(
    climbs: DataFrame,
    keys: Sequence[str],
    *,
    radius_m: float = ROUTE_RADIUS_M,
    ratio: float = ROUTE_GAIN_RATIO,
    max_other_days: int = 1,
    in_sample: str = "in_sample",
) -> DataFrame:
    """Route group of each day: the component of its largest climb; small components are
    other (null); the rest are numbered by their first day in the sample."""
    keys = list(keys)
    links = cut_lineage(route_links(climbs, keys, radius_m, ratio))  # read more than once
    parts = effects.components(links, "a", "b")
    tops = representatives(climbs, keys)
    placed = tops.join(parts, tops["climb_id"] == parts["node"], "left").withColumn(
        "component", F.coalesce("component", "climb_id")
    )
    sizes = placed.filter(F.col(in_sample)).groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("_n"), F.min("day").alias("_first")
    )
    kept = sizes.filter(F.col("_n") > max_other_days)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", "component")) - 1
    numbered = kept.withColumn("route", number).select(*keys, "component", "route")
    return placed.join(numbered, [*keys, "component"], "left").select(*keys, "day", "component", "route")


def day_features(climbs: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Unweighted means of the kept climbs of a day."""
    return climbs.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("climbs"), *(F.avg(c).alias(c) for c in columns)
    )


@dataclass(frozen=True)
class Term:
    """A design column: the number of withdrawals at which it enters and leaves the design,
    and the property of the study without which it never stands."""

    name: str
    enters: int = 0
    leaves: int = 6
    needs: str | None = None


# Design columns in their order; withdrawals are numbered from one.
DESIGN_TERMS = (
    Term("one"),
    Term("date"),
    Term("season_sin", needs="seasonal"),
    Term("season_cos", needs="seasonal"),
    Term("hr", enters=3, needs="spline"),
    Term("hr_s1", leaves=3, needs="spline"),
    Term("hr_s2", leaves=3, needs="spline"),
    Term("log_gain"),
    Term("grade"),
    Term("elevation"),
    Term("ascent_before"),
    Term("descent_before", leaves=1),
    Term("hour", leaves=2),
    Term("e_s", leaves=5),
)
# The withdrawals that thin out routes and that give up the day step.
WITHDRAWALS, ROUTES_LEAVE, STEP5_LEAVES = 5, 4, 5


def design_columns(withdrawals: int, *, seasonal: bool, spline: bool) -> list[str]:
    """Names of the columns of a design, without routes, after so many withdrawals."""
    has = {None} | {name for name, on in (("seasonal", seasonal), ("spline", spline)) if on}
    return [t.name for t in DESIGN_TERMS if t.needs in has and t.enters <= withdrawals < t.leaves]


def chosen_designs(
    days: DataFrame,
    keys: Sequence[str],
    *,
    seasonal: bool,
    spline: bool,
    min_residual_df: int,
    min_estimable_df: int,
    min_route_days: int,
) -> DataFrame:
    """Design of each key: the fewest withdrawals that leave enough degrees of freedom.

    ``days``: keys, ``day``, ``component`` (route of the day), ``step5`` (motif, null where the
    day passes) and ``admitted``. All six designs are rows: their samples and routes are
    counted in one aggregation over the days, and the first within the budget (else the
    last) is a minimum over six rows a key. Routes with one day of the sample, or with
    fewer than ``min_route_days`` once routes are withdrawn, have no column; where every
    day's route has one, one of them is the reference. Returns the keys, ``withdrawals``,
    ``n``, ``routes``, ``p``, ``columns`` and ``estimable``."""
    keys = list(keys)
    designs = F.array(
        *(
            F.struct(
                F.lit(k).alias("withdrawals"),
                F.array(*map(F.lit, design_columns(k, seasonal=seasonal, spline=spline))).alias("columns"),
            )
            for k in range(WITHDRAWALS + 1)
        )
    )
    # Samples differ by the day step and by the size that a route must have: three of them.
    first_of = {k: min(j for j in range(WITHDRAWALS + 1) if (j >= ROUTES_LEAVE, j >= STEP5_LEAVES) == (k >= ROUTES_LEAVE, k >= STEP5_LEAVES)) for k in range(WITHDRAWALS + 1)}
    samples = F.array(*map(F.lit, sorted(set(first_of.values()))))
    dealt = days.select(*keys, "component", "step5", "admitted", F.explode(samples).alias("_s"))
    inside = F.col("admitted") & (F.col("step5").isNull() | (F.col("_s") >= STEP5_LEAVES))
    routes = dealt.filter(inside).groupBy(*keys, "_s", "component").agg(F.count(F.lit(1)).alias("_days"))
    alone = F.when(F.col("_s") >= ROUTES_LEAVE, min_route_days - 1).otherwise(1)
    wide = F.sum(F.when(F.col("_days") > alone, 1).otherwise(0))
    counted = routes.groupBy(*keys, "_s").agg(
        F.sum("_days").alias("n"),
        (wide - F.when(F.max(F.col("_days") <= alone), 0).otherwise(1)).alias("routes"),
    )
    # A key without a day in its first samples still has its designs, with n = 0.
    design_of = F.element_at(F.create_map(*(F.lit(x) for k in first_of.items() for x in k)), F.col("_d.withdrawals"))
    every = days.select(*keys).distinct().select("*", F.explode(designs).alias("_d")).withColumn("_s", design_of)
    sized = every.join(counted, [*keys, "_s"], "left").select(
        *keys,
        "_d.*",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.coalesce("routes", F.lit(0)).cast("long").alias("routes"),
    )
    sized = sized.withColumn("p", F.size("columns") + F.col("routes"))
    within = F.col("n") - F.col("p") >= min_residual_df
    place = F.when(within, F.col("withdrawals")).otherwise(2 * WITHDRAWALS + 1 - F.col("withdrawals"))
    best = sized.groupBy(*keys).agg(F.min(F.struct(place.alias("_place"), "withdrawals", "n", "routes", "p", "columns")).alias("_b"))
    estimable = (F.col("_b.n") - F.col("_b.p") >= min_estimable_df).alias("estimable")
    return best.select(*keys, "_b.withdrawals", "_b.n", "_b.routes", "_b.p", "_b.columns", estimable)


def design_rows(features: DataFrame, columns: Sequence[str], routes: Sequence[int], knots: Sequence[float] | None) -> DataFrame:
    """Design columns of each day: date, season, covariates, route indicators, spline."""
    sin, cos = trend.season(F.col("day"))
    out = (
        features.withColumn("one", F.lit(1.0))
        .withColumn("date", F.unix_date("day").cast("double"))
        .withColumn("season_sin", sin)
        .withColumn("season_cos", cos)
    )
    if knots:
        for i, column in enumerate(trend.natural_cubic_basis(F.col("hr"), knots), start=1):
            out = out.withColumn(f"hr_s{i}", column)
    for r in routes:
        out = out.withColumn(f"route_{r}", F.when(F.col("route") == r, 1.0).otherwise(0.0))
    return out.select(
        "day", "y", *[c for c in columns if c in out.columns], *(f"route_{r}" for r in routes)
    )


def spline_knots(rows: DataFrame, value: str) -> list[float]:
    """Knots at the 10, 50 and 90 % ranks of a column."""
    from ridgeflow.operators import quantiles

    found = quantiles.rank_quantiles(rows, [], value, {"a": (1, 10), "b": (1, 2), "c": (9, 10)})
    row = found.collect()[0]
    return [float(row[c]) for c in ("a", "b", "c")]


def partial_residuals(rows: DataFrame, fit: trend.LinearFit, constant: str, date: str) -> DataFrame:
    """Response minus every fitted term but the constant and the date."""
    rest = [
        F.col(c) * float(b)
        for c, b in zip(fit.columns, fit.coef, strict=True)
        if c not in (constant, date)
    ]
    total = F.lit(0.0)
    for term in rest:
        total = total + term
    return rows.withColumn("partial", F.col("y") - total)


def missing_shares(rows: DataFrame, period: str, missing: Column) -> DataFrame:
    """Share of days excluded by a missing quantity in each period."""
    return rows.groupBy(period).agg(
        (F.sum(F.when(missing, 1).otherwise(0)) / F.count(F.lit(1))).alias("missing_share"),
        F.count(F.lit(1)).alias("days"),
    )


def imputed_bounds(
    rows: DataFrame, columns: Sequence[str], y: str, missing: DataFrame, level: float, spread: float
) -> tuple[float, float]:
    """Date slopes with the missing days imputed at both bounds of a level."""
    slopes = []
    for sign in (-1.0, 1.0):
        filled = missing.withColumn(y, F.lit(level + sign * spread))
        both = rows.select(*columns, y).unionByName(filled.select(*columns, y))
        fit = trend.ols(both, list(columns), y)
        slopes.append(float(fit.coef[list(columns).index("date")]))
    return min(slopes), max(slopes)


def bounded_reading(
    direct: tuple[float, float], inverse: tuple[float, float] | None, holds_zero: bool, delta: float
) -> str:
    """Reading of a direct interval bounded by an optional second one."""
    intervals = [direct] if inverse is None or holds_zero else [direct, inverse]
    if holds_zero and inverse is not None:
        return "undecided"
    if all(low > 0 for low, _ in intervals) or all(high < 0 for _, high in intervals):
        return "established"
    if all(-delta < low and high < delta for low, high in intervals):
        return "no_useful_effect"
    return "undecided"
