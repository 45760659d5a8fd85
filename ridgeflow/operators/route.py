"""Route profiles: deduplicated polyline, regular grid, smoothing, grades, places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.functions import geo
from ridgeflow.operators import lookup, ordered
from ridgeflow.session import cut_lineage

# Grid step, smoothing window, place offset and separation, metres.
GRID_STEP_M = 50.0
SMOOTHING_WINDOW_M = 150.0
PLACE_MAX_OFFSET_M = 150.0
PLACE_MIN_SEPARATION_M = 500.0


def polyline(points: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Route points without zero-length steps, with the cumulated ``distance_m``.

    A point equal to the last kept one is equal to its predecessor, so one ``lag``
    decides; the first of each run of equal points is kept."""
    points = ordered.assign_chunks(points, keys, order)
    back = ordered.shift(
        points, keys, [order], {"_plat": F.col("lat"), "_plon": F.col("lon")}, checked=True
    )
    step = geo.haversine_m(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon"))
    kept = back.withColumn("step_m", F.coalesce(step, F.lit(0.0))).filter(
        F.col("_plat").isNull() | (F.col("step_m") > 0)
    )
    return ordered.running(
        kept.drop("_plat", "_plon"), keys, [order], {"distance_m": ("sum", F.col("step_m"))}, checked=True
    )


def polyline_steps(
    line: DataFrame, keys: Sequence[str], order: str = "seq", *, checked: bool = False
) -> DataFrame:
    """Segments of a polyline: bounds, positions, elevations, first/last flags.

    ``checked``: keys above the target have just been looked for."""
    line = line if checked else ordered.assign_chunks(line, keys, order)
    led = ordered.shift(
        line,
        keys,
        [order],
        {
            "b_m": F.col("distance_m"),
            "b_lat": F.col("lat"),
            "b_lon": F.col("lon"),
            "b_ele": F.col("ele"),
        },
        forward=True,
        checked=True,
    )
    segments = led.filter(F.col("b_m").isNotNull()).select(
        *keys,
        *[c for c in ordered.HELPERS if c in led.columns],
        F.col(order).alias("seq"),
        F.col("distance_m").alias("a_m"),
        F.col("lat").alias("a_lat"),
        F.col("lon").alias("a_lon"),
        F.col("ele").alias("a_ele"),
        "b_m",
        "b_lat",
        "b_lon",
        "b_ele",
    )
    return ordered.running(
        segments, keys, ["seq"], {"length_m": ("max", F.col("b_m"))}, reverse=True, checked=True
    ).withColumn("is_first", F.col("a_m") == 0).withColumn(
        "is_last", F.col("b_m") == F.col("length_m")
    )


def regular_grid(segments: DataFrame, keys: Sequence[str], step_m: float) -> DataFrame:
    """Abscissas ``0, h, 2h ...`` ending exactly at the length, each emitted by the
    polyline segment that holds it and read linearly there: no look-up join.

    The last step measures between half and one and a half steps; a line shorter than a
    step gives its two ends. Needs ``length_m`` on every segment of the key."""
    total = F.max("b_m")
    lengths = segments.groupBy(*keys).agg(total.alias("length_m"))
    joined = segments.drop("length_m").join(lengths, list(keys))
    h = F.lit(float(step_m))
    n = F.floor(F.col("length_m") / h)
    short = F.col("length_m") < h
    absorbed = F.col("length_m") - n * h < h / 2
    last_regular = F.when(short, 0).when(absorbed, n - 1).otherwise(n)
    numbers = F.sequence(F.floor(F.col("a_m") / h), F.ceil(F.col("b_m") / h))
    spots = F.transform(
        F.filter(
            numbers,
            lambda k: (k * h >= F.col("a_m")) & (k * h < F.col("b_m")) & (k <= last_regular),
        ),
        lambda k: F.struct(k.alias("i"), (k * h).alias("distance_m")),
    )
    end = F.array(
        F.struct(
            (last_regular + 1).cast("long").alias("i"), F.col("length_m").alias("distance_m")
        )
    )
    spots = F.when(F.col("b_m") == F.col("length_m"), F.concat(spots, end)).otherwise(spots)
    grid = joined.withColumn("_spot", F.explode(spots))
    share = (F.col("_spot.distance_m") - F.col("a_m")) / (F.col("b_m") - F.col("a_m"))
    return grid.select(
        *keys,
        F.col("_spot.i").alias("i"),
        F.col("_spot.distance_m").alias("distance_m"),
        geo.lerp(F.col("a_ele"), F.col("b_ele"), share).alias("raw_m"),
    )


def smoothing_points(step_m: float, window_m: float) -> int:
    """Half size, in grid points, of the centred elevation mean."""
    return int(window_m // (2 * step_m))


def smooth_grid(
    grid: DataFrame, keys: Sequence[str], step_m: float, window_m: float
) -> DataFrame:
    """Adds ``elevation_m``: centred mean of ``raw_m``, shrinking at both ends."""
    half = smoothing_points(step_m, window_m)
    if half == 0:
        return grid.withColumn("elevation_m", F.col("raw_m"))
    grid = ordered.assign_chunks(grid, keys, "i")
    return ordered.framed(
        grid, keys, "i", -half, half, {"elevation_m": lambda w: F.avg("raw_m").over(w)}
    )


def with_grade(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the interval that starts at each grid point: ``end_m``, ``end_z``, ``grade``.

    The last point has none (null)."""
    led = ordered.shift(
        ordered.assign_chunks(grid, keys, "i"),
        keys,
        ["i"],
        {"end_m": F.col("distance_m"), "end_z": F.col("elevation_m")},
        forward=True,
        checked=True,
    )
    rise = F.col("end_z") - F.col("elevation_m")
    return led.withColumn("grade", rise / (F.col("end_m") - F.col("distance_m")))


def build_profile(
    points: DataFrame,
    keys: Sequence[str],
    *,
    step_m: float = GRID_STEP_M,
    window_m: float = SMOOTHING_WINDOW_M,
    order: str = "seq",
) -> DataFrame:
    """Route points to the smoothed grid with grades (``i``, ``distance_m``, ``raw_m``,
    ``elevation_m``, ``end_m``, ``end_z``, ``grade``). Routes of no length give no row."""
    segments = polyline_steps(polyline(points, keys, order), keys, order, checked=True)
    # Read by each scan that looks for large keys, and twice by the last two: written once.
    grid = cut_lineage(regular_grid(ordered.without_chunks(segments), keys, step_m))
    return with_grade(smooth_grid(grid, keys, step_m, window_m), keys)


def place_passages(
    places: DataFrame,
    segments: DataFrame,
    grid: DataFrame,
    keys: Sequence[str],
    *,
    max_offset_m: float = PLACE_MAX_OFFSET_M,
    min_separation_m: float = PLACE_MIN_SEPARATION_M,
) -> DataFrame:
    """Passages of a route at its named places.

    Local minima of the distance to the line (inside a segment, at a vertex between two
    segments, at either end) at most ``max_offset_m`` away; the closest first, any other
    nearer than ``min_separation_m`` along the route is dropped. Places meet only the
    segments of their own map cell; ``places``: keys, ``name``, ``lat``, ``lon``."""
    cell = max_offset_m / geo.EARTH_RADIUS_M * 57.29577951308232
    near = ordered.shift(
        segments,
        keys,
        ["seq"],
        {"n_lat": F.col("b_lat"), "n_lon": F.col("b_lon")},
        forward=True,
    )
    top = F.greatest(F.abs("a_lat"), F.abs("b_lat")) + 2 * cell
    lon_margin = cell / F.greatest(F.cos(F.radians(top)), F.lit(0.02)) * 1.01

    def cells(a: str, b: str, margin: Column | float) -> Column:
        low = F.floor((F.least(a, b) - margin) / cell)
        high = F.floor((F.greatest(a, b) + margin) / cell)
        return F.explode(F.sequence(low, high))

    tiled = near.withColumn("_cy", cells("a_lat", "b_lat", cell * 1.01)).withColumn(
        "_cx", cells("a_lon", "b_lon", lon_margin)
    )
    spots = places.select(
        *keys,
        "name",
        F.col("lat").alias("p_lat"),
        F.col("lon").alias("p_lon"),
        F.floor(F.col("lat") / cell).alias("_cy"),
        F.floor(F.col("lon") / cell).alias("_cx"),
    )
    met = tiled.join(spots, [*keys, "_cy", "_cx"])
    corners = [F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon", "p_lat", "p_lon")]
    share, offset = geo.foot_on_segment(*corners)
    after, _ = geo.foot_on_segment(
        *[F.col(c) for c in ("b_lat", "b_lon", "n_lat", "n_lon", "p_lat", "p_lon")]
    )
    met = met.withColumn("_t", share).withColumn("offset_m", offset).withColumn("_u", after)
    t = F.col("_t")
    minimum = (
        ((t > 0) & (t < 1))
        | (F.col("is_first") & (t == 0))
        | (F.col("is_last") & (t == 1))
        | ((t == 1) & F.col("n_lat").isNotNull() & (F.col("_u") == 0))
    )
    at = F.when(t == 1, F.col("b_m")).otherwise(
        F.col("a_m") + t * (F.col("b_m") - F.col("a_m"))
    )
    found = (
        met.filter(minimum & (F.col("offset_m") <= max_offset_m))
        .withColumn("at_m", at)
        .groupBy(*keys, "name", "p_lat", "p_lon", "at_m")
        .agg(F.min("offset_m").alias("offset_m"))
    )
    listed = found.groupBy(*keys, "name", "p_lat", "p_lon").agg(
        F.sort_array(F.collect_list(F.struct("offset_m", "at_m"))).alias("_all")
    )
    kept = F.aggregate(
        "_all",
        F.slice("_all", 1, 0),
        lambda acc, c: F.when(
            F.forall(acc, lambda k: F.abs(c["at_m"] - k["at_m"]) >= min_separation_m),
            F.concat(acc, F.array(c)),
        ).otherwise(acc),
    )
    passages = listed.select(*keys, "name", F.inline(kept))
    return lookup.interpolated_at(
        passages, grid, keys, "at_m", "distance_m", ["distance_m"], ["elevation_m"]
    ).withColumnRenamed("elevation_m_at", "elevation_m")


def position_at(
    probes: DataFrame, line: DataFrame, keys: Sequence[str], at: str
) -> DataFrame:
    """Probes with the route position (``lat_at``, ``lon_at``) at an abscissa."""
    return lookup.interpolated_at(
        probes, line, keys, at, "distance_m", ["distance_m"], ["lat", "lon"]
    )


# Half chord of a tangent and shortest usable chord, metres.
HALF_CHORD_M = 25.0
MIN_CHORD_M = 1e-6


def frames_at(probes: DataFrame, line: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Local frames on a route: anchor (``q_lat``, ``q_lon``) and unit tangent
    (``tx``, ``ty``), null where the 50 m chord is too short to have a direction.

    ``length_m`` must be on the probes."""
    base = ordered.without_chunks(probes).columns
    spots = F.array(
        F.struct(F.lit("q").alias("_tag"), F.col(at).alias("_m")),
        F.struct(F.lit("u").alias("_tag"), F.greatest(F.lit(0.0), F.col(at) - HALF_CHORD_M).alias("_m")),
        F.struct(F.lit("v").alias("_tag"), F.least(F.col("length_m"), F.col(at) + HALF_CHORD_M).alias("_m")),
    )
    # One look-up reads the anchor and both chord ends of every probe.
    read = position_at(
        ordered.without_chunks(probes).select("*", F.inline(spots)), line, keys, "_m"
    )
    chord = read.groupBy(*base).agg(
        *(
            F.max(F.when(F.col("_tag") == tag, F.col(f"{axis}_at"))).alias(f"{tag}_{axis}")
            for tag in ("q", "u", "v")
            for axis in ("lat", "lon")
        )
    )
    q_lat, q_lon = F.col("q_lat"), F.col("q_lon")
    dx = geo.local_x(q_lat, q_lon, F.col("v_lon")) - geo.local_x(
        q_lat, q_lon, F.col("u_lon")
    )
    dy = geo.local_y(q_lat, F.col("v_lat")) - geo.local_y(q_lat, F.col("u_lat"))
    size = F.hypot(dx, dy)
    usable = size >= MIN_CHORD_M
    return chord.select(
        *base,
        "q_lat",
        "q_lon",
        F.when(usable, dx / size).alias("tx"),
        F.when(usable, dy / size).alias("ty"),
    )
