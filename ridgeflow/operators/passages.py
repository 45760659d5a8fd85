"""Named passages of matched outings: attachment, crossing, stops, chronology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeflow.functions import geo
from ridgeflow.operators import clocks, lookup, matching, ordered, route
from ridgeflow.session import cut_lineage

# Snapping distance and ties of the attribution (m, s, m).
SNAP_M = 1.0
TIME_TIE_S = 1.0
DISTANCE_TIE_M = 1.0


def attach(places: DataFrame, step_m: float) -> DataFrame:
    """Role and score point of each place (``at_m`` on a route of ``length_m``).

    Closer than a metre to the end: arrival; to the start: departure; else the nearest
    score point within a metre, else between ``k`` and ``k + 1``."""
    s, length = F.col("at_m"), F.col("length_m")
    last = F.ceil(length / step_m).cast("int")
    k = F.least(F.floor(s / step_m).cast("int"), last - 1)
    after = F.when(k + 1 == last, length).otherwise((k + 1) * float(step_m))
    arrival = F.abs(length - s) < SNAP_M
    departure = ~arrival & (s < SNAP_M)
    low = s - k * float(step_m) < SNAP_M
    high = after - s < SNAP_M
    return (
        places.withColumn(
            "role",
            F.when(arrival, "arrival").when(departure, "departure").otherwise("intermediate"),
        )
        .withColumn(
            "k",
            F.when(arrival, last).when(departure, 0).when(low, k).when(high, k + 1).otherwise(k),
        )
        .withColumn("snapped", arrival | departure | low | high)
    )


def observe(
    places: DataFrame,
    points: DataFrame,
    prefix: DataFrame,
    line: DataFrame,
    records: DataFrame,
    partition: DataFrame,
    keys: Sequence[str],
    rules: matching.MatchRules = matching.MatchRules(),
) -> DataFrame:
    """Observation of every named place of every outing.

    ``places``: keys, ``name``, ``at_m``; ``points`` / ``prefix``: score points and the
    coverage of the matching. Result: role, status, crossing, arrival, departure, stop
    time, number of episodes, chronology violation, comparability and its reason."""
    keys = list(keys)
    cover = prefix.select(
        *keys, "length_m", "origin_m", "origin_s", "prefix_count", "prefix_end_m",
        "prefix_end_s", "k_last", "final_s",
    )
    order = Window.partitionBy(*keys).orderBy("at_m", "name")
    tagged = attach(places.join(cover, keys), rules.step_m).withColumn(
        "rank", F.row_number().over(order) - 1
    )
    inside = (F.col("prefix_count") >= 1) & F.col("at_m").between(
        F.col("origin_m"), F.col("prefix_end_m")
    )
    whole = F.col("prefix_count") == F.col("k_last")
    looked = (
        F.when(F.col("role") == "departure", True)
        .when(F.col("role") == "arrival", whole)
        .otherwise(inside)
    )
    tagged = cut_lineage(tagged.withColumn("_looked", looked))
    resumed = _resumed(tagged.filter("_looked and snapped"), points, records, keys)
    bracketed = _bracketed(
        tagged.filter("_looked and not snapped"), points, line, records, keys, rules
    )
    outside = tagged.filter(~F.col("_looked")).select(
        *keys,
        "rank",
        F.lit("outside_prefix").alias("status"),
        F.lit(None).cast("double").alias("crossing_s"),
        F.lit(None).cast("double").alias("window0_s"),
        F.lit(None).cast("double").alias("window1_s"),
    )
    searched = cut_lineage(
        tagged.join(resumed.unionByName(bracketed).unionByName(outside), [*keys, "rank"])
    )
    episodes = attribute_stops(searched, partition, records, line, keys, rules)
    stops = episodes.filter(F.col("outcome") == "attributed").groupBy(
        *keys, F.col("passage").alias("rank")
    ).agg(
        F.min("start_s").alias("_a"),
        F.max("end_s").alias("_b"),
        F.sum(F.col("end_s") - F.col("start_s")).alias("_s"),
        F.count(F.lit(1)).alias("_n"),
    )
    timed = searched.join(stops, [*keys, "rank"], "left")
    dated = F.col("crossing_s").isNotNull()
    timed = (
        timed.withColumn(
            "arrival_s", F.when(dated, F.least("crossing_s", F.coalesce("_a", "crossing_s")))
        )
        .withColumn(
            "departure_s", F.when(dated, F.greatest("crossing_s", F.coalesce("_b", "crossing_s")))
        )
        .withColumn("stop_s", F.when(dated, F.coalesce("_s", F.lit(0.0))))
        .withColumn("episodes", F.coalesce("_n", F.lit(0)))
    )
    judged = chronology(
        timed.filter((F.col("role") == "intermediate") & (F.col("status") == "found")), keys
    )
    out = timed.join(judged, [*keys, "rank"], "left").withColumn(
        "violation", F.coalesce("violation", F.lit(False))
    )
    status = F.when(F.col("violation"), "ambiguous").otherwise(F.col("status"))
    out = out.withColumn("status", status)
    kept = (F.col("origin_s") <= F.col("arrival_s")) & (
        F.col("departure_s") <= F.col("prefix_end_s")
    )
    seen = F.col("status").isin("found", "anchored")
    comparable = seen & (F.col("role") != "departure") & F.coalesce(kept, F.lit(False))
    reason = (
        F.when(F.col("role") == "departure", None)
        .when(seen & ~comparable, "insufficient_support")
        .when(~seen, F.col("status"))
    )
    return out.withColumn("comparable", comparable).withColumn("unavailability", reason).select(
        *keys, "rank", "name", "at_m", "role", "status", "crossing_s", "window0_s", "window1_s",
        "arrival_s", "departure_s", "stop_s", "episodes", "violation", "comparable",
        "unavailability",
    )


def _resumed(
    snapped: DataFrame, points: DataFrame, records: DataFrame, keys: list[str]
) -> DataFrame:
    """Places on a score point: its status and instant, window from the point before to
    the next dated point (or the last record)."""
    ends = records.groupBy(*keys).agg(F.max("time_s").alias("_last"))
    back = ordered.shift(points.select(*keys, "k", "status", "t"), keys, ["k"], {"_t0": F.col("t")})
    ahead = ordered.running(
        back, keys, ["k"], {"_t1": ("last", F.col("t"))}, inclusive=False, reverse=True
    )
    near = ahead.select(*keys, "k", F.col("status").alias("_st"), "t", "_t0", "_t1")
    joined = snapped.join(near, [*keys, "k"]).join(ends, keys)
    dated = F.col("t").isNotNull()
    start = F.when(F.col("k") == 0, F.col("t")).otherwise(F.col("_t0"))
    return joined.select(
        *keys,
        "rank",
        F.col("_st").alias("status"),
        F.col("t").alias("crossing_s"),
        F.when(dated, start).alias("window0_s"),
        F.when(dated, F.coalesce("_t1", "_last")).alias("window1_s"),
    )


def _bracketed(
    between: DataFrame,
    points: DataFrame,
    line: DataFrame,
    records: DataFrame,
    keys: list[str],
    rules: matching.MatchRules,
) -> DataFrame:
    """Places between two dated score points: events of their own normal there."""
    sides = points.select(*keys, "k", "pos", "t")
    spans = between.join(
        sides.withColumnRenamed("pos", "_p0").withColumnRenamed("t", "_t0"), [*keys, "k"]
    ).join(
        sides.select(
            *keys, (F.col("k") - 1).alias("k"), F.col("pos").alias("_p1"), F.col("t").alias("_t1")
        ),
        [*keys, "k"],
    )
    slim = spans.select(*keys, "rank", "at_m", "length_m", "_p0", "_p1", "_t0", "_t1")
    frames = cut_lineage(
        route.frames_at(slim, ordered.without_chunks(line), keys, "at_m")
    )
    asked = frames.select(
        *keys, F.col("rank").alias("k"), F.lit(False).alias("last"), "q_lat", "q_lon", "tx", "ty"
    )
    steps = matching.trace_steps(records, keys)
    hits = matching.crossings(asked, steps, keys, rules)
    bounds = frames.select(*keys, F.col("rank").alias("k"), "_p0", "_p1")
    inside = hits.join(bounds, [*keys, "k"]).filter(
        (F.col("pos") > F.col("_p0")) & (F.col("pos") < F.col("_p1"))
    )
    seq = Window.partitionBy(*keys, "k").orderBy("pos")
    starts = F.when((F.row_number().over(seq) == 1) | ~F.col("joined"), 1).otherwise(0)
    events = inside.withColumn("_s", starts).groupBy(*keys, "k").agg(
        F.sum("_s").alias("events"), F.max_by("t", "pos").alias("t")
    )
    any_crossing = _oriented_between(frames, steps, keys)
    joined = frames.join(
        events.withColumnRenamed("k", "rank"), [*keys, "rank"], "left"
    ).join(any_crossing, [*keys, "rank"], "left")
    count = F.coalesce("events", F.lit(0))
    status = (
        F.when(F.col("tx").isNull(), matching.NO_TANGENT)
        .when(count == 1, matching.FOUND)
        .when(count > 1, matching.AMBIGUOUS)
        .when(F.col("_far").isNotNull(), matching.OUT_OF_TOLERANCE)
        .otherwise(matching.ABSENT)
    )
    found = status == matching.FOUND
    return joined.select(
        *keys,
        "rank",
        status.alias("status"),
        F.when(found, F.col("t")).alias("crossing_s"),
        F.when(found, F.col("_t0")).alias("window0_s"),
        F.when(found, F.col("_t1")).alias("window1_s"),
    )


def _oriented_between(frames: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    spans = frames.filter(F.col("tx").isNotNull())
    pairs = lookup.overlap_join(
        spans.select(*keys, "rank", "_p0", "_p1", "q_lat", "q_lon", "tx", "ty"),
        steps.withColumn("_i0", F.col("i").cast("double")).withColumn("_i1", F.col("i") + 1.0),
        keys,
        ("_p0", "_p1"),
        ("_i0", "_i1"),
        256.0,
    )
    frame = [F.col(c) for c in ("q_lat", "q_lon", "tx", "ty")]
    h0, _ = geo.along_across(*frame, F.col("r_lat"), F.col("r_lon"))
    h1, _ = geo.along_across(*frame, F.col("n_lat"), F.col("n_lon"))
    pos = F.col("i") + matching.crossing_share(h0, h1)
    hit = (
        (F.col("r_block") == F.col("n_block"))
        & matching.crosses(h0, h1, F.lit(False))
        & (pos > F.col("_p0"))
        & (pos < F.col("_p1"))
    )
    return pairs.filter(hit).select(*keys, "rank").distinct().withColumn("_far", F.lit(True))


def attribute_stops(
    searched: DataFrame,
    partition: DataFrame,
    records: DataFrame,
    line: DataFrame,
    keys: list[str],
    rules: matching.MatchRules,
) -> DataFrame:
    """Each stop under the central convention with the one place it belongs to.

    Candidates: found intermediate places nearer than the tolerance to the stop's median
    smoothed position, whose window touches the stop."""
    stops = clocks.stop_episodes(partition, keys)
    inside = lookup.overlap_join(
        stops.select(*keys, "start_s", "end_s"),
        records.select(
            *keys, "lat_s", "lon_s", F.col("time_s").alias("_t0"), F.col("time_s").alias("_t1")
        ),
        keys,
        ("start_s", "end_s"),
        ("_t0", "_t1"),
        600.0,
        closed=True,
    )
    # A stop is at most a recording long; its two medians are exact.
    centres = inside.groupBy(*keys, "start_s", "end_s").agg(
        F.percentile("lat_s", 0.5).alias("m_lat"), F.percentile("lon_s", 0.5).alias("m_lon")
    )
    places = route.position_at(
        searched.filter((F.col("role") == "intermediate") & (F.col("status") == "found")).select(
            *keys, "rank", "at_m", "crossing_s", "window0_s", "window1_s"
        ),
        ordered.without_chunks(line),
        keys,
        "at_m",
    )
    pairs = lookup.overlap_join(
        centres, places, keys, ("start_s", "end_s"), ("window0_s", "window1_s"), 1800.0, closed=True
    )
    away = F.hypot(
        geo.local_x(F.col("lat_at"), F.col("lon_at"), F.col("m_lon")),
        geo.local_y(F.col("lat_at"), F.col("m_lat")),
    )
    candidates = pairs.withColumn("away_m", away).filter(F.col("away_m") < rules.tolerance_m)
    delay = time_distance(F.col("crossing_s"), F.col("start_s"), F.col("end_s"))
    decided = attribute(candidates.withColumn("delay_s", delay), [*keys, "start_s", "end_s"])
    out = centres.join(decided, [*keys, "start_s", "end_s"], "left")
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("no_candidate")))


def time_distance(t: Column, start: Column, end: Column) -> Column:
    return F.when(t.between(start, end), 0.0).otherwise(
        F.least(F.abs(t - start), F.abs(t - end))
    )


def attribute(candidates: DataFrame, episode: Sequence[str]) -> DataFrame:
    """Outcome of each episode: keep the candidates within a second of the smallest
    delay, then, if several, within a metre of their smallest distance."""
    episode = list(episode)
    group = Window.partitionBy(*episode)
    near = candidates.withColumn("_b", F.min("delay_s").over(group)).filter(
        F.col("delay_s") - F.col("_b") <= TIME_TIE_S
    )
    near = near.withColumn("_k", F.count(F.lit(1)).over(group)).withColumn(
        "_m", F.min("away_m").over(group)
    )
    kept = near.filter((F.col("_k") == 1) | (F.col("away_m") - F.col("_m") <= DISTANCE_TIE_M))
    return kept.groupBy(*episode).agg(
        F.when(F.count(F.lit(1)) == 1, F.max("rank")).alias("passage"),
        F.when(F.count(F.lit(1)) == 1, "attributed").otherwise("tie").alias("outcome"),
    )


def chronology(envelopes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks both members of each pair of consecutive places whose departure follows the
    next arrival, and the last place against the final arrival."""
    seq = Window.partitionBy(*keys).orderBy("at_m", "rank")
    last = F.lead("rank").over(seq).isNull()
    final = F.when(
        last & (F.col("prefix_count") == F.col("k_last")), F.col("departure_s") > F.col("final_s")
    )
    ahead = F.col("departure_s") > F.lead("arrival_s").over(seq)
    behind = F.lag("departure_s").over(seq) > F.col("arrival_s")
    marked = F.coalesce(ahead, F.lit(False)) | F.coalesce(behind, F.lit(False))
    return envelopes.select(
        *keys, "rank", (marked | F.coalesce(final, F.lit(False))).alias("violation")
    )


def observe_outing(
    segments: DataFrame,
    passages_table: DataFrame,
    points: DataFrame,
    prefix: DataFrame,
    partition: DataFrame,
    keys: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(segment times, usage targets) of every outing, independent of any model.

    Segment times are arrays over the eleven clocks; targets are the intermediate places
    then one arrival, each with its abscissa, times from the origin and motif."""
    from ridgeflow.operators.scoring import default_targets

    keys = list(keys)
    admitted = segments.filter(F.col("exclusion").isNull())
    timed = clocks.span_clocks(
        admitted.select(*keys, "k", "klass", "start_m", "end_m", "realized_start_m", "realized_end_m", "start_s", "end_s"),
        partition,
        keys,
        "start_s",
        "end_s",
    )
    ends = prefix.select(*keys, "origin_m", "origin_s", "final_s", "k_last", "prefix_count", "length_m")
    last_point = points.filter("last").select(*keys, F.col("effective_m").alias("_end_m"))
    wanted = default_targets(passages_table, keys).join(ends, keys).join(last_point, keys)
    named = wanted.join(
        passages_table.select(*keys, "rank", "at_m", "departure_s", "comparable", "unavailability"),
        [*keys, "rank"],
        "left",
    )
    whole = F.col("prefix_count") == F.col("k_last")
    at = F.when(F.col("is_arrival"), F.col("_end_m")).otherwise(F.col("at_m"))
    instant = F.when(F.col("is_arrival"), F.when(whole, F.col("final_s"))).otherwise(
        F.when(F.col("comparable"), F.col("departure_s"))
    )
    motif = F.when(
        F.col("is_arrival"), F.when(~whole, "insufficient_support")
    ).otherwise(F.when(~F.col("comparable"), F.col("unavailability")))
    seq = Window.partitionBy(*keys).orderBy("is_arrival", "at_m")
    listed = named.select(
        *keys,
        (F.row_number().over(seq) - 1).alias("k"),
        "is_arrival",
        at.alias("s_m"),
        "origin_m",
        "origin_s",
        instant.alias("instant_s"),
        motif.alias("motif"),
    )
    seen = listed.filter(F.col("instant_s").isNotNull())
    times = clocks.span_clocks(seen.select(*keys, "k", "origin_s", "instant_s"), partition, keys, "origin_s", "instant_s")
    return timed, listed.join(times.select(*keys, "k", "times"), [*keys, "k"], "left")
