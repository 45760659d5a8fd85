"""Point-in-time rules: what is known at an origin, retained outings, performances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.operators import ordered

# Daily limit of cumulated time (s) and steepness of the domain (m per km).
RETENTION_LIMIT_S = 4 * 3600.0
DOMAIN_DPLUS_PER_KM = 40.0


def recording_end(
    channels: DataFrame, sessions: DataFrame, timer: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Last instant of each recording over its channels, sessions and timer events."""
    last = channels.groupBy(*keys).agg(F.max("time_s").alias("last_s"))
    ends = sessions.groupBy(*keys).agg(
        F.max(F.greatest("start_s", F.col("start_s") + F.coalesce("elapsed_s", F.lit(0.0)))).alias(
            "last_s"
        )
    )
    marks = timer.groupBy(*keys).agg(F.max("time_s").alias("last_s"))
    every = last.unionByName(ends).unionByName(marks)
    return every.groupBy(*keys).agg(F.max("last_s").alias("last_s"))


def activity_ends(index: DataFrame, recordings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index end, recording end, safe end (the later) and how it was found.

    ``index``: ``start_s``, ``elapsed_s``; ``recordings``: ``recording_start_s``, ``last_s``."""
    joined = index.join(recordings, list(keys), "left")
    index_end = F.col("start_s") + F.col("elapsed_s")
    watch_end = F.col("recording_start_s") + F.col("last_s")
    method = (
        F.when(index_end.isNotNull() & watch_end.isNotNull(), "both")
        .when(index_end.isNotNull(), "index_only")
        .when(watch_end.isNotNull(), "inferred")
        .otherwise("unknown")
    )
    return (
        joined.withColumn("index_end", index_end)
        .withColumn("recording_end", watch_end)
        .withColumn("safe_end", F.greatest(index_end, watch_end))
        .withColumn("end_method", method)
    )


def decide(index_end: Column, safe_end: Column, origin: Column, bound: Column) -> Column:
    """Decision on an activity at an origin: the index end first (no recording is read
    for what it settles), then the safe end."""
    return (
        F.when(index_end >= origin, "after_origin")
        .when(bound.isNotNull() & (index_end < bound), "before_window")
        .when(safe_end.isNull(), "unknown_end")
        .when(safe_end >= origin, "after_origin")
        .when(bound.isNotNull() & (safe_end < bound), "before_window")
        .otherwise("candidate")
    )


def select_at_origins(
    activities: DataFrame, origins: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Every (origin, window, activity) of an athlete with its decision.

    ``origins`` (keys, ``origin``, ``bound``, ...) is the declared list of origins and
    windows; activities that end at or after an origin never meet it: the join carries
    the time condition."""
    joined = activities.join(
        origins, [activities[k] == origins[k] for k in keys] + [activities["index_end"] < origins["origin"]]
    )
    for k in keys:
        joined = joined.drop(origins[k])
    decision = decide(F.col("index_end"), F.col("safe_end"), F.col("origin"), F.col("bound"))
    return joined.withColumn("decision", decision)


def origin_history(activities: DataFrame, origins: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Counts known at each origin and the cold-start warning (none of the kinds)."""
    from ridgeflow.operators import lookup

    flags = activities.filter(F.col("safe_end").isNotNull()).groupBy(
        *keys, F.col("safe_end").alias("_e")
    ).agg(
        F.count(F.lit(1)).alias("_all"),
        F.sum(F.when(F.col("activity_type").isin(*kinds), 1).otherwise(0)).alias("_kind"),
        F.sum(F.when(F.col("has_recording"), 1).otherwise(0)).alias("_rec"),
    )
    summed = ordered.running(
        flags, keys, ["_e"], {f"s{c}": ("sum", F.col(c)) for c in ("_all", "_kind", "_rec")}
    )
    known = lookup.asof(
        origins, ordered.without_chunks(summed), keys, "origin", "_e", ["s_all", "s_kind", "s_rec"], strict=True
    )
    out = known.select(
        *origins.columns,
        F.coalesce("s_all", F.lit(0)).alias("known"),
        F.coalesce("s_kind", F.lit(0)).alias("known_kind"),
        F.coalesce("s_rec", F.lit(0)).alias("known_recorded"),
    )
    return out.withColumn("cold_start", F.col("known_kind") == 0)


def retain_outings(
    outings: DataFrame, keys: Sequence[str], limit_s: float = RETENTION_LIMIT_S
) -> DataFrame:
    """Rank of each outing in its civil day; kept if first or while the cumulated time
    stays under the limit. ``outings``: ``civil_date``, ``start_s``, ``outing_id``,
    ``elapsed_s``."""
    group = [*keys, "civil_date"]
    out = ordered.running(
        outings,
        group,
        ["start_s", "outing_id"],
        {"rank": ("sum", F.lit(1)), "cumulated_s": ("sum", F.col("elapsed_s"))},
    )
    return ordered.without_chunks(out).withColumn(
        "retained", (F.col("rank") == 1) | (F.col("cumulated_s") < limit_s)
    )


def in_domain(sport: Column, day: Column, dplus_per_km: Column, start: Column) -> Column:
    """On foot, from the start date on, steep enough."""
    return (sport == "foot") & (day >= start) & (dplus_per_km >= DOMAIN_DPLUS_PER_KM)


def dplus_per_km(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positive gain of each smoothed profile per kilometre."""
    rise = F.greatest(F.col("end_z") - F.col("elevation_m"), F.lit(0.0))
    return profile.groupBy(*keys).agg(
        (F.sum(rise) / F.max("distance_m") * 1000).alias("dplus_per_km")
    )


def profile_source(reference: Column, traces: Column) -> Column:
    """Artefact that gives the domain profile: reference, else traces, else none."""
    return F.when(reference.isNotNull(), "reference").when(traces > 0, "traces").otherwise("none")


def group_performances(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One performance per civil day of retained in-domain outings, listed by rank.

    The daily limit bounds the outings of a day, hence the list."""
    kept = decisions.filter(F.col("retained") & F.col("in_domain"))
    return kept.groupBy(*keys, "civil_date").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "outing_id"))), lambda o: o["outing_id"]
        ).alias("outings"),
        F.max(F.col("start_s") + F.col("elapsed_s")).alias("end_time"),
        F.min(F.col("label") == "training").alias("is_training"),
        F.max(F.col("label") == "race").alias("is_race"),
    )


def correspondence_violations(
    points: DataFrame, activities: DataFrame, keys: Sequence[str], tolerance_s: float
) -> DataFrame:
    """Trace points inside no activity interval widened by a tolerance.

    The activity intervals are merged first, so one as-of look-up per point decides."""
    from ridgeflow.operators import islands, lookup

    wide = activities.select(
        *keys,
        (F.col("start_s") - tolerance_s).alias("_a"),
        (F.col("end_s") + tolerance_s).alias("_b"),
    )
    union = islands.interval_union(wide, keys, "_a", "_b")
    found = lookup.asof(points, union, keys, "at_s", "_a", ["_b"])
    return found.filter(F.col("_b").isNull() | (F.col("at_s") > F.col("_b"))).drop("_b")
