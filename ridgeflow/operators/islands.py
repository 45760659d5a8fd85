"""Runs of equal values, unions of intervals and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.operators import ordered


def number_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    starts: Column,
    name: str = "run",
    *,
    checked: bool = False,
) -> DataFrame:
    """Numbers rows by run: ``starts`` marks the first row of each (null = not)."""
    flag = F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    return ordered.running(df, keys, order, {name: ("sum", flag)}, checked=checked)


def runs_of(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str = "run",
) -> DataFrame:
    """Numbers maximal runs of consecutive rows with the same (null-safe) value."""
    marked = ordered.shift(
        df.withColumn("_v", value),
        keys,
        order,
        {"_pv": F.col("_v"), "_seen": F.lit(True)},
    )
    changed = F.col("_seen").isNull() | ~F.col("_v").eqNullSafe(F.col("_pv"))
    return number_runs(marked, keys, order, changed, name).drop("_v", "_pv", "_seen")


def interval_groups(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    *,
    touching: bool = False,
    name: str = "grp",
) -> DataFrame:
    """Numbers groups of intervals connected by overlap.

    Intervals that only touch stay apart unless ``touching``."""
    df = ordered.assign_chunks(df, keys, start)
    order = [start, end]
    seen = ordered.running(
        df, keys, order, {"_reach": ("max", F.col(end))}, inclusive=False, checked=True
    )
    gap = F.col(start) > F.col("_reach") if touching else F.col(start) >= F.col("_reach")
    new = F.col("_reach").isNull() | gap
    return number_runs(seen, keys, order, new, name, checked=True)


def interval_union(
    df: DataFrame, keys: Sequence[str], start: str, end: str, *, touching: bool = True
) -> DataFrame:
    """The disjoint intervals whose union is that of the given ones."""
    grouped = interval_groups(df, keys, start, end, touching=touching)
    return (
        grouped.groupBy(*keys, "grp")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("grp")
    )


def covered_length(
    df: DataFrame, keys: Sequence[str], start: str, end: str, name: str = "covered"
) -> DataFrame:
    """Length covered by the union of the intervals of each key."""
    df = ordered.assign_chunks(df, keys, start)
    seen = ordered.running(
        df, keys, [start, end], {"_reach": ("max", F.col(end))}, inclusive=False, checked=True
    )
    fresh = F.col(end) - F.greatest(F.col(start), F.coalesce("_reach", start))
    return seen.groupBy(*keys).agg(F.sum(F.greatest(fresh, fresh * 0)).alias(name))
