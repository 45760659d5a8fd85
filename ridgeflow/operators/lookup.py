"""As-of look-ups and interval overlap joins, written as plain DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.operators import ordered


def asof(
    probes: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    probe_at: str,
    point_at: str,
    take: Sequence[str],
    *,
    strict: bool = False,
    tie: Sequence[str] = (),
    forward: bool = False,
    target_rows: int | None = None,
) -> DataFrame:
    """Each probe with the last point at or before it (``strict``: before it).

    ``forward`` looks for the first point at or after (after). The two sides are
    stacked and scanned once in time order: one shuffle, no pair is ever built. Among
    points of one instant the last in ``tie`` order wins."""
    probes = ordered.without_chunks(probes)
    sign = -1 if forward else 1
    probe_side = 0 if strict else 1
    point_side = 1 - probe_side
    ties = [f"_tie{i}" for i in range(len(tie))]
    payload = F.struct(*take)
    left = probes.select(
        *keys,
        (F.col(probe_at).cast("double") * sign).alias("_at"),
        F.lit(probe_side).alias("_side"),
        F.struct(*(F.col(c) for c in probes.columns if c not in keys)).alias("_probe"),
    )
    right = points.filter(F.col(point_at).isNotNull()).select(
        *keys,
        (F.col(point_at).cast("double") * sign).alias("_at"),
        F.lit(point_side).alias("_side"),
        payload.alias("_point"),
        *(F.col(c).alias(t) for c, t in zip(tie, ties, strict=True)),
    )
    stacked = left.unionByName(right, allowMissingColumns=True)
    stacked = ordered.assign_chunks(stacked, keys, "_at", target_rows)
    found = ordered.running(
        stacked, keys, ["_at", "_side", *ties], {"_hit": ("last", F.col("_point"))}, checked=True
    )
    return found.filter(F.col("_side") == probe_side).filter(
        F.col("_probe").isNotNull()
    ).select(
        *keys,
        *(F.col(f"_probe.{c}").alias(c) for c in probes.columns if c not in keys),
        *(F.col(f"_hit.{c}").alias(c) for c in take),
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    cell: float | Column,
    *,
    closed: bool = False,
) -> DataFrame:
    """Pairs of intervals of a key that overlap, through an equi-join on cells.

    Both sides are listed in every cell of width ``cell`` they touch; a pair is kept
    only in the cell of its later start, so it appears once. ``closed`` keeps pairs that
    merely touch. Column names of the two sides must differ outside the keys."""
    width = F.lit(cell).cast("double") if not isinstance(cell, Column) else cell
    (a0, a1), (b0, b1) = left_span, right_span

    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        cells = F.sequence(
            F.floor(F.col(start).cast("double") / width).cast("long"),
            F.floor(F.col(end).cast("double") / width).cast("long"),
        )
        return df.filter(F.col(end) >= F.col(start)).withColumn(
            "_cell", F.explode(cells)
        )

    later = F.greatest(F.col(a0).cast("double"), F.col(b0).cast("double"))
    touch = F.col(a0) <= F.col(b1) if closed else F.col(a0) < F.col(b1)
    touch &= F.col(b0) <= F.col(a1) if closed else F.col(b0) < F.col(a1)
    joined = spread(left, a0, a1).join(spread(right, b0, b1), [*keys, "_cell"])
    return joined.filter(touch & (F.floor(later / width).cast("long") == F.col("_cell"))).drop(
        "_cell"
    )


def interpolated_at(
    probes: DataFrame,
    records: DataFrame,
    keys: Sequence[str],
    probe_at: str,
    axis: str,
    order: Sequence[str],
    values: Sequence[str],
    *,
    suffix: str = "_at",
) -> DataFrame:
    """Record values read linearly at an abscissa of a non-decreasing axis.

    The step used starts at the last record at or before the abscissa, so that a
    repeated abscissa (a stop) gives its last record; before the first record or past
    the last one the end value is kept."""
    following = {f"_n_{c}": F.col(c) for c in [axis, *values]}
    steps = ordered.shift(records, keys, order, following, forward=True)
    found = asof(
        probes,
        steps,
        keys,
        probe_at,
        axis,
        [axis, *values, *following],
        tie=[o for o in order if o != axis],
    )
    span = F.col(f"_n_{axis}") - F.col(axis)
    ratio = F.when(span > 0, (F.col(probe_at) - F.col(axis)) / span).otherwise(F.lit(0.0))
    out = found.withColumn("_r", F.coalesce(ratio, F.lit(0.0)))
    return out.select(
        *ordered.without_chunks(probes).columns,
        *(
            (
                F.col(c)
                + F.col("_r") * (F.coalesce(F.col(f"_n_{c}"), F.col(c)) - F.col(c))
            ).alias(c + suffix)
            for c in values
        ),
    )
