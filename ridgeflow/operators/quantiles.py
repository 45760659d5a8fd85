"""Exact rank quantiles of groups of any size.

Values are first counted per (group, value), which combines on the map side, and ranks
are then read off a running count that is itself split when a group is large."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.operators import ordered
from ridgeflow.session import cut_lineage

# Bins of one pass of a selection, and values that it may bring to the driver at its end.
SELECT_BINS = 4096
SELECT_ROWS = 50_000
# Bytes of input files from which counted values are written before they are read.
WRITTEN_BYTES = 16_000_000


def rank_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    *,
    count: str = "n",
    target_rows: int | None = None,
) -> DataFrame:
    """One row per group: its size and the values at the requested 1-based ranks.

    Each rank is a function of the group size column. Nulls are ignored."""
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_m"))
    )
    # The counts are read several times; those of a large input are made once.
    if ordered.input_bytes(df) >= WRITTEN_BYTES:
        counted = cut_lineage(counted)
    counted = ordered.assign_chunks(counted, keys, value, target_rows)
    climbed = ordered.running(counted, keys, [value], {"_top": ("sum", F.col("_m"))}, checked=True)
    sizes = counted.groupBy(*keys).agg(F.sum("_m").alias(count))
    joined = climbed.join(sizes, list(keys)) if keys else climbed.crossJoin(sizes)
    below = F.col("_top") - F.col("_m")

    def at(rank: Callable[[Column], Column]) -> Column:
        wanted = rank(F.col(count))
        return F.max(F.when((wanted > below) & (wanted <= F.col("_top")), F.col(value)))

    aggs = [F.max(count).alias(count), *(at(r).alias(n) for n, r in ranks.items())]
    return joined.groupBy(*keys).agg(*aggs)


def ratio_rank(numerator: int, denominator: int) -> Callable[[Column], Column]:
    """Rank ``ceil(n * a / b)`` computed on integers."""
    return lambda n: F.floor((n * numerator + denominator - 1) / F.lit(denominator))


def order_rank(q: float) -> Callable[[Column], Column]:
    """Order-statistic rank ``ceil(q n - 1e-9)`` kept within ``1..n``."""
    return lambda n: F.greatest(F.lit(1), F.least(n, F.ceil(n * q - 1e-9)))


_MIDDLE: Mapping[str, Callable[[Column], Column]] = {
    "_low": lambda n: F.floor((n + 1) / 2),
    "_high": lambda n: F.floor(n / 2) + 1,
}


def rank_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, tuple[int, int]],
    *,
    median: str | None = None,
) -> DataFrame:
    """Lower rank quantiles ``ceil(n a / b)`` by group, and the ``median`` of the same count."""
    ranks = {name: ratio_rank(a, b) for name, (a, b) in fractions.items()}
    if median is None:
        return rank_values(df, keys, value, ranks)
    out = rank_values(df, keys, value, {**ranks, **_MIDDLE})
    return out.withColumn(median, (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median"
) -> DataFrame:
    """Median with the midpoint of the two central values for an even size."""
    out = rank_values(df, keys, value, _MIDDLE)
    return out.withColumn(name, (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")


def select_median(values: DataFrame, value: str, near: float | None = None) -> float:
    """Exact median of all rows by counting passes: nothing is shuffled but counts of bins.

    A pass counts bins with their smallest and largest value; the bin of the wanted rank is
    the next range, until it holds few different values. ``near`` places the bins of the
    first pass between half and three halves of a guess; what lies outside has a bin before and after."""
    v = F.col(value)
    known = values.select(value).filter(v.isNotNull())
    if near:
        lo, hi, size, held = 0.5 * near, 1.5 * near, None, None
    else:
        lo, hi, size = known.agg(F.min(v), F.max(v), F.count(F.lit(1))).first()
        held = size
        if not size:
            raise ValueError("no value to take a median of")
    before, inside = 0, known
    while held is None or (held > SELECT_ROWS and lo < hi):
        width = (hi - lo) / SELECT_BINS
        place = F.floor((v - lo) / width) if width > 0 else F.when(v > lo, SELECT_BINS).otherwise(0)
        place = F.when(v < lo, -1).when(v >= hi, SELECT_BINS).otherwise(F.least(place, F.lit(SELECT_BINS)))
        bins = (
            inside.groupBy(place.cast("int").alias("_b"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
            .orderBy("_b")
            .collect()
        )
        if size is None:
            size = sum(b["_n"] for b in bins)
            if not size:
                raise ValueError("no value to take a median of")
        wanted = (size + 1) // 2
        for b in bins:
            if before + b["_n"] >= wanted:
                break
            before += b["_n"]
        if held == b["_n"]:  # no bin parts the values: they lie a rounding step apart
            lo, hi = b["_lo"], b["_hi"]
            break
        held, lo, hi = b["_n"], b["_lo"], b["_hi"]
        inside = known.filter(v.between(lo, hi))
    first, second = (size + 1) // 2, size // 2 + 1
    counted = [(lo, held)]
    if lo < hi:
        counted = [tuple(r) for r in inside.groupBy(v).agg(F.count(F.lit(1))).orderBy(value).collect()]
    found = {}
    for at, n in counted:
        for rank in (first, second):
            if before < rank <= before + n:
                found[rank] = at
        before += n
    if second not in found:
        found[second] = known.filter(v > hi).agg(F.min(v)).first()[0]
    return (found[first] + found[second]) / 2
