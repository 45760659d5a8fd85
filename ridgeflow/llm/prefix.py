"""Running sums by key that never bring the rows of a key together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROWS = 100_000


def spread(rows: int, least: int = 256) -> int:
    """Number of sub-buckets of a key, so that each holds a bounded number of rows."""
    return max(least, -(-rows // _ROWS))


def running_before(
    df: DataFrame, keys: list[str], place: str, tie: list[str], value: str, out: str, buckets: int
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same key that come before.

    Rows of a key are ordered by ``place`` (a hash: a long spread over all its range), then
    by ``tie``. A sub-bucket is a range of ``place``; the rows of a key are summed by
    sub-bucket first, and only the rows of one sub-bucket are ever sorted together."""
    sub = (F.shiftrightunsigned(F.col(place), 33) * F.lit(buckets) / F.lit(1 << 31)).cast("int")
    df = df.withColumn("_sub", sub)
    sums = df.groupBy(*keys, "_sub").agg(F.sum(value).alias("_sum"))
    by_key = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col("_sub").alias("_s"),
        F.coalesce(F.sum("_sum").over(by_key), F.lit(0)).alias("_base"),
    )
    on = F.col("_sub") == F.col("_s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = (
        Window.partitionBy(*keys, "_sub")
        .orderBy(F.shiftrightunsigned(F.col(place), 1), place, *tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.join(base, on)
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_sub", "_s", "_base", *(f"_k{i}" for i in range(len(keys))))
    )
