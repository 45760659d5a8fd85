"""Ordered scans inside a key that stay parallel when one key is huge.

A window ``PARTITION BY key ORDER BY t`` puts a whole key in one task. When a key holds
more than ``target_rows`` rows, :func:`assign_chunks` splits its order axis into equal
slices; every scan below then runs per (key, slice) and receives what it needs from
the other slices:

- :func:`running`: the totals of the previous slices (one row per slice);
- :func:`shift`: the edge row of the neighbouring slice;
- :func:`framed`: copies of the rows within the frame of a slice's edges.

Keys below the target keep the plain window plan. The carry tables have one row per
slice of a hot key, hence at most ``rows / target_rows`` times a small factor; their
joins use the (key, slice) partitioning the window already has. A split scan reads its
input twice, so it writes it first: a chain of scans stays linear.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeflow.session import cut_lineage

CHUNK, SLOT = "chunk", "slot"
_LO, _WIDTH, _TOP = "chunk_lo", "chunk_width", "chunk_top"
HELPERS = (CHUNK, _LO, _WIDTH, _TOP)
_FINE_BINS = 256
# Share of a hot key's rows at either end of the axis that has a slice of its own.
_STRAY = 0.0005
DEFAULT_TARGET_ROWS = 4_000_000
BROADCAST_ROWS = 100_000
# Spark states its largest number for rows that do not come from files.
UNKNOWN_BYTES = 2.0**62


def target_rows_of(df: DataFrame) -> int:
    """Rows a single ordered task may hold (``spark.ridgeflow.chunkRows``)."""
    setting = df.sparkSession.conf.get("spark.ridgeflow.chunkRows", None)
    return int(setting) if setting else DEFAULT_TARGET_ROWS


def input_bytes(df: DataFrame) -> float:
    """Bytes of the files and local data a plan reads, without running or optimising it.

    Infinite where it cannot be told. Unlike the estimate of the whole plan, which
    multiplies the sides of every join, this stays close to the data."""
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
        return float(sum(int(str(s)) for s in sizes))
    except AttributeError:  # a Connect session has no JVM handle
        return float("inf")


def pieces_of(df: DataFrame, piece_bytes: int = 8_000_000) -> int:
    """Number of partitions for a shuffle of a table: its size in files over that of a piece,
    the session's number at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return least if size >= UNKNOWN_BYTES else max(least, ceil(size / piece_bytes))


def dealt(df: DataFrame, keys: Sequence[str], piece_bytes: int = 8_000_000) -> DataFrame:
    """Rows dealt by keys over as many partitions as the size of the table asks for, so that a
    task holds as much of a large table as of a small one; small tables stay as they are.

    For keys of few rows each: what is then grouped by them is summed where it lies, and a
    table of partial sums as long as the rows is never held. Large keys need partial sums."""
    if input_bytes(df) < 2 * piece_bytes:
        return df
    return df.repartition(pieces_of(df, piece_bytes), *keys)


@dataclass(frozen=True)
class Deal:
    """How rows lie: over ``pieces`` partitions by ``by``; the keys of ``hot`` over several slots."""

    pieces: int
    by: tuple[str, ...]
    hot: DataFrame | None = None

    def spread(self, df: DataFrame) -> DataFrame:
        """A table of few rows a key, dealt like the rows; those of a hot key stand in each of its slots."""
        if self.hot is not None:
            slots = F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)
            df = df.join(self.hot, list(self.by[:-1]), "left").withColumn(SLOT, F.explode(slots)).drop("_slots")
        return df.repartition(self.pieces, *self.by)


def deal(df: DataFrame, keys: Sequence[str], member: str) -> tuple[DataFrame, Deal]:
    """Rows dealt by keys over as many partitions as the size of the table asks for, and how.

    A key above the target rows is dealt over slots by a hash of ``member``, so that no task
    holds all of it: what is summed by key where it lies is then summed again over the slots."""
    pieces, target = pieces_of(df), target_rows_of(df)
    hot_count = 0
    if input_bytes(df) >= target * 16:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target)
        hot = cut_lineage(sizes.select(*keys, F.ceil(F.col("_n") / F.lit(target)).cast("int").alias("_slots")))
        hot_count = hot.count()
    if hot_count == 0:
        return df.repartition(pieces, *keys), Deal(pieces, tuple(keys))
    hot = broadcast_if_small(hot, hot_count)
    slot = F.coalesce(F.pmod(F.xxhash64(member), F.col("_slots")).cast("int"), F.lit(0))
    rows = df.join(hot, list(keys), "left").withColumn(SLOT, slot).drop("_slots")
    by = (*keys, SLOT)
    return rows.repartition(pieces, *by), Deal(pieces, by, hot)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a known row count; a plain shuffle join beyond it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def is_chunked(df: DataFrame) -> bool:
    return CHUNK in df.columns


def without_chunks(df: DataFrame) -> DataFrame:
    return df.drop(*HELPERS)


def assign_chunks(
    df: DataFrame, keys: Sequence[str], order: str, target_rows: int | None = None
) -> DataFrame:
    """Adds slice columns when some key is larger than the target, else ``df`` itself.

    The slices are equal pieces of the numeric ``order`` axis between two ranks near its
    ends, narrow enough that the densest of 256 sub-ranges of a key stays under the target;
    what lies outside, such as a record at time zero, has a slice before and after. The
    bounds are collected here once, so a recomputed task finds the same slices. Rows at one
    instant always share a slice."""
    if is_chunked(df):
        return df
    target = target_rows or target_rows_of(df)
    # Inputs too small to hold a hot key need no statistics job.
    if input_bytes(df) < target * 16:
        return df
    slim = df.select(*keys, _axis(df, order).alias("_t"))
    stats = slim.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_t").alias(_LO), F.max("_t").alias("_hi")
    )
    hot = stats.filter((F.col("_n") > target) & (F.col("_hi") > F.col(_LO)))
    hot_count = hot.count()
    if hot_count == 0:
        return df
    hot = broadcast_if_small(hot, hot_count)
    matched = slim.join(hot, list(keys)) if keys else slim.crossJoin(hot)
    ranks = F.percentile_approx("_t", [_STRAY, 1 - _STRAY], 10_000)
    ends = matched.groupBy(*keys, _LO, "_hi").agg(ranks.alias("_r"))
    inner = F.col("_r")[1] > F.col("_r")[0]
    ends = ends.select(
        *keys,
        F.when(inner, F.col("_r")[0]).otherwise(F.col(_LO)).alias(_LO),
        F.when(inner, F.col("_r")[1]).otherwise(F.col("_hi")).alias("_hi"),
    )
    ends = broadcast_if_small(cut_lineage(ends), hot_count)
    span = F.col("_hi") - F.col(_LO)
    fine = F.floor((F.col("_t") - F.col(_LO)) / span * _FINE_BINS)
    matched = slim.join(ends, list(keys)) if keys else slim.crossJoin(ends)
    densest = (
        matched.filter(F.col("_t").between(F.col(_LO), F.col("_hi")))
        .groupBy(*keys, _LO, "_hi", F.least(fine, F.lit(_FINE_BINS - 1)).alias("_fine"))
        .agg(F.count(F.lit(1)).alias("_m"))
        .groupBy(*keys, _LO, "_hi")
        .agg(F.max("_m").alias("_m"))
    )
    pieces = F.ceil(F.col("_m") * _FINE_BINS / F.lit(target))
    widths = densest.select(*keys, _LO, (span / pieces).alias(_WIDTH), pieces.cast("long").alias(_TOP))
    widths = broadcast_if_small(cut_lineage(widths), hot_count)
    tagged = df.join(widths, list(keys), "left") if keys else df.crossJoin(widths)
    return tagged.withColumn(CHUNK, chunk_of(_axis(df, order)))


def _axis(df: DataFrame, order: str) -> Column:
    """The order column as a number."""
    kind = dict(df.dtypes)[order]
    if kind == "date":
        return F.unix_date(order).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    return F.col(order).cast("double")


def chunk_of(at: Column) -> Column:
    """Slice number of a position, 0 for keys that are not split."""
    piece = F.floor((at.cast("double") - F.col(_LO)) / F.col(_WIDTH))
    inside = F.greatest(F.lit(-1), F.least(piece, F.col(_TOP)))
    return F.when(F.col(_WIDTH).isNotNull(), inside).otherwise(F.lit(0)).cast("long")


def _orders(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _sliced(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], checked: bool = False
) -> DataFrame:
    first = order[0]
    return assign_chunks(df, keys, first) if isinstance(first, str) and not checked else df


def scan_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    reverse: bool = False,
):
    parts = [*keys, CHUNK] if is_chunked(df) else list(keys)
    columns = _orders(order)
    return Window.partitionBy(*parts).orderBy(
        *([c.desc() for c in columns] if reverse else columns)
    )


_REDUCE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "count": F.count,
}


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(
            carry + local
        )
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    outputs: Mapping[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    reverse: bool = False,
    checked: bool = False,
) -> DataFrame:
    """Running ``sum``/``count``/``max``/``min``/``last`` (non-null) columns per key.

    ``inclusive=False`` stops at the previous row; ``reverse`` scans from the end. An
    input not yet sliced is checked for keys above the target first, unless the caller
    has just done so (``checked``)."""
    df = _sliced(df, keys, order, checked)
    end = 0 if inclusive else -1
    window = scan_window(df, keys, order, reverse)
    frame = window.rowsBetween(Window.unboundedPreceding, end)

    def local(kind: str, expr: Column) -> Column:
        if kind == "last":
            return F.last(expr, ignorenulls=True).over(frame)
        return _REDUCE[kind](expr).over(frame)

    if not is_chunked(df):
        return df.select("*", *(local(k, e).alias(n) for n, (k, e) in outputs.items()))
    df = cut_lineage(df)
    position = F.struct(*_orders(order))

    def total(kind: str, expr: Column) -> Column:
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            return pick(expr, F.when(expr.isNotNull(), position))
        return _REDUCE[kind](expr)

    totals = (
        df.filter(F.col(_WIDTH).isNotNull())
        .groupBy(*keys, CHUNK)
        .agg(*(total(k, e).alias(f"_c_{n}") for n, (k, e) in outputs.items()))
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.desc(CHUNK) if reverse else F.asc(CHUNK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def carried(kind: str, name: str) -> Column:
        column = F.col(f"_c_{name}")
        if kind == "last":
            return F.last(column, ignorenulls=True).over(before)
        return _REDUCE["sum" if kind == "count" else kind](column).over(before)

    carry = totals.select(
        *keys, CHUNK, *(carried(k, n).alias(f"_p_{n}") for n, (k, _) in outputs.items())
    )
    scanned = df.select(
        "*", *(local(k, e).alias(f"_l_{n}") for n, (k, e) in outputs.items())
    )
    merged = scanned.join(carry, [*keys, CHUNK], "left")
    return merged.select(
        *(F.col(c) for c in df.columns),
        *(
            _merge(k, F.col(f"_p_{n}"), F.col(f"_l_{n}")).alias(n)
            for n, (k, _) in outputs.items()
        ),
    )


def shift(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    outputs: Mapping[str, Column],
    *,
    forward: bool = False,
    checked: bool = False,
) -> DataFrame:
    """Values of the previous row (``forward``: next row) of the key; ``checked`` as in
    :func:`running`."""
    df = _sliced(df, keys, order, checked)
    window = scan_window(df, keys, order)
    move = F.lead if forward else F.lag
    if not is_chunked(df):
        return df.select("*", *(move(e).over(window).alias(n) for n, e in outputs.items()))
    df = cut_lineage(df)
    position = F.struct(*_orders(order))
    packed = F.struct(*(e.alias(n) for n, e in outputs.items()))
    pick = F.min_by if forward else F.max_by
    edges = (
        df.filter(F.col(_WIDTH).isNotNull())
        .groupBy(*keys, CHUNK)
        .agg(pick(packed, position).alias("__edge"))
    )
    neighbour = Window.partitionBy(*keys).orderBy(CHUNK)
    edges = edges.select(*keys, CHUNK, move("__edge").over(neighbour).alias("__edge"))
    scanned = df.select("*", move(packed).over(window).alias("__near"))
    merged = scanned.join(edges, [*keys, CHUNK], "left")
    near = F.when(F.col("__near").isNull(), F.col("__edge")).otherwise(F.col("__near"))
    return merged.withColumn("__near", near).select(
        *(F.col(c) for c in df.columns),
        *(F.col(f"__near.{n}").alias(n) for n in outputs),
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    before: int,
    after: int,
    outputs: Mapping[str, Callable[[Window], Column]],
) -> DataFrame:
    """Columns over the rows within ``[t + before ; t + after]`` of a numeric order.

    Each output is a function of the window. In a split key a row is copied to every
    slice whose frames reach it, and only the owning slice reports it."""
    df = _sliced(df, keys, [order])
    if not is_chunked(df):
        window = Window.partitionBy(*keys).orderBy(order).rangeBetween(before, after)
        return df.select("*", *(make(window).alias(n) for n, make in outputs.items()))
    at = F.col(order)
    spread = df.withColumn("_own", F.col(CHUNK)).withColumn(
        CHUNK, F.explode(F.sequence(chunk_of(at - after), chunk_of(at - before)))
    )
    window = (
        Window.partitionBy(*keys, CHUNK).orderBy(order).rangeBetween(before, after)
    )
    computed = spread.select("*", *(make(window).alias(n) for n, make in outputs.items()))
    return computed.filter(F.col("_own") == F.col(CHUNK)).drop("_own")
