"""Grade bins, regimes and unit conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin edges in per mille of grade, wide at both ends, 2.5 % in the middle.
BIN_EDGES_PERMILLE: tuple[int, ...] = (
    *range(-1000, -400, 100),
    *range(-400, -150, 50),
    *range(-150, 350, 25),
    350,
    *range(400, 1001, 100),
)
# Grade beyond which a step climbs or descends; share of a pure segment.
REGIME_GRADE = 0.05
PURE_SHARE = 0.80
ASCENT, FLAT, DESCENT, MIXED = "ascent", "flat", "descent", "mixed"


def bin_index(grade: Column) -> Column:
    """Number of the half-open bin ``[lo ; hi[`` of a grade, null outside the domain.

    A tree of comparisons with the edges as they are: six for a grade, so one just under an edge
    stays below it. No join, no list to search, nothing that leaves generated code."""
    edges = [e / 1000 for e in BIN_EDGES_PERMILLE]

    def settled(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last + 1) // 2
        return F.when(grade >= edges[middle], settled(middle, last)).otherwise(settled(first, middle - 1))

    return F.when((grade >= edges[0]) & (grade < edges[-1]), settled(0, len(edges) - 2))


def bin_edges(index: Column) -> tuple[Column, Column]:
    """Lower and upper edges, in per mille, of a bin number."""
    edges = F.array(*(F.lit(e) for e in BIN_EDGES_PERMILLE))
    return F.element_at(edges, (index + 1).cast("int")), F.element_at(
        edges, (index + 2).cast("int")
    )


def bin_center(index: Column) -> Column:
    low, high = bin_edges(index)
    return (low + high) / 2000


def grade_regime(grade: Column) -> Column:
    """Ascent above +5 %, descent below -5 %, flat between (both ends flat)."""
    return (
        F.when(grade > REGIME_GRADE, ASCENT).when(grade < -REGIME_GRADE, DESCENT).otherwise(FLAT)
    )


def regime_class(ascent: Column, flat: Column, descent: Column) -> Column:
    """Regime of the largest fraction when it is pure (first on ties), else mixed."""
    largest = F.greatest(ascent, flat, descent)
    return (
        F.when(largest < PURE_SHARE, MIXED)
        .when(ascent == largest, ASCENT)
        .when(flat == largest, FLAT)
        .otherwise(DESCENT)
    )


def kmh_to_ms(speed: Column) -> Column:
    return speed / 3.6


def ms_to_kmh(speed: Column) -> Column:
    return speed * 3.6


def pace_s_per_km(speed_ms: Column) -> Column:
    return F.when(speed_ms > 0, 1000.0 / speed_ms)


def speed_from_pace(pace: Column) -> Column:
    return F.when(pace > 0, 1000.0 / pace)


def vertical_speed(speed_ms: Column, grade: Column) -> Column:
    return speed_ms * grade


def is_invalid_output(value: Column) -> Column:
    """Model output that is missing, not finite or not positive."""
    infinite = value.isin(float("inf"), float("-inf"))
    return F.coalesce(value.isNull() | F.isnan(value) | infinite | (value <= 0), F.lit(True))


def is_thin(count: Column) -> Column:
    """One or two members: present but too few to stand for a class."""
    return (count >= 1) & (count < 3)


def finite_or_null(value: Column) -> Column:
    return F.when(~is_invalid_output(value), value)
