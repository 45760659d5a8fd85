"""Slope of a residual on position net of nuisance fractions, with leave-one-out.

Everything is read from centred cross-products of each group, so a row's withdrawal is
a subtraction of its own moments and no fit is repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relative rank tolerance, smallest identifiable share of position.
RANK_TOLERANCE = 1e-10
IDENTIFIABLE = 1e-10


def _pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def _net(sums: dict[str, Column], n: Column, u: str, y: str, others: Sequence[str]) -> dict[str, Column]:
    """Net slope from moment columns (``s_a``, ``q_a_b``) by successive projections."""
    order = [*others, u, y]

    def centred(a: str, b: str) -> Column:
        first, second = (a, b) if order.index(a) <= order.index(b) else (b, a)
        return sums[f"q_{first}_{second}"] - sums[f"s_{a}"] * sums[f"s_{b}"] / n

    cov = {(a, b): centred(a, b) for a, b in _pairs(order)}
    rank = F.lit(1)
    spread = cov[(u, u)]
    for k, z in enumerate(others):
        scale = centred(z, z)
        usable = cov[(z, z)] > RANK_TOLERANCE * F.greatest(scale, F.lit(1e-300))
        rank = rank + F.when(usable, 1).otherwise(0)
        rest = order[k + 1 :]
        new = dict(cov)
        for a, b in _pairs(rest):
            step = cov[(z, a)] * cov[(z, b)] / F.when(usable, cov[(z, z)])
            new[(a, b)] = cov[(a, b)] - F.coalesce(step, F.lit(0.0))
        cov = new
    kept = cov[(u, u)]
    share = F.when(spread > 0, kept / F.when(spread > 0, spread))
    known = (share > IDENTIFIABLE) & (rank < n)
    return {
        "slope": F.when(known, cov[(u, y)] / F.when(known, kept)),
        "rho_u": share,
        "rank": rank,
    }


def _moment_sums(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(c).alias(f"s_{c}") for c in names),
        *(F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in _pairs(names)),
    )


def net_slope(
    df: DataFrame, keys: Sequence[str], y: str, u: str, others: Sequence[str] = ()
) -> DataFrame:
    """``slope``, ``rho_u`` (share of position not explained by the nuisance), ``rank``
    and ``n`` per key; the slope is null where it is not identifiable."""
    names = [*others, u, y]
    sums = _moment_sums(df, keys, names)
    columns = {c: F.col(c) for c in sums.columns}
    out = _net(columns, F.col("n"), u, y, others)
    return sums.select(*keys, "n", *(c.alias(k) for k, c in out.items()))


def withdrawals(
    df: DataFrame, keys: Sequence[str], y: str, u: str, others: Sequence[str] = ()
) -> DataFrame:
    """Each row with the slope fitted without it (``slope_without``)."""
    names = [*others, u, y]
    sums = _moment_sums(df, keys, names)
    joined = df.join(sums, list(keys))
    columns = {f"s_{c}": F.col(f"s_{c}") - F.col(c) for c in names}
    columns |= {
        f"q_{a}_{b}": F.col(f"q_{a}_{b}") - F.col(a) * F.col(b) for a, b in _pairs(names)
    }
    out = _net(columns, F.col("n") - 1, u, y, others)
    slope = F.when(F.col("n") >= 2, out["slope"])
    return joined.select(*df.columns, slope.alias("slope_without"))


def slope_range(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min("slope_without").alias("slope_low"), F.max("slope_without").alias("slope_high")
    )


def drift_rows(
    targets: DataFrame, keys: Sequence[str], *, order: str = "k"
) -> tuple[DataFrame, DataFrame]:
    """(rows, statuses) of the drift of each key.

    ``targets``: keys, ``k``, position ``s_m``, ``t`` (null = not observed), ``p``,
    ``p0`` and per-interval regime seconds ``ascent_s``, ``flat_s``, ``descent_s``. The
    sequence stops at the first target not observed. Intervals are differences from the
    previous target (the origin is zero)."""
    from ridgeflow.operators import ordered

    cut = ordered.running(
        targets, keys, [order], {"_hole": ("max", F.when(F.col("t").isNull(), 1).otherwise(0))}
    ).filter(F.col("_hole") == 0)
    prior = {f"_{c}": F.col(c) for c in ("t", "p", "p0", "s_m")}
    back = ordered.shift(cut, keys, [order], prior)
    for c in prior:
        back = back.withColumn(c, F.coalesce(c, F.lit(0.0)))
    rows = (
        back.withColumn("t_h", F.col("t") - F.col("_t"))
        .withColumn("p_h", F.col("p") - F.col("_p"))
        .withColumn("v_h", F.col("p0") - F.col("_p0"))
        .withColumn("length_m", F.col("s_m") - F.col("_s_m"))
    )
    regimes = ("ascent_s", "flat_s", "descent_s")
    total = F.col("ascent_s") + F.col("flat_s") + F.col("descent_s")
    ends = rows.groupBy(*keys).agg(
        F.max_by("p0", order).alias("_horizon"),
        F.max_by("t", order).alias("_t_end"),
        F.max_by("p", order).alias("_p_end"),
        *(F.sum(r).alias(f"_all_{r}") for r in regimes),
        F.min("length_m").alias("_shortest"),
        F.min(F.least("p_h", "v_h")).alias("_least"),
        F.min("t_h").alias("_t_least"),
        F.max(F.col("p").isNull() | F.col("p0").isNull()).alias("_absent"),
    )
    main = F.greatest(*(F.col(f"_all_{r}") for r in regimes))
    reference = (
        F.when(F.col("_all_ascent_s") == main, "ascent")
        .when(F.col("_all_flat_s") == main, "flat")
        .otherwise("descent")
    )
    status = F.coalesce(
        F.when(~(F.col("_shortest") > 0), "insufficient_support"),
        F.when(F.col("_absent") | ~(F.col("_least") > 0), "model_error"),
        F.when(~(F.col("_t_least") > 0), "zero_time"),
    )
    ends = ends.withColumn("reference", reference).withColumn("status", status)
    joined = rows.join(ends, list(keys))
    share = {r: F.col(r) / F.nullif(total, F.lit(0.0)) for r in regimes}
    first = F.when(F.col("reference") == "ascent", share["flat_s"]).otherwise(share["ascent_s"])
    second = F.when(F.col("reference") == "descent", share["flat_s"]).otherwise(
        share["descent_s"]
    )
    out = joined.select(
        *keys,
        order,
        "s_m",
        "status",
        "reference",
        (F.col("p") - F.col("t")).alias("gap_s"),
        (F.col("t") - F.col("_t_end") * (F.col("p") / F.col("_p_end"))).alias("recentred_s"),
        F.when((F.col("t_h") > 0) & (F.col("p_h") > 0), F.log(F.col("t_h") / F.col("p_h"))).alias(
            "y"
        ),
        ((F.col("_p0") + F.col("v_h") / 2) / F.col("_horizon")).alias("u"),
        first.alias("f1"),
        second.alias("f2"),
    )
    return out, ends.select(*keys, "reference", "status")


def outing_drift(targets: DataFrame, keys: Sequence[str], *, order: str = "k") -> DataFrame:
    """Drift slope, identifiability and leave-one-out range of every usable key."""
    rows, statuses = drift_rows(targets, keys, order=order)
    usable = rows.filter(F.col("status").isNull())
    fit = net_slope(usable, keys, "y", "u", ["f1", "f2"])
    spread = slope_range(withdrawals(usable, keys, "y", "u", ["f1", "f2"]), keys)
    return statuses.join(fit, list(keys), "left").join(spread, list(keys), "left")
