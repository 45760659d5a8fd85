"""Linear trends over large tables: moments summed once, small systems solved after.

Every estimator reduces the rows to cross-products by group (map-side combined); only
p x p systems, p at most a few dozen columns, reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeflow.functions.student import quantile, two_sided_p
from ridgeflow.operators import ordered, quantiles
from ridgeflow.session import cut_lineage


def moments(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    weight: Column | None = None,
) -> DataFrame:
    """Cross-product sums ``m_i_j`` (i <= j) of columns, and the row count ``n``."""
    w = F.lit(1.0) if weight is None else weight
    sums = [
        F.sum(w * F.col(a) * F.col(b)).alias(f"m_{i}_{j}")
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i <= j
    ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def _square(row: Mapping[str, float], size: int) -> np.ndarray:
    out = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = row[f"m_{i}_{j}"]
    return out


@dataclass(frozen=True)
class LinearFit:
    """OLS result: coefficients in column order, covariance, df and residual variance."""

    columns: tuple[str, ...]
    coef: np.ndarray
    cov: np.ndarray
    df: int
    scale: float

    def interval(self, j: int, level: float) -> tuple[float, float]:
        """Student interval of one coefficient."""
        half = quantile(1 - (1 - level) / 2, self.df) * math.sqrt(self.cov[j, j])
        return float(self.coef[j] - half), float(self.coef[j] + half)

    def p_value(self, j: int) -> float:
        return two_sided_p(float(self.coef[j]) / math.sqrt(self.cov[j, j]), self.df)

    def prediction(self) -> Column:
        """Fitted value as a column expression over the design columns."""
        terms = [F.col(c) * float(b) for c, b in zip(self.columns, self.coef, strict=True)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total


def with_constant(df: DataFrame, name: str = "one") -> DataFrame:
    return df.withColumn(name, F.lit(1.0))


def ols(
    df: DataFrame, columns: Sequence[str], y: str, weight: Column | None = None
) -> LinearFit:
    """Ordinary (or weighted) least squares from one pass of cross-products."""
    p = len(columns)
    row = moments(df, [], [*columns, y], weight).collect()[0].asDict()
    square = _square(row, p + 1)
    xx, xy, yy = square[:p, :p], square[:p, p], square[p, p]
    inverse = np.linalg.inv(xx)
    coef = inverse @ xy
    rest = max(float(yy - 2 * coef @ xy + coef @ xx @ coef), 0.0)
    df_left = int(row["n"]) - p
    scale = rest / df_left
    return LinearFit(tuple(columns), coef, scale * inverse, df_left, scale)


def slope_by_group(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Simple regression of each group: ``slope``, ``intercept``, ``n``."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )


@dataclass(frozen=True)
class WithinFit:
    """Fixed-effect fit: pooled slopes and the level of each group net of them."""

    slopes: Mapping[str, float]
    scale: float
    df: int
    groups: DataFrame


def within_groups(
    df: DataFrame, group: str, columns: Sequence[str], y: str
) -> WithinFit:
    """Regression with one level per group, without centring the rows.

    Within-group cross-products are total minus between cross-products, both sums of
    group moments, so a group of any size is only ever summed."""
    names = [*columns, y]
    p = len(columns)
    sums = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)),
        *(
            F.sum(F.col(a) * F.col(b)).alias(f"q_{i}_{j}")
            for i, a in enumerate(names)
            for j, b in enumerate(names)
            if i <= j
        ),
    )
    pieces = [
        F.sum(
            F.col(f"q_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n")
        ).alias(f"m_{i}_{j}")
        for i in range(p + 1)
        for j in range(i, p + 1)
    ]
    row = sums.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), *pieces
    ).collect()[0].asDict()
    square = _square(row, p + 1)
    coef = np.linalg.solve(square[:p, :p], square[:p, p])
    rest = float(square[p, p] - coef @ square[:p, p])
    df_left = int(row["rows"]) - int(row["groups"]) - p
    slopes = {c: float(b) for c, b in zip(columns, coef, strict=True)}
    level = F.col(f"s_{p}") / F.col("n")
    for i, c in enumerate(columns):
        level = level - F.col(f"s_{i}") / F.col("n") * slopes[c]
    scale = rest / df_left if df_left > 0 else float("nan")
    levels = sums.select(
        group, "n", level.alias("level"), (F.lit(scale) / F.col("n")).alias("level_var")
    )
    return WithinFit(slopes, scale, df_left, levels)


def huber(
    df: DataFrame,
    columns: Sequence[str],
    y: str,
    *,
    c: float = 1.345,
    max_iter: int = 100,
    tolerance: float = 1e-10,
) -> tuple[LinearFit, float, int]:
    """Huber regression by reweighted least squares: (fit, scale, iterations).

    The scale is the exact median absolute residual over the normal quartile, found
    again at each step by counting passes around the last one. The columns are written
    once, as every step reads them."""
    quartile = 0.6744897501960817
    df = cut_lineage(df.select(*dict.fromkeys([*columns, y])))
    fit = ols(df, columns, y)

    def scale_of(current: LinearFit, near: float | None = None) -> float:
        residual = df.select(F.abs(F.col(y) - current.prediction()).alias("_r"))
        return float(quantiles.select_median(residual, "_r", near)) / quartile

    scale = scale_of(fit)
    for iteration in range(1, max_iter + 1):
        if scale == 0.0:
            raise ValueError("more than half of the residuals are zero")
        size = F.abs(F.col(y) - fit.prediction()) / scale
        weight = F.when(size > c, c / size).otherwise(1.0)
        following = ols(df, columns, y, weight)
        step = float(np.max(np.abs(following.coef - fit.coef)))
        fit = following
        scale = scale_of(fit, scale * quartile)
        if step <= tolerance * max(1.0, float(np.max(np.abs(fit.coef)))):
            return fit, scale, iteration
    raise ValueError(f"no convergence in {max_iter} iterations")


def cluster_moments(
    df: DataFrame, columns: Sequence[str], residual: str, cluster: str
) -> DataFrame:
    """Per cluster: design cross-products ``s_i_j`` and scores ``b_i``."""
    p = len(columns)
    return df.groupBy(cluster).agg(
        *(
            F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s_{i}_{j}")
            for i in range(p)
            for j in range(i, p)
        ),
        *(F.sum(F.col(c) * F.col(residual)).alias(f"b_{i}") for i, c in enumerate(columns)),
    )


def _adjusted(frame: pd.DataFrame, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Batched (S_g, b_g, F_g) with F_g = (I - S_g M)^(-1/2), M = root root'.

    Pushing the n_g x n_g adjustment through X_g' leaves p x p matrices only."""
    p = root.shape[0]
    s = np.empty((len(frame), p, p))
    for i in range(p):
        for j in range(i, p):
            s[:, i, j] = s[:, j, i] = frame[f"s_{i}_{j}"].to_numpy()
    b = frame[[f"b_{i}" for i in range(p)]].to_numpy()
    inner = root.T @ s @ root
    values, vectors = np.linalg.eigh(inner)
    if np.any(1.0 - values <= 1e-12):
        raise ValueError("a cluster has full leverage")
    core = (vectors / np.sqrt(1.0 - values)[:, None, :]) @ vectors.transpose(0, 2, 1)
    back = np.linalg.inv(root.T)
    return s, b, back @ core @ root.T


def cr2_cov(df: DataFrame, fit: LinearFit, y: str, cluster: str) -> np.ndarray:
    """Cluster-robust covariance with the bias-reducing adjustment by cluster."""
    columns = list(fit.columns)
    p = len(columns)
    root, bread = _bread(fit)
    table = cluster_moments(
        df.withColumn("_res", F.col(y) - fit.prediction()), columns, "_res", cluster
    )

    def meat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, b, f = _adjusted(batch, root)
            score = np.einsum("gij,gj->gi", f, b)
            outer = score.T @ score
            yield pd.DataFrame(
                [{f"m_{i}_{j}": outer[i, j] for i in range(p) for j in range(i, p)}]
            )

    names = [f"m_{i}_{j}" for i in range(p) for j in range(i, p)]
    parts = table.mapInPandas(meat, ", ".join(f"{n} double" for n in names))
    row = parts.agg(*(F.sum(n).alias(n) for n in names)).collect()[0].asDict()
    return bread @ _square(row, p) @ bread


def _bread(fit: LinearFit) -> tuple[np.ndarray, np.ndarray]:
    bread = fit.cov / fit.scale
    return np.linalg.cholesky(bread), bread


def cr2_slope(df: DataFrame, x: str, residual: str, cluster: str) -> DataFrame:
    """The same for a single centred regressor, wholly in columns: one row with the
    variance of the slope (``cr2_var``)."""
    per_cluster = df.groupBy(cluster).agg(
        F.sum(F.col(x) * F.col(x)).alias("_s"), F.sum(F.col(x) * F.col(residual)).alias("_b")
    )
    total = per_cluster.agg(F.sum("_s").alias("_all"))
    joined = per_cluster.crossJoin(F.broadcast(total))  # one row
    score = F.col("_b") / F.sqrt(1 - F.col("_s") / F.col("_all"))
    return joined.agg(
        (F.sum(score * score) / F.pow(F.max("_all"), 2)).alias("cr2_var"),
        F.count(F.lit(1)).alias("clusters"),
    )


# The six weights of the small-sample wild bootstrap.
WEBB = (
    -math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5)
)
MIN_CLUSTERS, WEBB_BELOW = 10, 12


def _mixed(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """64-bit mix of (cluster key, draw): the same weights on any partitioning."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + draws.astype(np.uint64)[None, :] * np.uint64(
            0x9E3779B97F4A7C15
        )
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def wild_weights(keys: np.ndarray, draws: np.ndarray, kind: str) -> np.ndarray:
    """Weights (cluster x draw) from hashed keys."""
    mixed = _mixed(keys, draws)
    if kind == "webb":
        return np.asarray(WEBB)[(mixed % np.uint64(6)).astype(int)]
    return np.where(mixed & np.uint64(1), 1.0, -1.0)


def wild_cluster_interval(
    df: DataFrame,
    fit: LinearFit,
    y: str,
    cluster: str,
    j: int,
    level: float,
    draws: int,
    seed: int,
) -> tuple[float, float]:
    """Wild cluster bootstrap-t interval of one coefficient.

    Rows are reduced to cluster moments once; each task then folds all draws over its
    clusters and Spark sums the per-draw partials. Only ``draws`` x p numbers, a fixed
    parameter, reach the driver."""
    columns = list(fit.columns)
    p = len(columns)
    root, bread = _bread(fit)
    residual = df.withColumn("_res", F.col(y) - fit.prediction())
    table = cluster_moments(residual, columns, "_res", cluster).withColumn(
        "_key", F.xxhash64(F.lit(seed), F.col(cluster).cast("string"))
    )
    count = table.count()
    if count < MIN_CLUSTERS:
        raise ValueError(f"at least {MIN_CLUSTERS} clusters are needed")
    kind = "webb" if count < WEBB_BELOW else "rademacher"
    numbers = np.arange(draws)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((draws, p))
        for batch in batches:
            weights = wild_weights(batch["_key"].to_numpy(), numbers, kind)
            total += weights.T @ batch[[f"b_{i}" for i in range(p)]].to_numpy()
        yield pd.DataFrame({"b": numbers, **{f"d_{i}": total[:, i] for i in range(p)}})

    schema = "b long, " + ", ".join(f"d_{i} double" for i in range(p))
    shifts = (
        table.mapInPandas(scores, schema)
        .groupBy("b")
        .agg(*(F.sum(f"d_{i}").alias(f"d_{i}") for i in range(p)))
        .orderBy("b")
        .toPandas()
    )
    delta = shifts[[f"d_{i}" for i in range(p)]].to_numpy() @ bread

    def spreads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(draws)
        for batch in batches:
            s, b, f = _adjusted(batch, root)
            lead = np.einsum("i,gij->gj", bread[j], f)
            weights = wild_weights(batch["_key"].to_numpy(), numbers, kind)
            part = weights * np.einsum("gj,gj->g", lead, b)[:, None]
            part -= np.einsum("gj,gjk,bk->gb", lead, s, delta)
            total += (part * part).sum(axis=0)
        yield pd.DataFrame({"b": numbers, "v": total})

    variances = (
        table.mapInPandas(spreads, "b long, v double")
        .groupBy("b")
        .agg(F.sum("v").alias("v"))
        .orderBy("b")
        .toPandas()["v"]
        .to_numpy()
    )
    statistics = np.sort(np.abs(delta[:, j]) / np.sqrt(variances))
    rank = min(max(math.ceil(level * draws - 1e-9), 1), draws)
    se = math.sqrt(cr2_cov(df, fit, y, cluster)[j, j])
    half = float(statistics[rank - 1]) * se
    return float(fit.coef[j]) - half, float(fit.coef[j]) + half


#: Draws whose signs one digest of a row holds.
SIGN_BITS = 128


def sign_digests(row_key: Column, draws: int, seed: int) -> Column:
    """Signs of a row in all draws, as hex digits: bit ``b`` (from the left) of the md5 digests of
    ``seed:block:key``, a block for every 128 draws. Equal on any partitioning, and a plain
    expression in any SQL."""
    blocks = range(-(-draws // SIGN_BITS))
    key = row_key.cast("string")
    return F.concat(*(F.md5(F.concat(F.lit(f"{seed}:{n}:"), key).cast("binary")) for n in blocks))


def signed_sums(
    rows: DataFrame, keys: Sequence[str], terms: Sequence[str], row_key: str, draws: int, seed: int
) -> DataFrame:
    """Sums of ``terms`` under random signs of the rows: keys, ``b`` (from 1) and the terms.

    A draw changes nothing but the sign of a row, so no row is ever written once per draw: every
    task keeps one vector over the draws per key and term, adds its rows to it, and only
    these vectors are added up across tasks. Keys are few against rows (grid points,
    coefficients, clusters); a task passes on what it holds when it holds too many."""
    keys = list(keys)
    given = rows.select(*keys, *(F.col(t).cast("double").alias(t) for t in terms), sign_digests(F.col(row_key), draws, seed).alias("_signs"))
    fields = [given.schema[k] for k in keys]
    schema = T.StructType([*fields, *(T.StructField(t, T.ArrayType(T.DoubleType())) for t in terms)])
    most = max(1, (1 << 25) // (8 * draws * len(terms)))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> pd.DataFrame:
            named = [[*key, *(v.tolist() for v in sums)] for key, sums in held.items()]
            return pd.DataFrame(named, columns=[*keys, *terms])

        for batch in batches:
            digits = np.frombuffer(bytes.fromhex("".join(batch["_signs"])), np.uint8).reshape(len(batch), -1)
            signs = 1.0 - 2.0 * np.unpackbits(digits, axis=1)[:, :draws]
            values = batch[list(terms)].to_numpy(float)
            groups = batch.groupby(keys, dropna=False, sort=False).indices if keys else {(): np.arange(len(batch))}
            for key, at in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                sums = values[at].T @ signs[at]
                held[key] = held[key] + sums if key in held else sums
            if len(held) > most:
                yield told()
                held.clear()
        if held:
            yield told()

    parts = given.mapInPandas(fold, schema)
    zipped = F.explode(F.transform(F.arrays_zip(*terms), lambda v, n: F.struct((n + 1).alias("b"), v.alias("v"))))
    drawn = parts.select(*keys, zipped.alias("_d")).select(*keys, F.col("_d.b").alias("b"), "_d.v.*")
    return drawn.groupBy(*keys, "b").agg(*(F.sum(t).alias(t) for t in terms))


def signed_means(rows: DataFrame, x: str, fitted: str, residual: str, row_key: str, draws: int, seed: int) -> DataFrame:
    """Means of ``fitted`` plus signed ``residual`` by ``x`` in every draw: ``b``, ``x``, ``value``."""
    level = rows.groupBy(x).agg(F.avg(fitted).alias("_level"), F.count(F.lit(1)).alias("_n"))
    drawn = signed_sums(rows.withColumn("_r", F.col(residual)), [x], ["_r"], row_key, draws, seed)
    return drawn.join(level, x).select("b", x, (F.col("_level") + F.col("_r") / F.col("_n")).alias("value"))


def max_t_band(estimate: DataFrame, draws: DataFrame, level: float) -> DataFrame:
    """Simultaneous band on a grid: ``x``, ``estimate``, ``low``, ``high``.

    ``draws``: ``b``, ``x``, ``value``; grid points without spread keep their estimate.
    The draws and their spreads are written: each reading drew anew."""
    draws = cut_lineage(draws)
    spread = draws.groupBy("x").agg(F.stddev_samp("value").alias("_s"))
    base = cut_lineage(estimate.join(spread, "x"))
    ratio = F.abs(F.col("value") - F.col("estimate")) / F.col("_s")
    tops = (
        draws.join(base.filter(F.col("_s") > 0), "x")
        .groupBy("b")
        .agg(F.max(ratio).alias("_t"))
    )
    critical = quantiles.rank_values(
        tops, [], "_t", {"_critical": quantiles.order_rank(level)}
    ).select("_critical")
    half = F.col("_critical") * F.col("_s")
    return base.crossJoin(F.broadcast(critical)).select(  # one row
        "x",
        "estimate",
        (F.col("estimate") - half).alias("low"),
        (F.col("estimate") + half).alias("high"),
    )


def percentile_interval(
    draws: DataFrame, keys: Sequence[str], value: str, level: float
) -> DataFrame:
    """Order-statistic interval of the draws of each key."""
    tail = (1 - level) / 2
    return quantiles.rank_values(
        draws,
        keys,
        value,
        {"low": quantiles.order_rank(tail), "high": quantiles.order_rank(1 - tail)},
    )


def lag_autocorrelation(
    series: DataFrame,
    keys: Sequence[str],
    day: str,
    residual: str,
    classes: Sequence[tuple[int, int | None]],
) -> DataFrame:
    """Residual autocorrelation by class of day lag, without building pairs.

    Rows are summed by day; the products of a class are each day's sum times the sum of
    the days in its lag range, read from prefix frames (one row per day: bounded)."""
    keys = list(keys)
    center = series.groupBy(*keys).agg(F.avg(residual).alias("_mean"))
    joined = series.join(center, keys) if keys else series.crossJoin(F.broadcast(center))
    daily = joined.groupBy(*keys, day).agg(
        F.sum(F.col(residual) - F.col("_mean")).alias("_e"),
        F.sum(F.pow(F.col(residual) - F.col("_mean"), 2)).alias("_sq"),
        F.count(F.lit(1)).alias("_n"),
    )
    axis = Window.partitionBy(*keys).orderBy(day)

    def before(column: str, lag: int) -> Column:
        frame = axis.rangeBetween(Window.unboundedPreceding, -lag)
        return F.coalesce(F.sum(column).over(frame), F.lit(0))

    outputs = []
    for c, (low, high) in enumerate(classes):
        for tag, column in (("e", "_e"), ("n", "_n")):
            inside = before(column, low)
            if high is not None:
                inside = inside - before(column, high + 1)
            outputs.append(inside.alias(f"_{tag}{c}"))
    framed = daily.select("*", *outputs)
    sums = framed.groupBy(*keys).agg(
        F.sum("_sq").alias("_v"),
        F.sum("_n").alias("_all"),
        *(F.sum(F.col("_e") * F.col(f"_e{c}")).alias(f"p{c}") for c in range(len(classes))),
        *(F.sum(F.col("_n") * F.col(f"_n{c}")).alias(f"k{c}") for c in range(len(classes))),
    )
    variance = F.col("_v") / F.col("_all")
    rows = F.array(
        *(
            F.struct(
                F.lit(low).alias("lag_low"),
                F.lit(high).cast("int").alias("lag_high"),
                F.col(f"k{c}").cast("long").alias("pairs"),
                (
                    F.col(f"p{c}") / (F.nullif(f"k{c}", F.lit(0)) * F.nullif(variance, F.lit(0.0)))
                ).alias("correlation"),
            )
            for c, (low, high) in enumerate(classes)
        )
    )
    return sums.select(*keys, F.inline(rows))


def holm(
    tests: DataFrame, family: Sequence[str], p: str, tie: str, alpha: float
) -> DataFrame:
    """Adds ``rejected``: Holm's step-down decisions inside each family.

    A test is rejected when it and every smaller p-value pass their level. Families are
    declared lists of tests; a larger one is still scanned in slices."""
    sizes = tests.groupBy(*family).agg(F.count(F.lit(1)).alias("_m"))
    joined = tests.join(sizes, list(family)) if family else tests.crossJoin(F.broadcast(sizes))
    sliced = ordered.assign_chunks(joined, family, p)
    ranked = ordered.running(sliced, family, [p, tie], {"_k": ("sum", F.lit(1))})
    fails = F.col(p) > F.lit(alpha) / (F.col("_m") - F.col("_k") + 1)
    judged = ordered.running(
        ranked, family, [p, tie], {"_failed": ("max", F.when(fails, 1).otherwise(0))}
    )
    return ordered.without_chunks(judged).select(
        *tests.columns, (F.col("_failed") == 0).alias("rejected")
    )


def bonferroni_level(alpha: float, m: int) -> float:
    return 1.0 - alpha / m


def direction(low: Column, high: Column) -> Column:
    """Aggregate: +1 when every interval is above 0, -1 when every one is below."""
    return F.when(F.min(low) > 0, 1).when(F.max(high) < 0, -1).otherwise(0)


def reading(low: Column, high: Column, delta: float) -> Column:
    """Aggregate: established, no_useful_effect (all inside ]-delta ; delta[) or
    undecided."""
    inside = (F.min(low) > -delta) & (F.max(high) < delta)
    return (
        F.when(direction(low, high) != 0, "established")
        .when(inside, "no_useful_effect")
        .otherwise("undecided")
    )


def fraction_per_year(slope_per_day: Column) -> Column:
    """Yearly fraction of a daily slope on the log scale."""
    return F.expm1(365.25 * slope_per_day)


def power_table(outcomes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of simulated outcomes per effect ``b``.

    ``outcomes``: ``b``, ``estimate``, ``reading``, ``direction``."""
    established = F.col("reading") == "established"
    sign = F.signum("b").cast("int")
    share = F.sum(F.when(established, 1).otherwise(0)) / F.count(F.lit(1))
    same = F.sum(F.when(established & (F.col("direction") == sign), 1).otherwise(0))
    other = F.sum(F.when(established & (F.col("direction") == -sign), 1).otherwise(0))
    size = F.sum(F.when(established, F.abs("estimate") / F.nullif(F.abs("b"), F.lit(0.0))))
    found = F.nullif(F.sum(F.when(established, 1).otherwise(0)), F.lit(0))
    effect = F.max("b") != 0
    return outcomes.groupBy(*keys, "b").agg(
        F.count(F.lit(1)).alias("n_draws"),
        share.alias("p_established"),
        (
            F.sum(F.when(F.col("reading") == "no_useful_effect", 1).otherwise(0))
            / F.count(F.lit(1))
        ).alias("p_no_useful_effect"),
        F.sqrt(share * (1 - share) / F.count(F.lit(1))).alias("mc_se"),
        F.when(effect, same / F.count(F.lit(1))).alias("power"),
        F.when(effect, other / found).alias("s_error"),
        F.when(effect, size / found).alias("m_error"),
    )


def smallest_visible_effect(powers: DataFrame, keys: Sequence[str], target: float) -> DataFrame:
    reached = (F.col("b") != 0) & (F.col("power") >= target)
    return powers.groupBy(*keys).agg(F.min(F.when(reached, F.abs("b"))).alias("visible"))


def calibrated_alpha(
    rates: DataFrame, alpha_target: float, trigger: float = 0.075
) -> DataFrame:
    """Calibrated threshold from ``scenario``, ``alpha``, ``rate``: the nominal (largest)
    alpha unless its worst rate passes the trigger, then the largest admissible one."""
    worst = rates.groupBy("alpha").agg(F.max("rate").alias("rate"))
    out = worst.agg(
        F.max("alpha").alias("_nominal"),
        F.max_by("rate", "alpha").alias("nominal_rate"),
        F.max(F.when(F.col("rate") <= alpha_target, F.col("alpha"))).alias("_admissible"),
    )
    triggered = F.col("nominal_rate") > trigger
    return out.select(
        F.when(triggered, F.col("_admissible")).otherwise(F.col("_nominal")).alias("alpha"),
        triggered.alias("triggered"),
        "nominal_rate",
    )


def natural_cubic_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Natural cubic spline basis at increasing knots, without the constant.

    Besides ``x`` itself, each term is a fixed combination of three cubes, those past its own
    knot, past the last knot but one and past the last: its weights cancel the second and
    third powers beyond the last knot."""
    cubes = [F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3.0)) for k in knots]
    per_unit = [1.0 / (knots[-1] - k) for k in knots[:-1]]
    return [x] + [
        cubes[j] * w - cubes[-2] * per_unit[-1] + cubes[-1] * (per_unit[-1] - w)
        for j, w in enumerate(per_unit[:-1])
    ]


def season(day: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year."""
    angle = F.dayofyear(day) * (2 * math.pi / 365.25)
    return F.sin(angle), F.cos(angle)


def draws_p_value(direct: Column, share_low: Column, share_high: Column, holds_zero: Column) -> Column:
    """Largest of a direct p-value and twice the smaller tail of the draws, at most 1;
    1 when the interval of the ratio holds zero."""
    tails = F.least(F.lit(1.0), 2 * F.least(share_low, share_high))
    return F.when(holds_zero, 1.0).otherwise(F.greatest(direct, tails))
