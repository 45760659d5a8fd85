"""The two study questions: vertical-speed figure tables and the efficiency trend."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.operators import climbs, panel, trend

PANELS = ("short_climb", "intermediate", "long_climb", "ski_touring")
FACETS = ("moderate", "steep", "very_steep")
POINT = ["regime", "grade_stratum", "altitude_stratum", "activity_ref"]


def vertical_speed_figure(
    climb_rows: DataFrame, variants: DataFrame, activities: DataFrame
) -> dict[str, DataFrame]:
    """Points of the two views, their stability, the monthly flow and device changes.

    ``activities``: ``activity_ref``, ``start_time``, ``start_s``, ``session_count``,
    ``manufacturer``, ``product``."""
    info = activities.select("activity_ref", "start_time", "session_count")
    rows = climb_rows.filter(F.col("regime").isin(*PANELS)).join(info, "activity_ref")
    single = F.coalesce("session_count", F.lit(1)) <= 1
    stratified = F.col("grade_stratum").isin(*FACETS) & F.col("altitude_stratum").isNotNull()
    clean = F.size("flags") == 0
    kept = rows.filter(clean & single & stratified)
    facet = ["regime", "grade_stratum"]
    main = climbs.figure_points(kept, POINT, facet).withColumn("view", F.lit("main"))
    stable = climbs.figure_points(kept.filter("stable"), POINT, facet).withColumn(
        "view", F.lit("stable_only")
    )
    usable = variants.filter(F.size("flags") == 0)
    shares = climbs.point_stability(
        kept.select(
            *POINT,
            F.col("start_s").alias("ref"),
            "start_s",
            "end_s",
            F.get("moving_gain_m", F.lit(1)).alias("gain"),
        ),
        usable.select(
            *POINT,
            "variant",
            F.col("start_s").alias("v_start_s"),
            F.col("end_s").alias("v_end_s"),
        ),
        POINT,
    )
    flow = climbs.month_flow(
        rows,
        "regime",
        "start_time",
        {
            "climbs": F.lit(True),
            "flagged": ~clean,
            "multisession": clean & ~single,
            "unstratified": clean & single & ~stratified,
            "kept": clean & single & stratified,
        },
    )
    order = {
        "regime": F.array_position(F.array(*(F.lit(p) for p in PANELS)), F.col("regime")),
        "facet": F.array_position(F.array(*(F.lit(f) for f in FACETS)), F.col("grade_stratum")),
    }
    points = main.unionByName(stable).withColumn("panel_order", order["regime"]).withColumn(
        "facet_order", order["facet"]
    )
    return {
        "points": points,
        "point_stability": shares,
        "flow": flow,
        "device_changes": climbs.device_changes(activities, []),
    }


# Names of the declared trials in their order; the five after the principal are
# the family of the Holm decisions. Classes of day lags of the residual autocorrelation.
TRIAL_NAMES = (
    "P",
    "S-MP-cotes",
    "S-MP-ski",
    "S-MS-longues",
    "S-MS-cotes",
    "S-MS-ski",
    *(f"S{n}" for n in (1, 2, 3, 4, 5, *range(8, 21))),
)
HOLM_FAMILY = TRIAL_NAMES[1:6]
LONG, SHORT, SKI = "long_climb", "short_climb", "ski_touring"
LAG_CLASSES: tuple[tuple[int, int | None], ...] = ((1, 7), (8, 30), (31, 90), (91, None))


@dataclass(frozen=True)
class Trial:
    """One declared trial: what it changes of the principal one.

    ``regime`` picks the days, ``keep`` filters them further, ``response`` is read, ``drop``
    (prefixes), ``add`` and ``rename`` change the columns, ``slope`` is the column whose
    coefficient is reported and ``method`` how it is estimated."""

    name: str
    regime: str | None = LONG
    keep: Column | None = None
    response: str = "y"
    drop: Sequence[str] = ()
    add: Sequence[str] = ()
    rename: Mapping[str, str] = field(default_factory=dict)
    slope: str = "date"
    method: str = "ols"

    def columns(self, base: Sequence[str]) -> list[str]:
        kept = [self.rename.get(c, c) for c in base if not any(c == d or (d.endswith("_") and c.startswith(d)) for d in self.drop)]
        return [*kept, *(c for c in self.add if c not in kept)]


def declared_trials(base: Sequence[str] = ("hr",)) -> list[Trial]:
    """The principal trial, the five secondary ones and the eighteen sensitivities, in order.

    ``base`` are the columns of the principal trial: the form of the heart rate (one column
    or a spline) and the day's deviation are switched to the other version."""
    linear, deviating = "hr" in base, "e_s" in base
    spline = ("hr_s1", "hr_s2")
    other = {"drop": ("hr",), "add": spline} if linear else {"drop": spline, "add": ("hr",)}
    changed = [
        Trial("P"),
        Trial("S-MP-cotes", SHORT),
        Trial("S-MP-ski", SKI),
        Trial("S-MS-longues", LONG, response="y_ms"),
        Trial("S-MS-cotes", SHORT, response="y_ms"),
        Trial("S-MS-ski", SKI, response="y_ms"),
        Trial("S1", rename={"hr": "hr_unlagged"}),
        Trial("S2", rename={"hr": "hr_second"}),
        Trial("S3", **other),
        Trial("S4", keep=F.col("all_stable") & ~F.col("any_slow")),
        Trial("S5", keep=~F.col("period").eqNullSafe(F.lit("discovery"))),
        Trial("S8", drop=("season_",)),
        Trial("S9", method="common_support"),
        Trial("S10", **({"drop": ("e_s",)} if deviating else {"add": ("e_s",)})),
        Trial("S11", method="huber"),
        Trial("S12", response="y_s12"),
        Trial("S13", add=("preceding_moving_s",)),
        Trial("S14", method="clustered"),
        Trial("S15", drop=("route_",)),
        Trial("S16", rename={"hr": "hr_elapsed"}),
        Trial("S17", response="y_within", drop=("hr", "hr_")),
        Trial("S18", method="inverse"),
        Trial("S19", LONG, response="y_ms", slope="hr"),
        Trial("S20", SHORT, response="y_ms", slope="hr"),
    ]
    return changed


def _support(sample: DataFrame) -> Column:
    """Heart rates that both the discovery and what follows it hold."""
    ends = (
        sample.filter(F.col("period").isin("discovery", "after"))
        .groupBy("period")
        .agg(F.min("hr").alias("low"), F.max("hr").alias("high"))
        .agg(F.max("low"), F.min("high"), F.count(F.lit(1)))
        .first()
    )
    if ends[2] < 2 or ends[0] is None:
        return F.lit(False)
    return F.col("hr").between(ends[0], ends[1])


def efficiency_trials(
    design: DataFrame,
    columns: Sequence[str],
    trials: Sequence[Trial] | None = None,
    *,
    eta: float | None = None,
    cluster: str = "month_no",
    alpha: float = 0.05,
    min_df: int = 10,
    draws: int = 999,
    seed: int = 1,
) -> DataFrame:
    """Slope of the response on the date for every trial, in the declared order.

    ``design`` has a row per day and regime. Trials are least squares with cluster-robust
    errors over months, but for the robust one (Huber), the clustered one (wild bootstrap by
    month) and the inverse one (heart rate on response and date, solved for the response).
    ``eta``, the slope within days, is taken off the response of the trial without a
    heart-rate column. Holm decisions are taken over the five secondary trials alone. A trial without its
    columns or with too few days says so. One row per trial: ``number``, ``trial``, ``n``,
    ``slope``, ``se``, ``low``, ``high``, ``p``, ``reason``, ``rejected``, ``per_year``."""
    spark = design.sparkSession
    if eta is not None and {"y", "hr"} <= set(design.columns):
        design = design.withColumn("y_within", F.col("y") - F.lit(eta) * F.col("hr"))
    rows = []
    for number, trial in enumerate(trials or declared_trials(columns)):

        def told(reason: str, n=None, trial=trial, number=number):
            return (number, trial.name, n, None, None, None, None, None, reason)

        wanted = trial.columns(columns)
        inverse = trial.method == "inverse"
        response = trial.response
        if inverse:
            if "hr" not in wanted:
                rows.append(told("missing_column"))
                continue
            wanted, response = [response if c == "hr" else c for c in wanted], "hr"
        try:
            sample = design if trial.regime is None else design.filter(F.col("regime") == trial.regime)
            sample = sample if trial.keep is None else sample.filter(trial.keep)
            sample = sample.dropna(subset=[response, cluster, *wanted])
            if trial.method == "common_support":
                sample = sample.filter(_support(sample))
            slope_at = wanted.index(trial.slope)
        except (AnalysisException, ValueError):
            rows.append(told("missing_column"))
            continue
        size = sample.count()
        if size - len(wanted) < min_df:
            rows.append(told("too_few_days", size))
            continue
        if trial.method == "huber":
            fit, _, _ = trend.huber(sample, wanted, response)
            covariance = fit.cov
        else:
            fit = trend.ols(sample, wanted, response)
            covariance = trend.cr2_cov(sample, fit, response, cluster)
        slope, se = float(fit.coef[slope_at]), float(covariance[slope_at, slope_at] ** 0.5)
        if inverse:
            share = float(fit.coef[wanted.index(trial.response)])
            slope, se = -slope / share, abs(se / share)
        half = trend.quantile(1 - alpha / 2, fit.df) * se
        low, high = slope - half, slope + half
        if trial.method == "clustered":
            try:
                low, high = trend.wild_cluster_interval(sample, fit, response, cluster, slope_at, 1 - alpha, draws, seed)
            except ValueError as error:
                rows.append(told(str(error), size))
                continue
        p = trend.two_sided_p(slope / se, fit.df) if se > 0 else None
        rows.append((number, trial.name, size, slope, se, low, high, p, None))
    schema = "number int, trial string, n long, slope double, se double, low double, high double, p double, reason string"
    table = spark.createDataFrame(rows, schema)
    family = table.filter(F.col("p").isNotNull() & F.col("trial").isin(*HOLM_FAMILY))
    judged = trend.holm(family, [], "p", "trial", alpha)
    return table.join(judged.select("trial", "rejected"), "trial", "left").withColumn(
        "per_year", trend.fraction_per_year(F.col("slope"))
    )


def residual_autocorrelation(
    design: DataFrame,
    columns: Sequence[str],
    classes: Sequence[tuple[int, int | None]] = LAG_CLASSES,
    *,
    response: str = "y",
    min_df: int = 10,
) -> DataFrame:
    """Autocorrelation of the residuals by class of day lag, for each regime that can be fitted.

    ``design`` has a ``day`` number; returns ``regime``, ``lag_low``, ``lag_high``, ``pairs`` and
    ``correlation``."""
    out = None
    for regime in (LONG, SHORT, SKI):
        sample = design.filter(F.col("regime") == regime).dropna(subset=[response, *columns])
        if sample.count() - len(columns) < min_df:
            continue
        fit = trend.ols(sample, list(columns), response)
        residuals = sample.select("regime", "day", (F.col(response) - fit.prediction()).alias("residual"))
        found = trend.lag_autocorrelation(residuals, ["regime"], "day", "residual", classes)
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = "regime string, lag_low int, lag_high int, pairs long, correlation double"
        return design.sparkSession.createDataFrame([], empty)
    return out


def trend_figure(
    design: DataFrame,
    columns: Sequence[str],
    grid_days: int,
    *,
    draws: int = 200,
    level: float = 0.95,
    seed: int = 1,
    row_key: str = "day",
) -> tuple[DataFrame, DataFrame]:
    """(partial residuals, spline curve with its simultaneous band on a day grid).

    The draws change the response only, so every curve is a linear map of one set of
    cross-products per draw."""
    spark = design.sparkSession
    fit = trend.ols(design, list(columns), "y")
    residuals = panel.partial_residuals(design, fit, "one", "date")
    knots = panel.spline_knots(residuals, "date")
    basis = trend.natural_cubic_basis(F.col("date"), knots)
    shaped = residuals.withColumn("one", F.lit(1.0))
    names = ["one"]
    for i, column in enumerate(basis):
        shaped = shaped.withColumn(f"_b{i}", column)
        names.append(f"_b{i}")
    smooth = trend.ols(shaped, names, "partial")
    ends = shaped.agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()[0]
    step = (ends["b"] - ends["a"]) / max(grid_days - 1, 1)
    grid = spark.range(grid_days).select((F.lit(ends["a"]) + F.col("id") * step).alias("date"))
    grid = grid.withColumn("one", F.lit(1.0))
    for i, column in enumerate(trend.natural_cubic_basis(F.col("date"), knots)):
        grid = grid.withColumn(f"_b{i}", column)
    estimate = grid.select(F.col("date").alias("x"), smooth.prediction().alias("estimate"))
    fitted = shaped.withColumn("_fit", smooth.prediction()).withColumn(
        "_res", F.col("partial") - F.col("_fit")
    )
    # X'y of a draw: that of the fitted values, and the signed sums of the residuals.
    plain = fitted.agg(*(F.sum(F.col(c) * F.col("_fit")).alias(f"_p{i}") for i, c in enumerate(names)))
    scored = fitted
    for i, c in enumerate(names):
        scored = scored.withColumn(f"_s{i}", F.col(c) * F.col("_res"))
    terms = [f"_s{i}" for i in range(len(names))]
    drawn = trend.signed_sums(scored, [], terms, row_key, draws, seed)
    crossed = drawn.crossJoin(F.broadcast(plain)).select(  # one row
        "b", *((F.col(f"_s{i}") + F.col(f"_p{i}")).alias(f"_s{i}") for i in range(len(names)))
    )
    inverse = smooth.cov / smooth.scale
    coefs = crossed.select(
        "b",
        *(
            sum((F.col(f"_s{j}") * float(inverse[i, j]) for j in range(1, len(names))), F.col("_s0") * float(inverse[i, 0])).alias(f"_c{i}")
            for i in range(len(names))
        ),
    )
    # The grid and the draws are parameters (hundreds of rows each).
    curves = coefs.join(F.broadcast(grid)).select(
        "b",
        F.col("date").alias("x"),
        sum((F.col(f"_c{i}") * F.col(c) for i, c in enumerate(names[1:], start=1)), F.col("_c0")).alias("value"),
    )
    return residuals, trend.max_t_band(estimate, curves, level)


def flow_table(
    kept: DataFrame, excluded: DataFrame, keys: Sequence[str] = ("regime", "period", "month")
) -> DataFrame:
    """Exclusion flow of the panel: counts per regime, period, month and motif."""
    both = kept.unionByName(excluded, allowMissingColumns=True)
    return panel.flow_counts(both, keys)
