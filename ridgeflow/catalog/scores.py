"""Scores, calibration, bands and comparisons on line items and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeflow.catalog import Check
from ridgeflow.functions import student
from ridgeflow.operators import calibration, drift, effects, ordered, scoring
from ridgeflow.plans import sensitivity
from ridgeflow.tables import compact, day_number, events, table

SUPPLIER = ["l_suppkey"]


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as scored segments: observed = quantity, projected = price / 1000;
    class from the flag; one supplier in nine has a zero time, one in eleven a bad
    output."""
    items = table(spark, sf, "lineitem")
    zero = (F.col("l_suppkey") % 9 == 4) & (F.col("l_linenumber") == 3)
    bad = (F.col("l_suppkey") % 11 == 5) & (F.col("l_linenumber") == 5)
    return items.select(
        "l_suppkey",
        "l_orderkey",
        F.col("l_linenumber").alias("k"),
        F.col("l_returnflag").alias("klass"),
        F.when(zero, 0.0).otherwise(F.col("l_quantity")).alias("t"),
        F.when(~bad, F.col("l_extendedprice") / 1000).alias("p"),
    )


SEGMENTS_SQL = """
WITH s AS (
  SELECT l_suppkey, l_orderkey, l_linenumber AS k, l_returnflag AS klass,
         CASE WHEN l_suppkey % 9 = 4 AND l_linenumber = 3 THEN 0.0 ELSE l_quantity END AS t,
         CASE WHEN NOT (l_suppkey % 11 = 5 AND l_linenumber = 5) THEN l_extendedprice / 1000 END AS p
  FROM lineitem)
"""

SCORED_SQL = """,
tot AS (SELECT l_suppkey, count(*) AS n, sum(p) AS sp, sum(t) AS st, bool_or(p IS NULL) AS err,
               bool_or(t = 0) AS zero FROM {src} GROUP BY l_suppkey),
cls AS (SELECT l_suppkey, klass, count(*) AS n, sum(p) AS cp, sum(t) AS ct FROM {src} GROUP BY 1, 2),
j AS (SELECT x.*, tot.sp, tot.st, tot.err, tot.zero, cls.cp, cls.ct, cls.n AS cn,
             ln(sp / st) AS lv, ln(cp / ct) AS cl, CASE WHEN t > 0 AND p IS NOT NULL THEN ln(p / t) END AS r
      FROM {src} x JOIN tot USING (l_suppkey) JOIN cls USING (l_suppkey, klass)),
dev AS (SELECT l_suppkey, klass, max(cn) AS n, max(cl) AS cl, max(lv) AS lv, max(ct) AS ct, max(st) AS st,
               sum(t * abs(r - cl)) AS d, sum(t * abs(r - lv)) AS a,
               sum(t * ((abs(r - cl) + abs(cl - lv)) - abs(r - lv))) AS c
        FROM j WHERE NOT err AND NOT zero GROUP BY 1, 2)
"""

OVERALL_SELECT = """
SELECT tot.l_suppkey, tot.n, tot.err AS model_error,
       round(CASE WHEN NOT tot.err AND tot.st > 0 THEN ln(tot.sp / tot.st) END, 6) AS log_ratio,
       round(sum(dev.a) / max(dev.st), 6) AS dispersion,
       round(sum(dev.ct / dev.st * dev.d / dev.ct), 6) AS within,
       round(sum(dev.ct / dev.st * abs(dev.cl - dev.lv)), 6) AS between,
       round(sum(dev.c) / max(dev.st), 6) AS compensation,
       CASE WHEN tot.zero THEN 'zero_time' WHEN tot.err THEN 'model_error' END AS vector_motif
FROM tot LEFT JOIN dev ON dev.l_suppkey = tot.l_suppkey
GROUP BY tot.l_suppkey, tot.n, tot.err, tot.st, tot.sp, tot.zero
"""

OVERALL = (
    "l_suppkey",
    "n",
    "model_error",
    "log_ratio",
    "dispersion",
    "within",
    "between",
    "compensation",
    "vector_motif",
)


def support_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return compact(scoring.support_scores(_segments(spark, sf), SUPPLIER).overall, *OVERALL)


def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.support_scores(_segments(spark, sf), SUPPLIER).classes
    return compact(
        out, "l_suppkey", "klass", "n", "thin", "class_level", "class_dispersion", "class_offset"
    )


CLASS_SQL = SEGMENTS_SQL + SCORED_SQL.format(src="s") + """
SELECT cls.l_suppkey, cls.klass, cls.n, cls.n < 3 AS thin, round(dev.cl, 6) AS class_level,
       round(dev.d / dev.ct, 6) AS class_dispersion, round(dev.cl - dev.lv, 6) AS class_offset
FROM cls LEFT JOIN dev USING (l_suppkey, klass)
"""


def positive_time_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.positive_time_scores(_segments(spark, sf), SUPPLIER).overall
    return compact(out, *OVERALL)


POSITIVE_SQL = SEGMENTS_SQL + """,
e AS (SELECT l_suppkey, bool_or(p IS NULL) AS bad FROM s GROUP BY 1),
u AS (SELECT s.l_suppkey, l_orderkey, k, klass, t, CASE WHEN NOT bad THEN p END AS p
      FROM s JOIN e ON e.l_suppkey = s.l_suppkey WHERE t > 0)
""" + SCORED_SQL.format(src="u") + OVERALL_SELECT


def ratio_envelope(spark: SparkSession, sf: str) -> DataFrame:
    sums = _segments(spark, sf).groupBy("l_suppkey").agg(
        F.sum("p").alias("p"),
        (F.sum("t") * F.when(F.col("l_suppkey") % 7 == 0, 0.0).otherwise(0.5)).alias("low_s"),
        (F.sum("t") * 1.2).alias("high_s"),
    )
    bounds = scoring.level_envelope(F.col("p"), F.col("low_s"), F.col("high_s"))
    out = sums.select("l_suppkey", *(c.alias(n) for n, c in bounds.items()))
    finite = F.when(F.col("upper") < float("inf"), F.col("upper"))
    return compact(out.withColumn("upper", finite))


ENVELOPE_SQL = SEGMENTS_SQL + """,
b AS (SELECT l_suppkey, sum(p) AS p, sum(t) * (CASE WHEN l_suppkey % 7 = 0 THEN 0.0 ELSE 0.5 END) AS lo,
             sum(t) * 1.2 AS hi FROM s GROUP BY l_suppkey)
SELECT l_suppkey, round(ln(p / hi), 6) AS lower, round(CASE WHEN lo > 0 THEN ln(p / lo) END, 6) AS upper,
       round(CASE WHEN ln(p / hi) <= 0 AND (lo = 0 OR ln(p / nullif(lo, 0)) >= 0) THEN 0.0
                  WHEN lo = 0 THEN abs(ln(p / hi))
                  ELSE least(abs(ln(p / hi)), abs(ln(p / lo))) END, 6) AS min_abs,
       CASE WHEN lo = 0 THEN 'zero_time' END AS envelope_motif
FROM b
"""


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """Line items of an order as usage targets in line order."""
    items = table(spark, sf, "lineitem")
    per_line = items.groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg(
        F.sum("l_quantity").alias("q"),
        F.sum("l_extendedprice").alias("x"),
        F.max("l_suppkey").alias("s"),
    )
    gone = (F.col("s") % 10 == 3) & (F.col("k") > 4)
    return per_line.select(
        "l_orderkey",
        "k",
        F.when(~gone, F.col("q")).alias("t"),
        F.when(gone, F.concat(F.lit("gone_"), F.col("k").cast("string"))).alias("motif"),
        F.when(F.col("s") % 13 != 6, F.col("x") / 1400).alias("p"),
        (F.col("x") / 1500).alias("p0"),
    )


TARGETS_SQL = """
WITH g AS (SELECT l_orderkey, l_linenumber AS k, sum(l_quantity) AS q, sum(l_extendedprice) AS x,
                  max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_orderkey, k, CASE WHEN NOT (s % 10 = 3 AND k > 4) THEN q END AS t,
             CASE WHEN s % 10 = 3 AND k > 4 THEN 'gone_' || k END AS motif,
             CASE WHEN s % 13 <> 6 THEN x / 1400 END AS p, x / 1500 AS p0 FROM g)
"""


def usage_target(spark: SparkSession, sf: str) -> DataFrame:
    return compact(scoring.usage_target(_targets(spark, sf), ["l_orderkey"]))


USAGE_SQL = TARGETS_SQL + """,
a AS (SELECT l_orderkey, count(*) AS targets, count(t) AS available,
             CAST(sum(CASE WHEN t > 0 THEN 1 ELSE 0 END) AS BIGINT) AS comparable,
             bool_or(p IS NULL) AS err, sum(p0) AS w, sum(CASE WHEN t IS NOT NULL THEN p0 END) AS ws,
             sum(abs(p - t)) AS e, arg_min(motif, k) FILTER (motif IS NOT NULL) AS first_motif
      FROM t GROUP BY l_orderkey)
SELECT l_orderkey, targets, available, comparable, err AS model_error,
       round(CASE WHEN first_motif IS NULL AND NOT err THEN e / w END, 6) AS usage,
       coalesce(first_motif, CASE WHEN err THEN 'model_error' END) AS usage_motif,
       round(CASE WHEN available > 0 AND NOT err THEN e / ws END, 6) AS usage_prefix,
       CASE WHEN available = 0 THEN 'insufficient_support' WHEN err THEN 'model_error' END AS prefix_motif
FROM a
"""


def passage_errors(spark: SparkSession, sf: str) -> DataFrame:
    return compact(scoring.passage_summary(_targets(spark, sf), ["l_orderkey"]))


PASSAGE_SQL = TARGETS_SQL + """,
a AS (SELECT l_orderkey, count(t) AS observed, bool_or(p IS NULL) AS err, max(abs(p - t)) AS ab,
             max(p - t) AS hi, min(p - t) AS lo FROM t GROUP BY l_orderkey),
m AS (SELECT *, CASE WHEN observed = 0 THEN 'insufficient_support' WHEN err THEN 'model_error' END AS status FROM a)
SELECT l_orderkey, observed, err AS model_error,
       round(CASE WHEN status IS NULL THEN ab END, 6) AS max_abs_error,
       round(CASE WHEN status IS NULL THEN hi END, 6) AS max_error,
       round(CASE WHEN status IS NULL THEN lo END, 6) AS min_error, status
FROM m
"""


def segment_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = _targets(spark, sf).filter(F.col("p").isNotNull() & F.col("t").isNotNull())
    out = scoring.segment_gaps(rows, ["l_orderkey"])
    return compact(out, "l_orderkey", "k", "gap_s", "step_gap_s")


GAPS_SQL = TARGETS_SQL + """
SELECT l_orderkey, k, round(p - t, 6) AS gap_s,
       round(p - t - coalesce(lag(p - t) OVER (PARTITION BY l_orderkey ORDER BY k), 0.0), 6) AS step_gap_s
FROM t WHERE p IS NOT NULL AND t IS NOT NULL
"""

CUSTOMER = ["o_custkey"]


def _performances(spark: SparkSession, sf: str) -> DataFrame:
    """One performance per customer and day: end = the day, totals from prices."""
    orders = table(spark, sf, "orders")
    per_day = orders.groupBy("o_custkey", day_number("o_orderdate").alias("day")).agg(
        F.sum("o_totalprice").alias("x"), F.max("o_orderkey").alias("o")
    )
    return per_day.select(
        "o_custkey",
        "day",
        F.col("day").cast("double").alias("end_time"),
        (F.col("day") - 7).cast("double").alias("origin"),
        (F.col("x") / 1000).alias("t_all"),
        F.when(F.col("o") % 101 != 50, (F.col("x") + 40000) / 1100).alias("p_all"),
        F.when(F.col("o") % 17 == 3, "zero_time").alias("withdrawal"),
        (F.col("o") % 5 != 0).alias("is_training"),
        (F.col("o") % 10 == 0).alias("is_race"),
    )


PERF_SQL = """
WITH d AS (SELECT o_custkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day,
                  sum(o_totalprice) AS x, max(o_orderkey) AS o FROM orders GROUP BY 1, 2),
f AS (SELECT o_custkey, day, x / 1000 AS t, CASE WHEN o % 101 <> 50 THEN (x + 40000) / 1100 END AS p,
             CASE WHEN o % 17 = 3 THEN 'zero_time' END AS w, o % 5 <> 0 AS tr, o % 10 = 0 AS race FROM d)
"""


def calibration_beta(spark: SparkSession, sf: str) -> DataFrame:
    perf = _performances(spark, sf)
    out = calibration.calibrate(perf.select("o_custkey", "day", "origin"), perf, CUSTOMER)
    counts = ["members", "excluded_race", "excluded_unlabelled", "withdrawn", "population"]
    typed = out.select(
        "o_custkey",
        "day",
        *(F.col(c).cast("long").alias(c) for c in counts),
        "calibration_motif",
        "beta",
        "effort",
        "factor",
        "saturated",
    )
    return compact(typed)


BETA_SQL = PERF_SQL + """,
m AS (SELECT j.o_custkey, j.day, count(c.day) FILTER (c.tr) AS members,
             count(c.day) FILTER (NOT c.tr AND c.race) AS excluded_race,
             count(c.day) FILTER (NOT c.tr AND NOT c.race) AS excluded_unlabelled,
             count(c.day) FILTER (c.tr AND c.w IS NOT NULL) AS withdrawn,
             count(c.day) FILTER (c.tr AND c.w IS NULL) AS population,
             count(c.day) FILTER (c.tr AND c.w IS NULL AND c.p IS NULL) AS invalid,
             avg(ln(c.t / c.p)) FILTER (c.tr AND c.w IS NULL AND c.p IS NOT NULL) AS b
      FROM f j LEFT JOIN f c ON c.o_custkey = j.o_custkey AND c.day < j.day - 7
      GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN population = 0 THEN 'not_calibrated' WHEN invalid > 0 THEN 'model_error' END AS motif FROM m),
z AS (SELECT *, CASE WHEN motif IS NULL THEN b END AS beta FROM s)
SELECT o_custkey, day, members, excluded_race, excluded_unlabelled, withdrawn, population,
       motif AS calibration_motif, round(beta, 6) AS beta,
       round(greatest(0.5, least(1.5, exp(-beta))) + beta * 0, 6) AS effort,
       round(1 / greatest(0.5, least(1.5, exp(-beta))) + beta * 0, 6) AS factor,
       exp(-beta) < 0.5 OR exp(-beta) > 1.5 AS saturated
FROM z
"""


def _reservoir(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.reservoir(_performances(spark, sf), None, CUSTOMER, ["day"])


def band_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the residuals known before each performance's origin."""
    members = _reservoir(spark, sf)
    out = calibration.prefix_ranks(
        members.select("o_custkey", "day", "origin"),
        members,
        CUSTOMER,
        "origin",
        "end_time",
        "z",
        calibration.BAND_ORDERS,
    )
    return compact(
        out.withColumn("n_known", F.coalesce(F.col("n_known"), F.lit(0)).cast("long")),
        "o_custkey",
        "day",
        "n_known",
        *calibration.BAND_ORDERS,
    )


RANKED_SQL = PERF_SQL + """,
z AS (SELECT o_custkey, day, ln(t / p) AS z FROM f WHERE w IS NULL AND p IS NOT NULL),
pr AS (SELECT j.o_custkey, j.day, c.z, row_number() OVER w AS r, count(*) OVER (PARTITION BY j.o_custkey, j.day) AS n
       FROM f j JOIN z c ON c.o_custkey = j.o_custkey AND c.day < j.day - 7
       WINDOW w AS (PARTITION BY j.o_custkey, j.day ORDER BY c.z)),
q AS (SELECT o_custkey, day, max(n) AS n, max(CASE WHEN r = (n + 9) // 10 THEN z END) AS q_low,
             max(CASE WHEN r = (n + 1) // 2 THEN z END) AS q_median,
             max(CASE WHEN r = (n * 2 + 2) // 3 THEN z END) AS q_prudent,
             max(CASE WHEN r = (n * 9 + 9) // 10 THEN z END) AS q_high
      FROM pr GROUP BY 1, 2)
"""

BAND_SQL = RANKED_SQL + """
SELECT f.o_custkey, f.day, coalesce(q.n, 0) AS n_known, round(q_low, 6) AS q_low, round(q_median, 6) AS q_median,
       round(q_prudent, 6) AS q_prudent, round(q_high, 6) AS q_high
FROM f LEFT JOIN q ON q.o_custkey = f.o_custkey AND q.day = f.day
"""


def bands_interval_score(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of each performance seen as three targets (a fifth, a half, the whole)."""
    members = _reservoir(spark, sf)
    known = calibration.prefix_ranks(
        members.select("o_custkey", "day", "origin"),
        members,
        CUSTOMER,
        "origin",
        "end_time",
        "z",
        calibration.BAND_ORDERS,
    ).filter(F.col("n_known").isNotNull())
    shares = F.array(
        *(
            F.struct(F.lit(k).alias("k"), F.lit(s).alias("_s"), F.lit(w).alias("w"))
            for k, s, w in ((0, 0.2, 0.25), (1, 0.5, 0.25), (2, 1.0, 0.5))
        )
    )
    targets = members.filter(F.col("p_all").isNotNull()).select(
        "o_custkey", "day", "t_all", "p_all", F.inline(shares)
    )
    targets = targets.select(
        "o_custkey",
        "day",
        "k",
        "w",
        (F.col("p_all") * F.col("_s")).alias("p"),
        (F.col("p_all") * F.col("_s")).alias("p0"),
        (F.col("t_all") * F.col("_s")).alias("t"),
    )
    _, summary = calibration.bands(
        targets, known.select("o_custkey", "day", "n_known", *calibration.BAND_ORDERS), ["o_custkey", "day"]
    )
    return compact(
        summary.withColumn("n_known", F.col("n_known").cast("long")).withColumn(
            "coverage", F.when(F.col("n_known") > 1, F.col("coverage"))
        ),
        digits=5,
    )


SCORE_SQL = RANKED_SQL + """,
k AS (SELECT k, CAST(s AS DOUBLE) AS s, CAST(w AS DOUBLE) AS w
      FROM (VALUES (0, 0.2, 0.25), (1, 0.5, 0.25), (2, 1.0, 0.5)) v(k, s, w)),
e AS (SELECT f.o_custkey, f.day, n, k.w, f.p * s AS p, f.t * s AS t, f.p * s * exp(q_low) AS lo,
             f.p * s * exp(q_median) AS md, f.p * s * exp(q_high) AS hi
      FROM f JOIN q ON q.o_custkey = f.o_custkey AND q.day = f.day CROSS JOIN k WHERE f.p IS NOT NULL),
g AS (SELECT *, hi - lo + 10 * greatest(lo - t, 0) + 10 * greatest(t - hi, 0) AS sc FROM e)
SELECT o_custkey, day, max(n) AS n_known, round(sum(w * sc), 5) AS interval_score_s,
       round(sum(w * sc / p), 5) AS normalised_score,
       round(CASE WHEN max(n) > 1 THEN sum(CASE WHEN t BETWEEN lo AND hi THEN w ELSE 0.0 END) END, 5) AS coverage,
       CASE WHEN max(n) > 1 THEN bool_and(t BETWEEN lo AND hi) END AS all_covered,
       round(max(abs(md - t)), 5) AS median_max_abs_error_s
FROM g GROUP BY o_custkey, day
"""


def common_set_means(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as models: means over the user-days where every type appears."""
    rows = events(spark, sf).groupBy(
        "user_id", F.floor(day_number("ts") / 10).alias("block"), "event_type"
    ).agg(F.avg("value").alias("value"))
    out = scoring.common_set_mean(rows, ["user_id"], "block", "event_type", 5)
    return compact(out, "user_id", "event_type", "mean", "n", digits=9)


COMMON_SQL = """
WITH v AS (SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 10 AS block, event_type,
                  avg(value) AS v FROM events GROUP BY 1, 2, 3),
c AS (SELECT user_id, block FROM v GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 5)
SELECT v.user_id, event_type, round(avg(v.v), 9) AS mean, count(*) AS n
FROM v JOIN c ON c.user_id = v.user_id AND c.block = v.block GROUP BY 1, 2
"""


def means_with_missing(spark: SparkSession, sf: str) -> DataFrame:
    rows = _targets(spark, sf).select(
        (F.col("l_orderkey") % 10).alias("dataset"),
        F.when(F.col("p").isNotNull(), F.col("t")).alias("value"),
        F.coalesce(F.col("motif"), F.when(F.col("p").isNull(), "model_error")).alias("motif"),
    )
    out = scoring.mean_with_missing(rows, ["dataset"])
    listed = F.array_join(
        F.transform("missing", lambda m: F.concat(m["reason"], F.lit(":"), m["n"].cast("string"))), ","
    )
    return compact(out.withColumn("missing", listed))


MISSING_SQL = TARGETS_SQL + """,
v AS (SELECT l_orderkey % 10 AS dataset, CASE WHEN p IS NOT NULL THEN t END AS v,
             coalesce(motif, CASE WHEN p IS NULL THEN 'model_error' END) AS motif FROM t),
r AS (SELECT dataset, motif, count(*) AS n FROM v WHERE motif IS NOT NULL GROUP BY 1, 2)
SELECT v.dataset, round(avg(v), 6) AS mean, count(v) AS count,
       (SELECT string_agg(motif || ':' || n, ',' ORDER BY motif) FROM r WHERE r.dataset = v.dataset) AS missing
FROM v GROUP BY v.dataset
"""


def paired_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Two event types as windows: differences of user means, one family per weekday."""
    rows = events(spark, sf).groupBy("user_id", (day_number("ts") % 7).alias("weekday")).agg(
        F.avg(F.when(F.col("event_type") == "click", F.col("value") - 60)).alias("earlier"),
        F.avg(F.when(F.col("event_type") == "view", F.col("value") - 60)).alias("later"),
    )
    pairs = rows.filter(F.col("earlier").isNotNull() & F.col("later").isNotNull())
    out = scoring.paired_difference(
        pairs, ["weekday"], "earlier", "later", student.quantile_table(spark)
    )
    return compact(out, "weekday", "n", "mean", "low", "high", "later_better", "earlier_better", "ties")


def _t_values() -> str:
    rows = ", ".join(f"({df}, {t:.15g})" for df, t, _ in student.quantile_rows())
    return f"(VALUES {rows}) AS tq(df, t975)"


def _paired_sql() -> str:
    return f"""
WITH v AS (SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 7 AS weekday,
                  avg(CASE WHEN event_type = 'click' THEN value - 60 END) AS e,
                  avg(CASE WHEN event_type = 'view' THEN value - 60 END) AS l FROM events GROUP BY 1, 2),
a AS (SELECT CAST(weekday AS INTEGER) AS weekday, count(*) AS n, avg(l - e) AS m, stddev_samp(l - e) AS s,
             CAST(sum(CASE WHEN abs(l) < abs(e) THEN 1 ELSE 0 END) AS BIGINT) AS lb,
             CAST(sum(CASE WHEN abs(e) < abs(l) THEN 1 ELSE 0 END) AS BIGINT) AS eb,
             CAST(sum(CASE WHEN abs(e) = abs(l) THEN 1 ELSE 0 END) AS BIGINT) AS ties
      FROM v WHERE e IS NOT NULL AND l IS NOT NULL GROUP BY 1)
SELECT weekday, n, round(m, 6) AS mean, round(m - t975 * s / sqrt(n), 6) AS low,
       round(m + t975 * s / sqrt(n), 6) AS high, lb AS later_better, eb AS earlier_better, ties
FROM a LEFT JOIN {_t_values()} ON tq.df = least(n - 1, 101)
"""


def two_way_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Users as days, event types as segments, to convergence: the normal equations hold.

    Mean residuals of every day and segment and the mean day level are nil exactly where the
    fit is the least-squares one."""
    cells = events(spark, sf).groupBy("user_id", "event_type").agg(
        F.log(F.avg("value") + 1).alias("y")
    )
    levels, segments, _, certified = effects.two_way_fit(cells, [], "user_id", "event_type", "y")
    joined = cells.join(levels, "user_id").join(segments, "event_type")
    joined = joined.withColumn("r", F.col("y") - F.col("a") - F.col("c"))

    def nil(side: str, name: Column, rows: DataFrame, value: str) -> DataFrame:
        off = F.round(F.abs(F.avg(value)), 6).alias("off")
        grouped = rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("cells"), off)
        return grouped.withColumn("side", F.lit(side))

    out = (
        nil("day", F.col("user_id").cast("string"), joined, "r")
        .unionByName(nil("segment", F.col("event_type"), joined, "r"))
        .unionByName(nil("centre", F.lit("all"), levels, "c"))
    )
    return out.withColumn("certified", F.lit(certified))


TWO_WAY_SQL = """
WITH y AS (SELECT user_id AS u, event_type AS k FROM events GROUP BY 1, 2)
SELECT 'day' AS side, CAST(u AS VARCHAR) AS name, count(*) AS cells, CAST(0.0 AS DOUBLE) AS off, true AS certified FROM y GROUP BY u
UNION ALL SELECT 'segment', k, count(*), CAST(0.0 AS DOUBLE), true FROM y GROUP BY k
UNION ALL SELECT 'centre', 'all', count(DISTINCT u), CAST(0.0 AS DOUBLE), true FROM y
"""


def leave_one_day_out(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' nations as routes, months as days: held-out scores by class.

    A quarter of the cells is missing, another one each month, so that no mean is the fit."""
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    items = table(spark, sf, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    cells = items.groupBy(
        F.col("s_nationkey").alias("route"),
        F.month("l_shipdate").alias("day"),
        F.col("l_linenumber").alias("k"),
    ).agg(F.sum("l_quantity").alias("t"))
    cells = cells.filter((F.col("route") + 3 * F.col("day") + 5 * F.col("k")) % 4 != 0).withColumn(
        "klass", F.when(F.col("k") <= 3, "ascent").when(F.col("k") <= 5, "flat").otherwise("descent")
    )
    classes, _ = effects.leave_one_day_out(cells, ["route"])
    return compact(classes, "route", "fold", "klass", "n", "class_level", "class_dispersion", "motif")


def _alternating_rounds(rounds: int) -> str:
    """Rounds of alternating means for every fold: segments given days, days given segments."""
    out = "c0 AS (SELECT DISTINCT route, fold, day, CAST(0.0 AS DOUBLE) AS c FROM tr)"
    for n in range(1, rounds + 1):
        out += f""",
a{n} AS MATERIALIZED (SELECT tr.route, tr.fold, tr.k, avg(y - c) AS a
      FROM tr JOIN c{n - 1} USING (route, fold, day) GROUP BY 1, 2, 3),
c{n} AS MATERIALIZED (SELECT route, fold, day, c - avg(c) OVER (PARTITION BY route, fold) AS c FROM (
      SELECT tr.route, tr.fold, tr.day, avg(y - a) AS c
      FROM tr JOIN a{n} USING (route, fold, k) GROUP BY 1, 2, 3))"""
    return out


LODO_SQL = f"""
WITH c AS (SELECT * FROM (
    SELECT s_nationkey AS route, CAST(month(l_shipdate) AS INTEGER) AS day, l_linenumber AS k, sum(l_quantity) AS t
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)
  WHERE (route + 3 * day + 5 * k) % 4 <> 0),
f AS (SELECT DISTINCT route, day AS fold FROM c),
tr AS MATERIALIZED (SELECT c.route, fold, day, k, ln(t) AS y FROM c JOIN f ON f.route = c.route AND f.fold <> c.day),
{_alternating_rounds(30)},
p AS (SELECT c.route, c.day AS fold, c.k, c.t, exp(a) AS p,
             CASE WHEN c.k <= 3 THEN 'ascent' WHEN c.k <= 5 THEN 'flat' ELSE 'descent' END AS klass
      FROM c JOIN a30 ON a30.route = c.route AND a30.fold = c.day AND a30.k = c.k),
s AS (SELECT route, fold, klass, count(*) AS n, ln(sum(p) / sum(t)) AS cl, sum(t) AS st FROM p GROUP BY 1, 2, 3)
SELECT p.route, p.fold, p.klass, max(s.n) AS n, round(max(cl), 6) AS class_level,
       round(sum(t * abs(ln(p.p / t) - cl)) / max(st), 6) AS class_dispersion, CAST(NULL AS VARCHAR) AS motif
FROM p JOIN s ON s.route = p.route AND s.fold = p.fold AND s.klass = p.klass
GROUP BY p.route, p.fold, p.klass
"""


def drift_slope(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of a user's values on time net of one nuisance, and leave-one-out range."""
    rows = events(spark, sf).select(
        "user_id",
        (F.col("value") / 10).alias("y"),
        ((F.col("time_s") - 1704067200) / 2592000).alias("u"),
        (F.col("event_id") % 7 / 7.0).alias("f"),
    )
    fit = drift.net_slope(rows, ["user_id"], "y", "u", ["f"])
    spread = drift.slope_range(drift.withdrawals(rows, ["user_id"], "y", "u", ["f"]), ["user_id"])
    out = fit.join(spread, "user_id")
    return compact(out, "user_id", "n", "slope", "rho_u", "slope_low", "slope_high", digits=5)


DRIFT_SQL = """
WITH r AS (SELECT user_id, event_id, value / 10 AS y, (epoch_us(ts) / 1000000.0 - 1704067200) / 2592000 AS u,
                  event_id % 7 / 7.0 AS f FROM events),
m AS (SELECT user_id, count(*) AS n, sum(u) su, sum(y) sy, sum(f) sf, sum(u*u) suu, sum(u*y) suy, sum(u*f) suf,
             sum(f*f) sff, sum(f*y) sfy FROM r GROUP BY user_id),
c AS (SELECT user_id, n, suu - su*su/n AS uu, suy - su*sy/n AS uy, suf - su*sf/n AS uf, sff - sf*sf/n AS ff,
             sfy - sf*sy/n AS fy FROM m),
l AS (SELECT r.user_id, n - 1 AS n, suu-u*u su2, suy-u*y suy2, suf-u*f suf2, sff-f*f sff2, sfy-f*y sfy2,
             su-u su1, sy-y sy1, sf-f sf1 FROM r JOIN m ON m.user_id = r.user_id),
d AS (SELECT user_id, su2 - su1*su1/n AS uu, suy2 - su1*sy1/n AS uy, suf2 - su1*sf1/n AS uf, sff2 - sf1*sf1/n AS ff,
             sfy2 - sf1*sy1/n AS fy FROM l),
g AS (SELECT user_id, min((uy - uf*fy/ff) / (uu - uf*uf/ff)) AS lo, max((uy - uf*fy/ff) / (uu - uf*uf/ff)) AS hi
      FROM d GROUP BY user_id)
SELECT c.user_id, n, round((uy - uf*fy/ff) / (uu - uf*uf/ff), 5) AS slope, round((uu - uf*uf/ff) / uu, 5) AS rho_u,
       round(lo, 5) AS slope_low, round(hi, 5) AS slope_high
FROM c JOIN g ON g.user_id = c.user_id
"""


def clock_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Level of each supplier under three clocks (whole, less a fifth, less a third)."""
    rows = _segments(spark, sf).withColumn(
        "times",
        F.array(F.col("t"), F.col("t") * 0.8, F.col("t") * (F.lit(2.0) / 3)),
    ).drop("t")
    out = scoring.support_scores(
        scoring.explode_clocks(rows).filter(F.col("p").isNotNull()), ["l_suppkey", "clock"]
    ).overall
    return compact(out, "l_suppkey", "clock", "n", "log_ratio", "level_motif")


CLOCK_SQL = SEGMENTS_SQL + """,
c AS (SELECT * FROM (VALUES (0, 1.0), (1, 0.8), (2, 2.0 / 3)) v(clock, share))
SELECT l_suppkey, CAST(clock AS INTEGER) AS clock, count(*) AS n, round(ln(sum(p) / sum(t * share)), 6) AS log_ratio,
       CAST(NULL AS VARCHAR) AS level_motif
FROM s CROSS JOIN c WHERE p IS NOT NULL GROUP BY l_suppkey, clock
"""


def geometry_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.col("l_linestatus").alias("klass"),
        F.col("l_quantity").alias("p_usage"),
        (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("p_control"),
    )
    out = scoring.geometry_gap(rows, SUPPLIER)
    return compact(out.fillna("all", ["klass"]))


GEOMETRY_SQL = """
SELECT l_suppkey, coalesce(l_linestatus, 'all') AS klass,
       round(ln(sum(l_quantity) / sum(l_quantity * (1 + l_tax))), 6) AS gap
FROM lineitem GROUP BY GROUPING SETS ((l_suppkey), (l_suppkey, l_linestatus))
"""


def window_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses as windows of a customer: covered under all, and beyond with a curve."""
    rows = table(spark, sf, "orders").groupBy(
        "o_custkey", F.col("o_orderstatus").alias("window")
    ).agg((F.max("o_totalprice") / 500000).alias("share"), F.count(F.lit(1)).alias("n"))
    sets = scoring.window_sets(rows, 0.75, 0.9).withColumn("has_curve", F.col("n") > 2)
    all_ = scoring.covered_under_all(sets, CUSTOMER, 3).withColumn("kind", F.lit("covered"))
    pair = scoring.pair_beyond(sets, CUSTOMER, F.lit("F"), F.lit("O")).withColumn(
        "kind", F.lit("pair")
    )
    return all_.unionByName(pair)


WINDOW_SQL = """
WITH w AS (SELECT o_custkey, o_orderstatus AS window_, max(o_totalprice) / 500000 AS share, count(*) AS n
           FROM orders GROUP BY 1, 2)
SELECT o_custkey, 'covered' AS kind FROM w WHERE share <= 0.75 GROUP BY 1 HAVING count(DISTINCT window_) = 3
UNION ALL
(SELECT o_custkey, 'pair' FROM w WHERE share > 0.9 AND window_ = 'F'
 INTERSECT SELECT o_custkey, 'pair' FROM w WHERE n > 2 AND window_ = 'O')
"""


def comparable_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Leading admitted line items of each order and the total up to there."""
    rows = _targets(spark, sf).withColumn("ok", F.col("t").isNotNull() & F.col("p").isNotNull())
    sums = ordered.running(
        rows,
        ["l_orderkey"],
        ["k"],
        {"fails": ("sum", F.when(F.col("ok"), 0).otherwise(1)), "total": ("sum", F.col("t"))},
    )
    out = sums.filter(F.col("fails") == 0).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("prefix"), F.max("total").alias("total")
    )
    return compact(out)


PREFIX_SQL = TARGETS_SQL + """,
r AS (SELECT *, sum(CASE WHEN t IS NULL OR p IS NULL THEN 1 ELSE 0 END)
                  OVER (PARTITION BY l_orderkey ORDER BY k) AS fails,
             sum(t) OVER (PARTITION BY l_orderkey ORDER BY k) AS total FROM t)
SELECT l_orderkey, count(*) AS prefix, round(max(total), 6) AS total FROM r WHERE fails = 0 GROUP BY l_orderkey
"""


def sensitivity_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' items as segments under nineteen configurations: wide tolerances lose a tenth of
    the parts, clocks shorten the times; counts of values lost, gained and moved."""
    pairs = [(step, tolerance) for step in sensitivity.STEPS_M for tolerance in sensitivity.TOLERANCES_M]
    rules = F.array(*(F.struct(F.lit(a).alias("step_m"), F.lit(b).alias("tolerance_m")) for a, b in pairs))
    items = table(spark, sf, "lineitem").select(
        "l_suppkey",
        "l_returnflag",
        "l_extendedprice",
        "l_quantity",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
        ((F.col("l_partkey") % 10 == 3) | (F.col("l_suppkey") % 23 == 5)).alias("narrow"),
    )
    # Dealt before the pairs are laid out: what moves is a row an item, not one a pair or clock.
    items, deal = ordered.deal(items, SUPPLIER, "k")
    paired = items.select("*", F.inline(rules))
    lost = (F.col("tolerance_m") > 40) & F.col("narrow")
    clocks = F.array(*(F.col("l_quantity") * (1 - 0.01 * c) for c in range(sensitivity.CLOCKS)))
    forecast = paired.filter(~lost).select(
        *deal.by,
        F.lit("m").alias("model"),
        "step_m",
        "tolerance_m",
        "k",
        F.col("l_returnflag").alias("klass"),
        (F.col("l_extendedprice") / 1000 * (1 + F.col("step_m") / 1e5)).alias("p"),
        clocks.alias("times"),
    )
    values = sensitivity.configured_scores(forecast, SUPPLIER, deal=deal)
    _, counts = sensitivity.comparisons(values, [*SUPPLIER, "model"])
    return compact(counts)


SENSITIVITY_SQL = """
WITH c AS (SELECT CAST(n AS INTEGER) AS c, CASE WHEN n < 9 THEN CASE n // 3 WHEN 0 THEN 100 WHEN 1 THEN 250 ELSE 500 END ELSE 250 END AS step,
                  CASE WHEN n < 9 THEN 15 * (n % 3 + 1) ELSE 30 END AS tol, CASE WHEN n < 9 THEN 0 ELSE n - 8 END AS clock
           FROM (SELECT unnest(range(0, 19)) AS n)),
s AS (SELECT c, l_suppkey AS o, l_returnflag AS k, l_extendedprice / 1000 * (1 + step / 1e5) AS p, l_quantity * (1 - 0.01 * clock) AS t
      FROM lineitem, c WHERE NOT (tol > 40 AND (l_partkey % 10 = 3 OR l_suppkey % 23 = 5))),
n AS (SELECT c, o, count(*) AS n, ln(sum(p) / sum(t)) AS l FROM s GROUP BY 1, 2),
k AS (SELECT c, o, k, ln(sum(p) / sum(t)) AS l, sum(t) AS t FROM s GROUP BY 1, 2, 3),
d AS (SELECT s.c, s.o, s.k, sum(s.t * abs(ln(s.p / s.t) - k.l)) / max(k.t) AS d FROM s JOIN k ON k.c = s.c AND k.o = s.o AND k.k = s.k GROUP BY 1, 2, 3),
v AS (SELECT c, o, 'level' AS metric, l AS v FROM n UNION ALL SELECT c, o, k || '_level', l FROM k UNION ALL SELECT c, o, k || '_dispersion', d FROM d),
x AS (SELECT v.c, v.metric, v.v, n.n, b.v AS bv, m.n AS bn FROM v JOIN n ON n.c = v.c AND n.o = v.o
      LEFT JOIN v b ON b.c = 4 AND b.o = v.o AND b.metric = v.metric LEFT JOIN n m ON m.c = 4 AND m.o = v.o)
SELECT c AS configuration, metric, count(*) FILTER (bv IS NOT NULL) AS "both", 0 AS lost, count(*) FILTER (bv IS NULL) AS gained, 0 AS neither,
       count(*) FILTER (n IS DISTINCT FROM bn) AS support_changed, round(max(abs(v - bv)), 6) AS largest_difference
FROM x GROUP BY 1, 2
"""


CHECKS = {
    "sensitivity_scores": Check(sensitivity_scores, SENSITIVITY_SQL),
    "support_metrics": Check(
        support_metrics, SEGMENTS_SQL + SCORED_SQL.format(src="s") + OVERALL_SELECT
    ),
    "class_metrics": Check(class_metrics, CLASS_SQL),
    "positive_time_metrics": Check(positive_time_metrics, POSITIVE_SQL),
    "ratio_envelope": Check(ratio_envelope, ENVELOPE_SQL),
    "usage_target": Check(usage_target, USAGE_SQL),
    "passage_errors": Check(passage_errors, PASSAGE_SQL),
    "segment_gaps": Check(segment_gaps, GAPS_SQL),
    "calibration_beta": Check(calibration_beta, BETA_SQL),
    "band_quantiles": Check(band_quantiles, BAND_SQL),
    "bands_interval_score": Check(bands_interval_score, SCORE_SQL),
    "common_set_means": Check(common_set_means, COMMON_SQL),
    "means_with_missing": Check(means_with_missing, MISSING_SQL),
    "paired_difference": Check(paired_difference, _paired_sql()),
    "two_way_fit": Check(two_way_fit, TWO_WAY_SQL),
    "leave_one_day_out": Check(leave_one_day_out, LODO_SQL),
    "drift_slope": Check(drift_slope, DRIFT_SQL),
    "clock_scores": Check(clock_scores, CLOCK_SQL),
    "geometry_gap": Check(geometry_gap, GEOMETRY_SQL),
    "window_sets": Check(window_sets, WINDOW_SQL),
    "comparable_prefix": Check(comparable_prefix, PREFIX_SQL),
}
