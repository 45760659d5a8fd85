"""Trends, robust and clustered inference, families of tests, routes and log checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeflow.catalog import Check
from ridgeflow.operators import effects, experiments, ordered, panel, trend
from ridgeflow.plans import experiment, sensitivity
from ridgeflow.plans.backtest import Effect
from ridgeflow.session import shared_folder
from ridgeflow.tables import compact, day_number, events, table


def within_group_ols(spark: SparkSession, sf: str) -> DataFrame:
    """Price on quantity with one level per supplier."""
    fit = trend.within_groups(
        table(spark, sf, "lineitem"), "l_suppkey", ["l_quantity", "l_discount"], "l_extendedprice"
    )
    out = fit.groups.select("l_suppkey", "n", "level", "level_var")
    for name, slope in fit.slopes.items():
        out = out.withColumn(f"slope_{name}", F.lit(slope))
    return compact(out, digits=3)


WITHIN_SQL = """
WITH c AS (SELECT l_suppkey, l_quantity - avg(l_quantity) OVER w AS q, l_discount - avg(l_discount) OVER w AS d,
                  l_extendedprice - avg(l_extendedprice) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
m AS (SELECT sum(q*q) AS a, sum(q*d) AS b, sum(d*d) AS c, sum(q*y) AS e, sum(d*y) AS f, sum(y*y) AS g, count(*) AS n,
             count(DISTINCT l_suppkey) AS k FROM c),
s AS (SELECT (c*e - b*f) / (a*c - b*b) AS s1, (a*f - b*e) / (a*c - b*b) AS s2, g, e, f, n, k FROM m),
v AS (SELECT *, (g - s1*e - s2*f) / (n - k - 2) AS scale FROM s)
SELECT l_suppkey, count(*) AS n, round(avg(l_extendedprice) - max(s1) * avg(l_quantity) - max(s2) * avg(l_discount), 3) AS level,
       round(max(scale) / count(*), 3) AS level_var, round(max(s1), 3) AS slope_l_quantity, round(max(s2), 3) AS slope_l_discount
FROM lineitem CROSS JOIN v GROUP BY l_suppkey
"""


def ols_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Log order price on years and priority, with standard errors, one row per column."""
    orders = table(spark, sf, "orders").select(
        F.log("o_totalprice").alias("y"),
        F.lit(1.0).alias("one"),
        ((day_number("o_orderdate") - 10000) / 365.25).alias("years"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0).alias("urgent"),
    )
    fit = trend.ols(orders, ["one", "years", "urgent"], "y")
    rows = [
        (c, float(fit.coef[i]), float(fit.cov[i, i] ** 0.5), fit.df)
        for i, c in enumerate(fit.columns)
    ]
    return compact(spark.createDataFrame(rows, "term string, coef double, se double, df long"))


TREND_SQL = """
WITH r AS (SELECT ln(o_totalprice) AS y, (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) - 10000) / 365.25 AS x,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END AS u FROM orders),
m AS (SELECT count(*) AS n, avg(x) AS mx, avg(u) AS mu, avg(y) AS my FROM r),
c AS (SELECT n, mx, mu, my, sum((x-mx)*(x-mx)) AS a, sum((x-mx)*(u-mu)) AS b, sum((u-mu)*(u-mu)) AS c,
             sum((x-mx)*(y-my)) AS e, sum((u-mu)*(y-my)) AS f, sum((y-my)*(y-my)) AS g FROM r CROSS JOIN m GROUP BY ALL),
s AS (SELECT *, (c*e - b*f) / (a*c - b*b) AS s1, (a*f - b*e) / (a*c - b*b) AS s2 FROM c),
v AS (SELECT *, (g - s1*e - s2*f) / (n - 3) AS sc FROM s)
SELECT 'one' AS term, round(my - s1*mx - s2*mu, 6) AS coef,
       round(sqrt(sc * (1.0/n + (mx*mx*c - 2*mx*mu*b + mu*mu*a) / (a*c - b*b))), 6) AS se, n - 3 AS df FROM v
UNION ALL SELECT 'years', round(s1, 6), round(sqrt(sc * c / (a*c - b*b)), 6), n - 3 FROM v
UNION ALL SELECT 'urgent', round(s2, 6), round(sqrt(sc * a / (a*c - b*b)), 6), n - 3 FROM v
"""


def group_slopes(spark: SparkSession, sf: str) -> DataFrame:
    """Trend of each customer's log order prices as a fraction per year."""
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.log("o_totalprice").alias("y"), day_number("o_orderdate").cast("double").alias("x")
    )
    out = trend.slope_by_group(orders, ["o_custkey"], "x", "y").filter(F.col("n") > 2)
    return compact(
        out.withColumn("per_year", trend.fraction_per_year(F.col("slope"))).filter(
            F.col("slope").isNotNull()
        ),
        "o_custkey",
        "n",
        "slope",
        "per_year",
        digits=7,
    )


SLOPE_SQL = """
WITH r AS (SELECT o_custkey, ln(o_totalprice) AS y,
                  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x FROM orders),
s AS (SELECT o_custkey, count(*) AS n, regr_slope(y, x) AS s FROM r GROUP BY 1 HAVING count(*) > 2)
SELECT o_custkey, n, round(s, 7) AS slope, round(exp(365.25 * s) - 1, 7) AS per_year FROM s WHERE s IS NOT NULL
"""


def cr2_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Bias-reduced cluster variance of one centred slope, clusters = suppliers."""
    items = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    means = items.agg(F.avg("l_quantity").alias("mx"), F.avg("l_extendedprice").alias("my"))
    rows = items.crossJoin(F.broadcast(means)).select(  # one row
        "l_suppkey",
        (F.col("l_quantity") - F.col("mx")).alias("x"),
        (F.col("l_extendedprice") - F.col("my")).alias("y"),
    )
    fit = trend.ols(rows, ["x"], "y")
    residual = rows.withColumn("r", F.col("y") - fit.prediction())
    return compact(trend.cr2_slope(residual, "x", "r", "l_suppkey").withColumn("slope", F.lit(float(fit.coef[0]))), digits=4)


CR2_SQL = """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
r AS (SELECT l_suppkey, l_quantity - mx AS x, l_extendedprice - my AS y FROM lineitem CROSS JOIN m),
b AS (SELECT sum(x*y) / sum(x*x) AS s, sum(x*x) AS a FROM r),
g AS (SELECT l_suppkey, sum(x*x) AS sg, sum(x * (y - s*x)) AS bg, max(a) AS a, max(s) AS s FROM r CROSS JOIN b GROUP BY 1)
SELECT round(sum(bg*bg / (1 - sg/a)) / pow(max(a), 2), 4) AS cr2_var, count(*) AS clusters, round(max(s), 4) AS slope FROM g
"""


def lag_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelation of each user's values by class of day lag."""
    rows = events(spark, sf).select("user_id", day_number("ts").alias("day"), "value")
    out = trend.lag_autocorrelation(
        rows, ["user_id"], "day", "value", [(1, 2), (3, 7), (8, 14), (15, None)]
    ).withColumn("lag_high", F.coalesce("lag_high", F.lit(-1)))
    return compact(out, "user_id", "lag_low", "lag_high", "pairs", "correlation")


LAG_SQL = """
WITH r AS (SELECT user_id, event_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d,
                  value - avg(value) OVER (PARTITION BY user_id) AS e FROM events),
v AS (SELECT user_id, sum(e*e) / count(*) AS s2 FROM r GROUP BY 1),
c AS (SELECT * FROM (VALUES (1, 2), (3, 7), (8, 14), (15, -1)) t(lo, hi)),
p AS (SELECT a.user_id, lo, hi, count(*) AS k, sum(a.e * b.e) AS s
      FROM r a JOIN r b ON b.user_id = a.user_id AND b.d > a.d JOIN c ON b.d - a.d >= lo AND (hi = -1 OR b.d - a.d <= hi)
      GROUP BY 1, 2, 3)
SELECT v.user_id, CAST(c.lo AS INTEGER) AS lag_low, CAST(c.hi AS INTEGER) AS lag_high, coalesce(k, 0) AS pairs,
       round(s / (k * s2), 6) AS correlation
FROM v CROSS JOIN c LEFT JOIN p ON p.user_id = v.user_id AND p.lo = c.lo
"""


def holm(spark: SparkSession, sf: str) -> DataFrame:
    """Holm decisions over each nation's customers, p-values from their balances."""
    tests = table(spark, sf, "customer").select(
        "c_nationkey", "c_custkey", ((F.col("c_custkey") * 37 + 11) % 10007 / 10007.0).alias("p")
    )
    small = tests.withColumn("p", F.pow("p", 4))
    return trend.holm(small, ["c_nationkey"], "p", "c_custkey", 0.05).select(
        "c_nationkey", "c_custkey", "rejected"
    )


HOLM_SQL = """
WITH t AS (SELECT c_nationkey, c_custkey, pow((c_custkey * 37 + 11) % 10007 / 10007.0, 4) AS p FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS k,
             count(*) OVER (PARTITION BY c_nationkey) AS m FROM t),
f AS (SELECT *, max(CASE WHEN p > 0.05 / (m - k + 1) THEN 1 ELSE 0 END)
                OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS failed FROM r)
SELECT c_nationkey, c_custkey, failed = 0 AS rejected FROM f
"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Reading of the intervals of each customer's balances around their segment."""
    rows = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n")
    )
    low = (F.col("m") - 250000) / 100000 - 1 / F.sqrt("n")
    high = (F.col("m") - 250000) / 100000 + 1 / F.sqrt("n")
    return rows.groupBy("o_custkey").agg(
        trend.direction(low, high).alias("direction"), trend.reading(low, high, 2.0).alias("reading")
    )


READING_SQL = """
WITH r AS (SELECT o_custkey, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus),
i AS (SELECT o_custkey, (m - 250000) / 100000 - 1 / sqrt(n) AS lo, (m - 250000) / 100000 + 1 / sqrt(n) AS hi FROM r),
d AS (SELECT o_custkey, CASE WHEN min(lo) > 0 THEN 1 WHEN max(hi) < 0 THEN -1 ELSE 0 END AS direction,
             min(lo) > -2 AND max(hi) < 2 AS inside FROM i GROUP BY 1)
SELECT o_custkey, CAST(direction AS INTEGER) AS direction,
       CASE WHEN direction <> 0 THEN 'established' WHEN inside THEN 'no_useful_effect' ELSE 'undecided' END AS reading
FROM d
"""


def power_table(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as simulated outcomes: effect from the discount, reading from prices."""
    rows = table(spark, sf, "lineitem").select(
        (F.round(F.col("l_discount") * 100) - 5).alias("b"),
        ((F.col("l_extendedprice") - 45000) / 5000).alias("estimate"),
    )
    big = F.abs("estimate") > 4
    outcomes = rows.withColumn(
        "reading",
        F.when(big, "established").when(F.abs("estimate") < 1, "no_useful_effect").otherwise("undecided"),
    ).withColumn("direction", F.when(big, F.signum("estimate").cast("int")).otherwise(0))
    return compact(trend.power_table(outcomes))


POWER_SQL = """
WITH r AS (SELECT round(l_discount * 100) - 5 AS b, (l_extendedprice - 45000) / 5000 AS e FROM lineitem)
SELECT b, count(*) AS n_draws, round(avg(CASE WHEN abs(e) > 4 THEN 1.0 ELSE 0 END), 6) AS p_established,
       round(avg(CASE WHEN abs(e) < 1 THEN 1.0 ELSE 0 END), 6) AS p_no_useful_effect,
       round(sqrt(avg(CASE WHEN abs(e) > 4 THEN 1.0 ELSE 0 END) * (1 - avg(CASE WHEN abs(e) > 4 THEN 1.0 ELSE 0 END)) / count(*)), 6) AS mc_se,
       round(CASE WHEN b <> 0 THEN avg(CASE WHEN abs(e) > 4 AND sign(e) = sign(b) THEN 1.0 ELSE 0 END) END, 6) AS power,
       round(CASE WHEN b <> 0 THEN sum(CASE WHEN abs(e) > 4 AND sign(e) = -sign(b) THEN 1.0 ELSE 0 END)
                                   / sum(CASE WHEN abs(e) > 4 THEN 1 ELSE 0 END) END, 6) AS s_error,
       round(CASE WHEN b <> 0 THEN avg(CASE WHEN abs(e) > 4 THEN abs(e) / abs(b) END) END, 6) AS m_error
FROM r GROUP BY b
"""


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as climbs at derived coordinates of their nation."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_nationkey",
        key.alias("climb_id"),
        (key % 23).alias("day_no"),
        F.expr("date_add(DATE '2024-01-01', CAST(c_custkey % 23 AS INT))").alias("day"),
        key.cast("double").alias("start_s"),
        (100 + key * 7 % 60).cast("double").alias("gain_m"),
        (45 + key * 13 % 29 * 0.0008).alias("start_lat"),
        (6 + key * 5 % 17 * 0.0009).alias("start_lon"),
        (45.01 + key * 13 % 29 * 0.0008).alias("end_lat"),
        (6.01 + key * 5 % 17 * 0.0009).alias("end_lon"),
        F.lit(True).alias("in_sample"),
    )


def route_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = panel.route_groups(_places(spark, sf), ["c_nationkey"])
    shown = out.withColumn("route", F.coalesce("route", F.lit(-1)).cast("long"))
    return compact(shown, "c_nationkey", "day", "component", "route")


ROUTE_SQL = """
WITH RECURSIVE p AS (
  SELECT c_nationkey AS n, c_custkey AS id, DATE '2024-01-01' + CAST(c_custkey % 23 AS INTEGER) AS day,
         CAST(100 + c_custkey * 7 % 60 AS DOUBLE) AS g, 45 + c_custkey * 13 % 29 * 0.0008 AS la,
         6 + c_custkey * 5 % 17 * 0.0009 AS lo FROM customer),
l AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.n = b.n AND a.id <> b.id
      AND greatest(a.g, b.g) / least(a.g, b.g) <= 1.1
      AND 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la))
          * pow(sin(radians(b.lo - a.lo) / 2), 2))) < 100
      AND 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la + 0.01)) * cos(radians(b.la + 0.01))
          * pow(sin(radians(b.lo - a.lo) / 2), 2))) < 100),
reach(id, c) AS (SELECT id, id FROM p UNION SELECT l.y, reach.c FROM reach JOIN l ON l.x = reach.id),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
t AS (SELECT p.*, row_number() OVER (PARTITION BY n, day ORDER BY g DESC, id) AS k FROM p),
d AS (SELECT n, day, c FROM t JOIN comp ON comp.id = t.id WHERE k = 1),
s AS (SELECT n, c, min(day) AS f FROM d GROUP BY 1, 2 HAVING count(*) > 1),
m AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY f, c) - 1 AS route FROM s)
SELECT d.n AS c_nationkey, CAST(d.day AS VARCHAR) AS day, d.c AS component, coalesce(m.route, -1) AS route
FROM d LEFT JOIN m ON m.n = d.n AND m.c = d.c
"""


def principal_device(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_custkey",
        F.col("o_orderstatus").alias("manufacturer"),
        F.col("o_orderpriority").alias("product"),
        F.col("o_orderdate").cast("date").alias("day"),
    )
    out = panel.principal_device(rows, ["o_custkey"])
    return out.select("o_custkey", "device.manufacturer", "device.product", "days", "tied")


DEVICE_SQL = """
WITH c AS (SELECT o_custkey, o_orderstatus AS m, o_orderpriority AS p, count(DISTINCT CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1, 2, 3),
b AS (SELECT *, max(d) OVER (PARTITION BY o_custkey) AS best FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY m, p) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM b WHERE d = best)
SELECT o_custkey, m AS manufacturer, p AS product, d AS days, n > 1 AS tied FROM k WHERE r = 1
"""


def chain_check(spark: SparkSession, sf: str) -> DataFrame:
    """Order events of a customer as a chained log, with every twentieth link broken."""
    order = ["o_custkey"]
    rows = ordered.running(
        table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"),
        order,
        ["o_orderkey"],
        {"number": ("sum", F.lit(1))},
    )
    payload = ["o_custkey", "number", "o_orderkey", "o_orderstatus"]
    hashed = experiments.with_line_hash(rows, payload)
    chained = ordered.shift(hashed, order, ["number"], {"before": F.col("line_sha256")})
    log = chained.withColumn(
        "previous_sha256",
        F.when(F.col("o_orderkey") % 20 == 7, F.lit("broken")).otherwise(
            F.coalesce("before", F.lit(""))
        ),
    ).drop("line_sha256", "before")
    out = experiments.chain_violations(log, order, payload)
    return out.select("o_custkey", F.col("number").cast("long").alias("number"), "reason", F.substring("line_sha256", 1, 16).alias("line"))


CHAIN_SQL = """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, n AS number, 'hash' AS reason,
       substr(sha256(o_custkey || '|' || n || '|' || o_orderkey || '|' || o_orderstatus), 1, 16) AS line
FROM r WHERE o_orderkey % 20 = 7
"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("event_id")
    return events(spark, sf).select(
        "user_id",
        key.alias("number"),
        F.when(key % 3 == 0, "result").otherwise("declaration").alias("kind"),
        F.when(key % 7 == 2, key - 1).alias("corrects"),
        (key % 5 == 1).alias("is_sensitivity"),
        F.when(key % 2 == 0, F.col("event_type")).alias("effect"),
        F.when(key % 4 == 0, "usage").otherwise("level").alias("target"),
    )


def trial_counts(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.trial_counts(_log(spark, sf), ["user_id"])


TRIAL_SQL = """
SELECT user_id, count(*) AS declarations, CAST(sum(CASE WHEN event_id % 7 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS corrections,
       CAST(sum(CASE WHEN event_id % 5 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS sensitivities,
       CAST(sum(CASE WHEN event_id % 5 <> 1 AND event_id % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS without_effect
FROM events WHERE event_id % 3 <> 0 GROUP BY user_id
"""


def trials_by_effect(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.trials_by_effect(_log(spark, sf))


EFFECT_SQL = """
SELECT event_type AS effect, CASE WHEN event_id % 4 = 0 THEN 'usage' ELSE 'level' END AS target, count(*) AS trials
FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 1 AND event_id % 2 = 0 GROUP BY 1, 2
"""


def sensitivity_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers as configurations of a supplier, compared with the first."""
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linenumber").agg(
        F.when(F.max("l_discount") < 0.0999, F.avg("l_quantity")).alias("value"),
        F.count(F.lit(1)).alias("signature"),
    )
    base = rows.filter(F.col("l_linenumber") == 1).drop("l_linenumber")
    others = rows.filter(F.col("l_linenumber") > 1)
    compared = experiments.compare_values(others, base, ["l_suppkey", "l_returnflag"])
    return compact(experiments.axis_counts(compared, ["l_linenumber"]))


AXES_SQL = """
WITH r AS (SELECT l_suppkey AS s, l_returnflag AS f, l_linenumber AS k, CASE WHEN max(l_discount) < 0.0999 THEN avg(l_quantity) END AS v,
                  count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
j AS (SELECT r.k, r.v, b.v AS bv, r.n IS DISTINCT FROM b.n AS ch FROM r LEFT JOIN r b ON b.k = 1 AND b.s = r.s AND b.f = r.f WHERE r.k > 1)
SELECT k AS l_linenumber, CAST(sum(CASE WHEN v IS NOT NULL AND bv IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both,
       CAST(sum(CASE WHEN v IS NULL AND bv IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS lost,
       CAST(sum(CASE WHEN v IS NOT NULL AND bv IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS gained,
       CAST(sum(CASE WHEN v IS NULL AND bv IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS neither,
       CAST(sum(CASE WHEN ch THEN 1 ELSE 0 END) AS BIGINT) AS support_changed,
       round(max(abs(v - bv)), 6) AS largest_difference
FROM j GROUP BY k
"""


def admission_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as experiments: gains from prices, guards from taxes by line number."""
    items = table(spark, sf, "lineitem")
    assess = items.groupBy("l_suppkey", (F.col("l_orderkey") % 12).alias("performance")).agg(
        ((F.avg("l_extendedprice") - 37000) / 100000).alias("gain"),
        (F.avg("l_discount") / 4).alias("reference"),
        F.count(F.lit(1)).alias("n"),
    )
    assess = assess.withColumn("threshold", experiments.gain_threshold(F.col("reference"))).withColumn(
        "motif", F.when(F.col("performance") == 11, "unlabelled")
    )
    assess = assess.withColumn("gain", F.when(F.col("l_suppkey") % 9 != 4, F.col("gain")))
    guards = items.groupBy("l_suppkey", F.col("l_returnflag").alias("metric"), "l_linenumber").agg(
        ((F.avg("l_tax") - 0.04) / 2).alias("harm"), F.lit(0.005).alias("threshold")
    )
    out = experiments.admit(assess, guards, ["l_suppkey"])
    return compact(
        out.withColumn("required", F.col("required").cast("long")),
        "l_suppkey", "evaluable", "gains", "positive", "losses", "required", "mean_gain", "guards_broken", "verdict",
    )


VERDICT_SQL = """
WITH a AS (SELECT l_suppkey AS s, l_orderkey % 12 AS p, CASE WHEN l_suppkey % 9 <> 4 THEN (avg(l_extendedprice) - 37000) / 100000 END AS g,
                  greatest(0.01, 0.25 * (avg(l_discount) / 4)) AS th FROM lineitem GROUP BY 1, 2),
e AS (SELECT s, count(*) AS n, count(g) AS k, avg(g) AS mg, avg(th) AS mt,
             CAST(sum(CASE WHEN g > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
             CAST(sum(CASE WHEN g < -th - 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS loss
      FROM a WHERE p <> 11 GROUP BY s),
h AS (SELECT l_suppkey AS s, l_returnflag AS m, l_linenumber AS k, (avg(l_tax) - 0.04) / 2 AS harm FROM lineitem GROUP BY 1, 2, 3),
b AS (SELECT s, m, avg(harm) > 0.005 + 1e-6 OR bool_or(harm > 0.01 + 1e-6) AS broken FROM h GROUP BY 1, 2),
g AS (SELECT s, CAST(sum(CASE WHEN broken THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM b GROUP BY 1)
SELECT e.s AS l_suppkey, n AS evaluable, k AS gains, pos AS positive, loss AS losses, (3 * n + 3) // 4 AS required,
       round(CASE WHEN k = n THEN mg END, 6) AS mean_gain, broken AS guards_broken,
       CASE WHEN k < n THEN 'to_review' WHEN mg < mt - 1e-6 OR pos < (3 * n + 3) // 4 OR loss > 0 OR broken > 0 THEN 'rejected'
            ELSE 'provisional' END AS verdict
FROM e JOIN g ON g.s = e.s
"""


def huber_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Robust trend of line prices on quantity; one price in eleven is an outlier."""
    far = F.when(F.col("l_partkey") % 11 == 3, 9.0).otherwise(1.0)
    items = table(spark, sf, "lineitem").select(
        F.lit(1.0).alias("one"), "l_quantity", (far * F.col("l_extendedprice") / 1000).alias("y")
    )
    fit, scale, _ = trend.huber(items, ["one", "l_quantity"], "y", tolerance=1e-9)
    rows = [(c, float(b), scale) for c, b in zip(fit.columns, fit.coef, strict=True)]
    return compact(spark.createDataFrame(rows, "term string, coef double, scale double"), digits=5)


def _huber_rounds(rounds: int) -> str:
    """Reweighted least squares, unrolled: coefficients, then the scale of their residuals."""
    fit = "(sw * sxy - sx * sy) / (sw * sxx - sx * sx)"
    out = ""
    for n in range(rounds + 1):
        size = "abs(y - b0 - b1 * x) / scale"
        weight = "1.0" if n == 0 else f"CASE WHEN {size} > 1.345 THEN 1.345 / ({size}) ELSE 1.0 END"
        given = "i" if n == 0 else f"i, h{n - 1}"
        out += f""",
m{n} AS MATERIALIZED (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
      FROM (SELECT x, y, {weight} AS w FROM {given})),
f{n} AS MATERIALIZED (SELECT (sy - ({fit}) * sx) / sw AS b0, {fit} AS b1 FROM m{n}),
h{n} AS MATERIALIZED (SELECT max(b0) AS b0, max(b1) AS b1, median(abs(y - b0 - b1 * x)) / 0.6744897501960817 AS scale FROM i, f{n})"""
    return out


HUBER_SQL = f"""
WITH i AS MATERIALIZED (SELECT l_quantity AS x, CASE WHEN l_partkey % 11 = 3 THEN 9.0 ELSE 1.0 END * l_extendedprice / 1000 AS y FROM lineitem)
{_huber_rounds(60)}
SELECT 'one' AS term, round(b0, 5) AS coef, round(scale, 5) AS scale FROM h60
UNION ALL SELECT 'l_quantity', round(b1, 5), round(scale, 5) FROM h60
"""


def wild_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Wild cluster interval of the quantity slope, clusters = suppliers."""
    items = table(spark, sf, "lineitem").select(
        "l_suppkey", F.lit(1.0).alias("one"), "l_quantity", F.col("l_extendedprice").alias("y")
    )
    fit = trend.ols(items, ["one", "l_quantity"], "y")
    low, high = trend.wild_cluster_interval(items, fit, "y", "l_suppkey", 1, 0.95, 199, 7)
    return spark.createDataFrame([(low, float(fit.coef[1]), high)], "low double, coef double, high double")


BAND_DRAWS, BAND_SEED, BAND_LEVEL = 150, 11, 0.9


def max_t_band(spark: SparkSession, sf: str) -> DataFrame:
    """Simultaneous band of supplier means from hash-signed residual draws."""
    items = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("row_key"),
        F.col("l_extendedprice").alias("y"),
    )
    estimate = items.groupBy(F.col("l_suppkey").alias("x")).agg(F.avg("y").alias("estimate"))
    fitted = items.join(estimate, items["l_suppkey"] == estimate["x"]).withColumn(
        "r", F.col("y") - F.col("estimate")
    )
    curves = trend.signed_means(fitted, "x", "estimate", "r", "row_key", BAND_DRAWS, BAND_SEED)
    return compact(trend.max_t_band(estimate, curves, BAND_LEVEL), digits=4)


BAND_SQL = f"""
WITH e AS (SELECT l_suppkey AS x, avg(l_extendedprice) AS estimate, count(*) AS n FROM lineitem GROUP BY 1),
m AS (SELECT l_suppkey AS x, l_extendedprice AS y, k.n AS block,
             md5('{BAND_SEED}:' || k.n || ':' || l_orderkey || '-' || l_partkey || '-' || l_linenumber) AS digest
      FROM lineitem, (SELECT unnest(range(0, {-(-BAND_DRAWS // 128)})) AS n) k),
s AS (SELECT m.x, 128 * m.block + d.n + 1 AS b, y,
             (CAST('0x' || substr(digest, CAST(d.n // 4 + 1 AS INTEGER), 1) AS INTEGER) >> CAST(3 - d.n % 4 AS INTEGER)) & 1 AS minus
      FROM m, (SELECT unnest(range(0, 128)) AS n) d WHERE 128 * m.block + d.n < {BAND_DRAWS}),
v AS (SELECT s.b, s.x, max(e.estimate) AS estimate, max(e.estimate) + avg((1 - 2 * minus) * (y - e.estimate)) AS value
      FROM s JOIN e USING (x) GROUP BY 1, 2),
p AS (SELECT x, stddev_samp(value) AS s FROM v GROUP BY 1),
t AS (SELECT b, max(abs(value - estimate) / p.s) AS t FROM v JOIN p USING (x) WHERE p.s > 0 GROUP BY 1),
c AS (SELECT t AS critical FROM (SELECT t, row_number() OVER (ORDER BY t) AS r FROM t) WHERE r = CAST(ceil({BAND_LEVEL} * {BAND_DRAWS}) AS INTEGER))
SELECT e.x, round(e.estimate, 4) AS estimate, round(e.estimate - critical * p.s, 4) AS low, round(e.estimate + critical * p.s, 4) AS high
FROM e JOIN p USING (x), c
"""


def two_way_converged(spark: SparkSession, sf: str) -> DataFrame:
    """Converged two-way effects of users and event types (rounds as written tables)."""
    cells = events(spark, sf).groupBy("user_id", "event_type").agg(
        F.log(F.avg("value") + 1).alias("y")
    )
    levels, _, _, certified = effects.two_way_fit(cells, [], "user_id", "event_type", "y")
    return compact(levels.withColumn("certified", F.lit(certified)))


def _two_way_rounds(rounds: int) -> str:
    """Rounds of alternating means of users and event types, from the zero levels."""
    out = "c0 AS (SELECT DISTINCT user_id, CAST(0.0 AS DOUBLE) AS c FROM cells)"
    for n in range(1, rounds + 1):
        out += f""",
a{n} AS MATERIALIZED (SELECT event_type, avg(y - c) AS a FROM cells JOIN c{n - 1} USING (user_id) GROUP BY 1),
c{n} AS MATERIALIZED (SELECT user_id, c - avg(c) OVER () AS c FROM (
      SELECT user_id, avg(y - a) AS c FROM cells JOIN a{n} USING (event_type) GROUP BY 1))"""
    return out


CONVERGED_SQL = f"""
WITH cells AS MATERIALIZED (SELECT user_id, event_type, ln(avg(value) + 1) AS y FROM events GROUP BY 1, 2),
{_two_way_rounds(40)}
SELECT user_id, round(c, 6) AS c, true AS certified FROM c40
"""


def design_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a nation and year as days, customers' remainders as routes: the design that
    each such sample can bear, after how many withdrawals."""
    nations = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").join(nations, F.col("o_custkey") == F.col("c_custkey"))
    days = orders.select(
        "c_nationkey",
        F.year("o_orderdate").alias("year"),
        F.col("o_orderdate").alias("day"),
        (F.col("o_custkey") % 40).alias("component"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "straddling").alias("step5"),
        (F.col("o_totalprice") > 50000 * (1 + F.year("o_orderdate") % 4)).alias("admitted"),
    )
    found = panel.chosen_designs(
        days, ["c_nationkey", "year"], seasonal=True, spline=True, min_residual_df=30, min_estimable_df=20, min_route_days=4
    )
    return found.withColumn("columns", F.array_join("columns", ","))


def _design_columns(withdrawals: int) -> str:
    names = ["one", "date", "season_sin", "season_cos"]
    names += ["hr"] if withdrawals > 2 else ["hr_s1", "hr_s2"]
    names += ["log_gain", "grade", "elevation", "ascent_before"]
    return ",".join(names + [c for c, last in (("descent_before", 0), ("hour", 1), ("e_s", 4)) if withdrawals <= last])


_DESIGNS = ", ".join(f"({k}, {_design_columns(k).count(',') + 1}, '{_design_columns(k)}')" for k in range(6))

DESIGN_SQL = f"""
WITH d AS (SELECT c_nationkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey % 40 AS component,
                  o_orderpriority = '1-URGENT' AS late, o_totalprice > 50000 * (1 + year(o_orderdate) % 4) AS admitted
           FROM orders JOIN customer ON c_custkey = o_custkey),
w(withdrawals, base, columns) AS (VALUES {_DESIGNS}),
r AS (SELECT c_nationkey, year, withdrawals, component, count(*) AS days,
             count(*) > CASE WHEN withdrawals >= 4 THEN 3 ELSE 1 END AS wide
      FROM d, w WHERE admitted AND (NOT late OR withdrawals >= 5) GROUP BY 1, 2, 3, 4),
n AS (SELECT c_nationkey, year, withdrawals, sum(days) AS n,
             sum(CASE WHEN wide THEN 1 ELSE 0 END) - CASE WHEN bool_and(wide) THEN 1 ELSE 0 END AS routes
      FROM r GROUP BY 1, 2, 3),
s AS (SELECT k.c_nationkey, k.year, w.withdrawals, w.columns, coalesce(n.n, 0) AS n, coalesce(n.routes, 0) AS routes,
             base + coalesce(n.routes, 0) AS p
      FROM (SELECT DISTINCT c_nationkey, year FROM d) k CROSS JOIN w
      LEFT JOIN n ON n.c_nationkey = k.c_nationkey AND n.year = k.year AND n.withdrawals = w.withdrawals),
c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, year
             ORDER BY n - p < 30, CASE WHEN n - p >= 30 THEN withdrawals ELSE -withdrawals END) AS place FROM s)
SELECT c_nationkey, year, withdrawals, CAST(n AS BIGINT) AS n, CAST(routes AS BIGINT) AS routes, CAST(p AS BIGINT) AS p, columns,
       n - p >= 20 AS estimable
FROM c WHERE place = 1
"""


def frozen_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """A declared effect on suppliers as outings and nations as routes: a discounted pace against
    the plain one, under weights by flag and two exclusions, with frozen references."""
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    items = table(spark, sf, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = items.select(
        F.col("l_suppkey").alias("outing_id"),
        F.col("s_nationkey").alias("route_id"),
        F.col("l_linenumber").alias("k"),
        F.col("l_returnflag").alias("klass"),
        F.col("l_quantity").alias("length_m"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("base_pace"),
        F.col("l_discount").alias("ease"),
    )
    totals = rows.groupBy("outing_id", "klass", "k").agg(F.sum("length_m").alias("t_s"))
    rows = rows.join(totals, ["outing_id", "klass", "k"])
    nations = table(spark, sf, "nation")
    references = None
    for metric, share in (("level", 0.004), ("class_A", 0.02), ("class_N", 0.01)):
        known = F.col("n_nationkey") % 4 != 0
        part = nations.select(
            F.col("n_nationkey").alias("route_id"),
            F.lit(1).alias("clock"),
            F.lit(metric).alias("metric"),
            F.when(known, F.col("n_nationkey") * share).alias("value"),
            F.when(~known, "insufficient").alias("motif"),
            (F.col("n_regionkey") + 2).alias("days"),
        )
        references = part if references is None else references.unionByName(part)
    spec = experiment.ExperimentSpec(
        Effect("eased", F.col("base_pace") * (1 - F.col("ease"))),
        target="level",
        clock=1,
        weights={"A": 2.0, "R": 0.5},
        exclusions={"7": "rain", "9": "lost"},
    )
    frozen, _ = experiment.frozen_references(references, spec.clock)
    root = f"{shared_folder(spark).rstrip('/')}/experiment-inputs"
    declared = experiment.declare(spec, {"rows": rows, "references": frozen}, root)
    return compact(experiment.run_experiment(spec, declared, root))


EXPERIMENT_SQL = """
WITH s AS (SELECT l_suppkey AS o, s_nationkey AS r, l_returnflag AS c, sum(l_extendedprice) / 1000 AS b,
                  sum(l_extendedprice * (1 - l_discount)) / 1000 AS d, sum(l_quantity) AS t
           FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey NOT IN (7, 9) GROUP BY 1, 2, 3),
w AS (SELECT *, CASE c WHEN 'A' THEN 2.0 WHEN 'R' THEN 0.5 ELSE 1.0 END AS w FROM s),
f AS (SELECT n_nationkey AS r, m.metric, m.share * n_nationkey AS v FROM nation,
             (VALUES ('level', 0.004), ('class_A', 0.02), ('class_N', 0.01)) m(metric, share) WHERE n_nationkey % 4 <> 0),
e AS (SELECT metric, avg(v) AS v FROM f GROUP BY 1),
a AS (SELECT o, r, abs(ln(sum(w * b) / sum(w * t))) - abs(ln(sum(w * d) / sum(w * t))) AS gain FROM w GROUP BY 1, 2),
g AS (SELECT o, gain, greatest(0.010, 0.25 * coalesce(f.v, (SELECT v FROM e WHERE metric = 'level'))) AS th
      FROM a LEFT JOIN f ON f.r = a.r AND f.metric = 'level'),
h AS (SELECT 'class_' || c AS metric, abs(ln(d / t)) - abs(ln(b / t)) AS harm,
             greatest(0.005, 0.10 * coalesce(f.v, e.v, 0.0)) AS th
      FROM s LEFT JOIN f ON f.r = s.r AND f.metric = 'class_' || c LEFT JOIN e ON e.metric = 'class_' || c),
q AS (SELECT metric, avg(harm) > avg(th) + 1e-6 OR bool_or(harm > 2.0 * th + 1e-6) AS broken FROM h GROUP BY 1),
n AS (SELECT count(*) AS n, avg(gain) AS mg, avg(th) AS mt, CAST(sum(CASE WHEN gain > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
             CAST(sum(CASE WHEN gain < -th - 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS lost FROM g)
SELECT 'eased' AS effect, 'level' AS target, 1 AS clock, '{"A": 2.0, "R": 0.5}' AS weights,
       '{"7": "rain", "9": "lost"}' AS exclusions, n AS evaluable, n AS gains, round(mt, 6) AS mean_threshold,
       pos AS positive, lost AS losses, (SELECT CAST(sum(CASE WHEN broken THEN 1 ELSE 0 END) AS BIGINT) FROM q) AS guards_broken,
       round(mg, 6) AS mean_gain, CAST(ceil(n * 3 / 4.0) AS BIGINT) AS required,
       CASE WHEN mg < mt - 1e-6 OR pos < ceil(n * 3 / 4.0) OR lost > 0 OR (SELECT bool_or(broken) FROM q)
            THEN 'rejected' ELSE 'provisional' END AS verdict
FROM n
"""


def sensitivity_reserves(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as performances under nineteen configurations: how far the gains, the verdicts and
    the guards of each are those of the central one."""
    items = table(spark, sf, "lineitem")
    per = items.groupBy("l_suppkey").agg(
        F.avg("l_discount").alias("ease"), F.avg("l_tax").alias("tax"), F.count(F.lit(1)).alias("n")
    )
    listed = [
        F.struct(F.lit(c.number).alias("configuration"), F.lit(c.step_m).alias("step_m"), F.lit(c.clock).alias("clock"))
        for c in sensitivity.configurations()
    ]
    rows = per.select("*", F.inline(F.array(*listed)))
    number, supplier = F.col("configuration"), F.col("l_suppkey")
    gain = F.col("ease") - 0.05 + 0.02 - F.when(F.col("step_m") > 250, 0.021).otherwise(0.0) - 0.001 * F.col("clock")
    gone = (supplier % 17 == number % 17) & (number > 9)
    assessed = rows.select(
        "configuration",
        "l_suppkey",
        F.when(~gone & (number != 18), gain).alias("gain"),
        F.lit(0.01).alias("threshold"),
        F.when(gone | (number == 18), "insufficient").alias("motif"),
    )
    guards = rows.filter(number != 5).select(
        "configuration", F.lit("dispersion").alias("metric"), (F.col("tax") - 0.04).alias("harm"), F.lit(0.005).alias("threshold")
    )
    admitted = experiments.admit(assessed, guards, ["configuration"])
    gains = sensitivity.compared_gains(assessed, ["l_suppkey"])
    return compact(sensitivity.reserves(gains, admitted, guards))


RESERVE_SQL = """
WITH per AS (SELECT l_suppkey AS s, avg(l_discount) AS ease, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
c AS (SELECT n AS c, CASE WHEN n < 9 THEN CASE n // 3 WHEN 0 THEN 100 WHEN 1 THEN 250 ELSE 500 END ELSE 250 END AS step,
             CASE WHEN n < 9 THEN 0 ELSE n - 8 END AS clock FROM (SELECT unnest(range(0, 19)) AS n)),
a AS (SELECT c, s, (s % 17 = c % 17 AND c > 9) OR c = 18 AS gone,
             ease - 0.05 + 0.02 - CASE WHEN step > 250 THEN 0.021 ELSE 0.0 END - 0.001 * clock AS g, tax - 0.04 AS harm FROM per, c),
v AS (SELECT c, count(*) FILTER (NOT gone) AS n, avg(g) FILTER (NOT gone) AS m, sum(CASE WHEN NOT gone AND g > 1e-6 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN NOT gone AND g < -0.01 - 1e-6 THEN 1 ELSE 0 END) AS lost,
             c <> 5 AND (avg(harm) > 0.005 + 1e-6 OR bool_or(harm > 0.01 + 1e-6)) AS broken FROM a GROUP BY 1),
d AS (SELECT c, CASE WHEN n = 0 THEN NULL WHEN m < 0.01 - 1e-6 OR pos < ceil(n * 3 / 4.0) OR lost > 0 OR broken THEN 'rejected'
                     ELSE 'provisional' END AS verdict,
             CASE WHEN n = 0 THEN NULL WHEN m > 1e-6 THEN 1 WHEN m < -1e-6 THEN -1 ELSE 0 END AS sign FROM v),
p AS (SELECT a.c, a.s, a.gone, b.gone AS bgone, a.g, b.g AS bg,
             CASE WHEN a.g > 1e-6 THEN 1 WHEN a.g < -1e-6 THEN -1 ELSE 0 END AS sg,
             CASE WHEN b.g > 1e-6 THEN 1 WHEN b.g < -1e-6 THEN -1 ELSE 0 END AS bs FROM a JOIN a b ON b.s = a.s AND b.c = 4),
k AS (SELECT c, count(*) FILTER (NOT gone AND NOT bgone) AS comparable, count(*) FILTER (NOT gone AND bgone) AS entering,
             count(*) FILTER (gone AND NOT bgone) AS leaving, avg(bg) FILTER (NOT gone AND NOT bgone) AS cb,
             avg(g) FILTER (NOT gone AND NOT bgone) AS cg, coalesce(bool_or(sg <> bs AND NOT gone AND NOT bgone), false) AS moved FROM p GROUP BY 1)
SELECT CAST(k.c AS INTEGER) AS configuration, comparable, entering, leaving, round(cb, 6) AS common_base_gain, round(cg, 6) AS common_gain,
       d.verdict, moved OR coalesce(d.sign <> e.sign, false) AS sign_changed, d.verdict IS DISTINCT FROM e.verdict AS verdict_changed,
       leaving > 0 OR d.verdict IS NULL OR k.c = 5 AS evaluability_lost, comparable = 0 AS sign_unverifiable
FROM k JOIN d ON d.c = k.c JOIN d e ON e.c = 4
"""


CHECKS = {
    "sensitivity_reserves": Check(sensitivity_reserves, RESERVE_SQL),
    "frozen_experiment": Check(frozen_experiment, EXPERIMENT_SQL),
    "design_choice": Check(design_choice, DESIGN_SQL),
    "within_group_ols": Check(within_group_ols, WITHIN_SQL),
    "ols_trend": Check(ols_trend, TREND_SQL),
    "group_slopes": Check(group_slopes, SLOPE_SQL),
    "cr2_cov": Check(cr2_variance, CR2_SQL),
    "lag_autocorrelation": Check(lag_autocorrelation, LAG_SQL),
    "holm": Check(holm, HOLM_SQL),
    "interval_readings": Check(readings, READING_SQL),
    "power_table": Check(power_table, POWER_SQL),
    "route_groups": Check(route_groups, ROUTE_SQL),
    "principal_device": Check(principal_device, DEVICE_SQL),
    "chain_check": Check(chain_check, CHAIN_SQL),
    "trial_counts": Check(trial_counts, TRIAL_SQL),
    "trials_by_effect": Check(trials_by_effect, EFFECT_SQL),
    "sensitivity_axes": Check(sensitivity_axes, AXES_SQL),
    "admission_verdicts": Check(admission_verdicts, VERDICT_SQL),
    "huber_fit": Check(huber_fit, HUBER_SQL),
    "wild_cluster_bootstrap": Check(wild_bootstrap),
    "max_t_band": Check(max_t_band, BAND_SQL),
    "two_way_converged": Check(two_way_converged, CONVERGED_SQL),
}
