"""Small aggregates and rules: civil time, statuses, coverage of windows, draws, curve files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeflow.catalog import Check
from ridgeflow.functions import civil
from ridgeflow.operators import calibration, curve, days, origin, panel, scoring, trend
from ridgeflow.tables import compact, events, table


def _text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss")


def civil_days(spark: SparkSession, sf: str) -> DataFrame:
    """Paris day, its midnight, the origin before it and a window of 30 civil days."""
    at = F.col("ts").cast("timestamp")
    day = civil.civil_date(at)
    start = civil.origin(day)
    return events(spark, sf).select(
        "event_id",
        day.cast("string").alias("day"),
        _text(civil.midnight(day)).alias("midnight"),
        _text(start).alias("origin"),
        civil.available(at, start).alias("known"),
        civil.is_origin(start).alias("starts_a_day"),
        _text(civil.window_bound(start, F.lit(30))).alias("window_low"),
        civil.curve_age_days(at, F.date_add(day, 3)).alias("age"),
        civil.in_date_range(at, F.lit("2024-01-05").cast("date"), F.lit("2024-02-05").cast("date")).alias("in_range"),
    )


CIVIL_SQL = """
WITH d AS (SELECT event_id, ts, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris' AS DATE) AS day FROM events),
m AS (SELECT *, (CAST(day AS TIMESTAMP) AT TIME ZONE 'Europe/Paris') AT TIME ZONE 'UTC' AS mid,
             (CAST(day - 7 AS TIMESTAMP) AT TIME ZONE 'Europe/Paris') AT TIME ZONE 'UTC' AS ori,
             (CAST(day - 37 AS TIMESTAMP) AT TIME ZONE 'Europe/Paris') AT TIME ZONE 'UTC' AS low FROM d)
SELECT event_id, CAST(day AS VARCHAR) AS day, strftime(mid, '%Y-%m-%d %H:%M:%S') AS midnight,
       strftime(ori, '%Y-%m-%d %H:%M:%S') AS origin, ts < ori AS known, true AS starts_a_day,
       strftime(low, '%Y-%m-%d %H:%M:%S') AS window_low, 3 AS age,
       day BETWEEN DATE '2024-01-05' AND DATE '2024-02-05' AS in_range FROM m
"""


def clock_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Decimal hour, clock time after an elapsed time, season and period of each event."""
    at = F.col("ts").cast("timestamp")
    sin, cos = trend.season(F.to_date("ts"))
    span = (F.lit("2024-01-10").cast("date"), F.lit("2024-02-10").cast("date"))
    return compact(
        events(spark, sf).select(
            "event_id",
            civil.decimal_hour(at).alias("hour"),
            _text(civil.clock_time(at, F.col("value"))).alias("passage"),
            sin.alias("season_sin"),
            cos.alias("season_cos"),
            civil.period_of(F.to_date("ts"), *span).alias("period"),
        )
    )


CLOCK_SQL = """
SELECT event_id, round(hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0, 6) AS hour,
       strftime(ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS passage,
       round(sin(dayofyear(ts) * 2 * pi() / 365.25), 6) AS season_sin, round(cos(dayofyear(ts) * 2 * pi() / 365.25), 6) AS season_cos,
       CASE WHEN CAST(ts AS DATE) < DATE '2024-01-10' THEN 'before' WHEN CAST(ts AS DATE) > DATE '2024-02-10' THEN 'after'
            ELSE 'discovery' END AS period FROM events
"""


def spline_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Natural cubic basis of the quantity at three knots, and the p-value of draws."""
    basis = trend.natural_cubic_basis(F.col("l_quantity"), [10.0, 25.0, 40.0])
    p = trend.draws_p_value(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100, F.col("l_returnflag") == "R")
    return compact(
        table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", *(b.alias(f"b{i}") for i, b in enumerate(basis)), p.alias("p")
        )
    )


SPLINE_SQL = """
WITH t AS (SELECT *, greatest(l_quantity - 10, 0) ^ 3 AS t1, greatest(l_quantity - 25, 0) ^ 3 AS t2, greatest(l_quantity - 40, 0) ^ 3 AS t3 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS b0, round((t1 - t3) / 30.0 - (t2 - t3) / 15.0, 6) AS b1,
       round(CASE WHEN l_returnflag = 'R' THEN 1 ELSE greatest(l_discount, least(1, 2 * least(l_tax, l_quantity / 100))) END, 6) AS p FROM t
"""


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as outings: elapsed seconds, projected and base times."""
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").withColumns(
        {
            "day": F.to_date("o_orderdate"),
            "t": price / 100,
            "p": price / 100 * (1 + (F.col("o_orderkey") % 7 - 3) / 50),
            "p0": price / 90,
            "klass": F.col("o_orderstatus"),
        }
    )


def usage_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute errors over a common base forecast, by customer."""
    return compact(scoring.common_usage(_orders(spark, sf), ["o_custkey"]))


USAGE_SQL = """
WITH o AS (SELECT o_custkey, o_totalprice / 100 AS t, o_totalprice / 100 * (1 + (o_orderkey % 7 - 3) / 50.0) AS p, o_totalprice / 90 AS p0 FROM orders)
SELECT o_custkey, round(sum(abs(p - t)) / sum(p0), 6) AS usage_common FROM o GROUP BY o_custkey
"""


def descent_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling and steep shares of each order's items, a discount as a descent."""
    overlaps = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("length_m"), ((F.col("l_tax") - 0.04) * 4).alias("grade")
    )
    return compact(scoring.descent_fractions(overlaps, ["l_orderkey"]))


DESCENT_SQL = """
WITH g AS (SELECT l_orderkey, l_quantity AS q, (l_tax - 0.04) * 4 AS g FROM lineitem)
SELECT l_orderkey, round(coalesce(sum(q) FILTER (g >= -0.15 AND g < -0.05), 0) / sum(q), 6) AS rolling_fraction,
       round(coalesce(sum(q) FILTER (g < -0.15), 0) / sum(q), 6) AS steep_fraction FROM g GROUP BY l_orderkey
"""


def member_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log ratio of the orders that hold a costly item and of the others."""
    terms = _orders(spark, sf).select("o_custkey", F.col("o_orderkey").alias("member"), F.col("t").alias("t_all"), F.col("p").alias("p_all"))
    owners = table(spark, sf, "orders").select(F.col("o_orderkey").alias("member"), "o_custkey")
    costly = table(spark, sf, "lineitem").filter("l_extendedprice > 60000").select(F.col("l_orderkey").alias("member"))
    contributing = costly.join(owners, "member")
    return compact(calibration.contributor_means(terms, contributing, ["o_custkey"], "member"))


MEMBER_SQL = """
WITH o AS (SELECT o_custkey, -ln(1 + (o_orderkey % 7 - 3) / 50.0) AS l,
                  o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_extendedprice > 60000) AS i FROM orders)
SELECT o_custkey, CAST(count(*) FILTER (i) AS BIGINT) AS contributors, count(*) AS members,
       round(avg(l) FILTER (i), 6) AS contributing_mean, round(avg(l) FILTER (NOT i), 6) AS other_mean FROM o GROUP BY o_custkey
"""


def window_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers covered under all five priorities, and beyond under one with a curve under another."""
    shares = table(spark, sf, "orders").groupBy("o_custkey", F.substring("o_orderpriority", 1, 1).alias("window")).agg(
        (F.sum("o_totalprice") / 1e6).alias("share"), (F.count("*") > 1).alias("has_curve")
    )
    sets = scoring.window_sets(shares, 0.4, 0.3)
    covered = scoring.covered_under_all(sets, ["o_custkey"], 5).withColumn("kind", F.lit("covered"))
    pairs = scoring.pair_beyond(sets, ["o_custkey"], F.lit("1"), F.lit("2")).withColumn("kind", F.lit("pair"))
    return covered.unionByName(pairs)


WINDOW_SQL = """
WITH s AS (SELECT o_custkey, substr(o_orderpriority, 1, 1) AS w, sum(o_totalprice) / 1e6 AS share, count(*) > 1 AS c FROM orders GROUP BY ALL)
SELECT o_custkey, 'covered' AS kind FROM s WHERE share <= 0.4 GROUP BY o_custkey HAVING count(DISTINCT w) = 5
UNION ALL
SELECT o_custkey, 'pair' AS kind FROM (SELECT o_custkey FROM s WHERE share > 0.3 AND w = '1' INTERSECT SELECT o_custkey FROM s WHERE c AND w = '2')
"""


def resting_states(spark: SparkSession, sf: str) -> DataFrame:
    """Status of each order's value as a day's resting heart rate, and its stress cover."""
    price = F.col("o_totalprice")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 > 0, 40 + price % 30).alias("resting_hr_bpm"),
        F.element_at(F.array(*(F.lit(s) for s in ("absent", "truncated", "complete"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("state"),
        F.when(F.col("o_orderkey") % 4 > 0, price % 30000).alias("measured_sleep_s"),
        F.col("o_orderdate").cast("timestamp").alias("window_start"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 30).cast("int"))).alias("data_end"),
        (price % 50000).alias("calm_s"),
        F.when(F.col("o_custkey") % 6 > 0, price % 40000).alias("high_s"),
    )
    measured, covers = days.stress_columns(0.5, ["calm_s", "high_s"])
    return compact(
        rows.select("o_orderkey", days.resting_status(10800.0).alias("status"), measured.alias("stress_s"), covers.alias("covers"))
    )


RESTING_SQL = """
WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS st, o_orderkey % 5 > 0 AS has, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice % 30000 END AS slept,
                  o_totalprice % 50000 + CASE WHEN o_custkey % 6 > 0 THEN o_totalprice % 40000 END AS m, greatest(24, o_orderkey % 30) * 3600 AS w FROM orders)
SELECT o_orderkey, CASE WHEN NOT has OR st = 0 THEN 'absent' WHEN st = 1 THEN 'provisional' WHEN slept IS NULL OR slept < 10800 THEN 'no_night'
       ELSE 'valid' END AS status, round(m, 6) AS stress_s, m >= 0.5 * w AS covers FROM o
"""


def edge_points(spark: SparkSession, sf: str) -> DataFrame:
    """Events before, on the edges of and after the day of their user's first event."""
    rows = events(spark, sf).select("user_id", F.date_trunc("second", "ts").cast("timestamp").alias("instant"))
    firsts = rows.groupBy("user_id").agg((F.min("instant") + F.expr("INTERVAL 1 HOUR")).alias("window_start"), F.max("instant").alias("window_end"))
    return days.edge_counts(rows.join(firsts, "user_id"), ["user_id"])


EDGE_SQL = """
WITH e AS (SELECT user_id, date_trunc('second', ts) AS t FROM events),
w AS (SELECT user_id, min(t) + INTERVAL 1 HOUR AS a, max(t) AS b FROM e GROUP BY user_id)
SELECT user_id, CAST(count(*) FILTER (t < a) AS BIGINT) AS before, CAST(count(*) FILTER (t = a) AS BIGINT) AS at_start,
       CAST(count(*) FILTER (t = b) AS BIGINT) AS at_end, CAST(count(*) FILTER (t > b) AS BIGINT) AS after FROM e JOIN w USING (user_id) GROUP BY user_id
"""


def first_points(spark: SparkSession, sf: str) -> DataFrame:
    """One event per user and minute, the first file's; ties fall by type and value."""
    rows = events(spark, sf).select(
        "user_id",
        F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("instant"),
        (F.col("event_id") % 9).alias("file"),
        "event_type",
        "value",
    )
    kept, duplicates = days.first_wins(rows, ["user_id"], "instant", "file")
    return compact(kept.join(duplicates, "user_id"))


FIRST_SQL = """
WITH e AS (SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS instant, event_id % 9 AS file, event_type, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, instant ORDER BY file, event_type, value) AS k FROM e),
n AS (SELECT user_id, CAST(count(*) - count(DISTINCT instant) AS BIGINT) AS duplicates FROM e GROUP BY user_id)
SELECT user_id, instant, file, event_type, round(value, 6) AS value, duplicates FROM r JOIN n USING (user_id) WHERE k = 1
"""


def curve_file(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a curve file from item prices, with what a reader would refuse."""
    items = table(spark, sf, "lineitem")
    bins = items.groupBy("l_suppkey", (F.floor(F.col("l_quantity") / 10) / 20).alias("grade")).agg(
        (F.avg("l_extendedprice") / 20000 - 1).alias("speed_ms"),
        F.avg("l_tax").alias("mean_hr_bpm"),
        F.avg("l_extendedprice").alias("elapsed_speed_ms"),
        (F.sum("l_discount") - 0.2).alias("time_min"),
        F.count("*").alias("activities"),
        F.max("l_tax").alias("shape_iqr"),
    )
    rows = curve.curve_rows(bins, ["l_suppkey"])
    problems = curve.check_curve_rows(rows, ["l_suppkey"]).select("l_suppkey", "grade_pct", "problem")
    return compact(rows.join(problems, ["l_suppkey", "grade_pct"], "left"))


CURVE_SQL = """
WITH b AS (SELECT l_suppkey, floor(l_quantity / 10) / 20 AS g, avg(l_extendedprice) / 20000 - 1 AS s, avg(l_tax) AS h, avg(l_extendedprice) AS e,
                  sum(l_discount) - 0.2 AS t, count(*) AS n, max(l_tax) AS q FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(g * 100, 6) AS grade_pct, round(s * 3.6, 6) AS kmh, round(h, 6) AS hr, round(s * g * 3600, 6) AS vam_mh, round(t, 6) AS time_min,
       round(e * 3.6, 6) AS elapsed_kmh, n AS activities, round(q, 6) AS shape_iqr,
       CASE WHEN s * 3.6 < 0.01 THEN 'speed' WHEN t < 0 THEN 'time' END AS problem FROM b
"""


def candidate_outings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of two priorities in a closed range of local days, in the domain, by source of profile."""
    index = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 4 > 0).alias("has_recording"),
        F.col("o_orderpriority").alias("activity_type"),
        F.col("o_orderdate").alias("local_start"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("reference"),
        (F.col("o_custkey") % 2).alias("traces"),
        (F.col("o_totalprice") % 100).alias("steep"),
    )
    chosen = curve.select_candidates(index, ["1-URGENT", "2-HIGH"], "1993-01-01", "1996-12-31")
    sport = F.when(F.col("o_orderkey") % 3 > 0, "foot").otherwise("ski")
    day = F.to_date("local_start")
    inside = origin.in_domain(sport, day, F.col("steep"), F.lit("1994-01-01").cast("date"))
    return chosen.select("o_orderkey", inside.alias("in_domain"), origin.profile_source(F.col("reference"), F.col("traces")).alias("source"))


CANDIDATE_SQL = """
SELECT o_orderkey, o_orderkey % 3 > 0 AND CAST(o_orderdate AS DATE) >= DATE '1994-01-01' AND o_totalprice % 100 >= 40 AS in_domain,
       CASE WHEN o_custkey % 3 = 0 THEN 'reference' WHEN o_custkey % 2 > 0 THEN 'traces' ELSE 'none' END AS source
FROM orders WHERE o_orderkey % 4 > 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'
"""


def day_performances(spark: SparkSession, sf: str) -> DataFrame:
    """Retained orders of each customer and day, listed by rank, as one performance."""
    rows = table(spark, sf, "orders").select(
        "o_custkey",
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("civil_date"),
        F.col("o_orderkey").alias("rank"),
        F.col("o_orderkey").alias("outing_id"),
        (F.col("o_orderkey") % 5 > 0).alias("retained"),
        (F.col("o_orderkey") % 7 > 0).alias("in_domain"),
        F.col("o_orderkey").cast("double").alias("start_s"),
        F.col("o_totalprice").alias("elapsed_s"),
        F.when(F.col("o_orderstatus") == "O", "training").otherwise("race").alias("label"),
    )
    out = origin.group_performances(rows, ["o_custkey"])
    return compact(out.withColumn("outings", F.array_join(F.transform("outings", lambda o: o.cast("string")), ",")))


PERFORMANCE_SQL = """
SELECT o_custkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS civil_date,
       string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS outings, round(max(o_orderkey + o_totalprice), 6) AS end_time,
       bool_and(o_orderstatus = 'O') AS is_training, bool_or(o_orderstatus <> 'O') AS is_race
FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 GROUP BY ALL
"""


def activity_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Safe end of each order seen as an activity, from its index and its recording."""
    index = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("double").alias("start_s"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("elapsed_s")
    )
    items = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    last = origin.recording_end(
        items.select("o_orderkey", F.col("l_extendedprice").alias("time_s")),
        items.select("o_orderkey", F.col("l_quantity").alias("start_s"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity") * 2000).alias("elapsed_s")),
        items.select("o_orderkey", F.col("l_partkey").cast("double").alias("time_s")),
        ["o_orderkey"],
    )
    recordings = last.filter("o_orderkey % 4 > 0").withColumn("recording_start_s", F.lit(5.0))
    out = origin.activity_ends(index, recordings, ["o_orderkey"])
    return compact(out.select("o_orderkey", "index_end", "recording_end", "safe_end", "end_method"))


END_SQL = """
WITH r AS (SELECT l_orderkey, max(greatest(l_extendedprice, l_quantity + CASE WHEN l_linenumber > 1 THEN l_quantity * 2000 ELSE 0 END, l_partkey)) + 5 AS e
           FROM lineitem WHERE l_orderkey % 4 > 0 GROUP BY l_orderkey),
i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey + o_totalprice END AS a, e AS b FROM orders LEFT JOIN r ON l_orderkey = o_orderkey)
SELECT o_orderkey, round(a, 6) AS index_end, round(b, 6) AS recording_end, round(greatest(coalesce(a, b), coalesce(b, a)), 6) AS safe_end,
       CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'index_only' WHEN b IS NOT NULL THEN 'inferred' ELSE 'unknown' END AS end_method
FROM i
"""


def stray_points(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user more than an hour away from all of their purchases' half hours."""
    rows = events(spark, sf).select("user_id", "event_id", "time_s", "event_type")
    spans = rows.filter("event_type = 'purchase'").select("user_id", F.col("time_s").alias("start_s"), (F.col("time_s") + 1800).alias("end_s"))
    points = rows.select("user_id", "event_id", F.col("time_s").alias("at_s"))
    return origin.correspondence_violations(points, spans, ["user_id"], 3600.0).select("user_id", "event_id")


STRAY_SQL = """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, event_type FROM events)
SELECT user_id, event_id FROM e AS a WHERE NOT EXISTS (
    SELECT 1 FROM e AS p WHERE p.user_id = a.user_id AND p.event_type = 'purchase' AND a.t BETWEEN p.t - 3600 AND p.t + 5400)
"""


def missing_days(spark: SparkSession, sf: str) -> DataFrame:
    """Share of orders without a value in each status, and the first motif of each."""
    rows = table(spark, sf, "orders").withColumn("missing", F.col("o_orderkey") % 3 == 0)
    shares = panel.missing_shares(rows, "o_orderstatus", F.col("missing"))
    motif = panel.climb_motif([("cheap", F.col("o_totalprice") < 50000), ("odd", F.col("o_custkey") % 2 == 1), ("late", F.col("o_orderdate") > "1997-01-01")])
    flow = panel.flow_counts(rows.withColumn("motif", motif), ["o_orderstatus"])
    return compact(flow.join(shares, "o_orderstatus"))


MISSING_SQL = """
WITH o AS (SELECT *, CASE WHEN o_totalprice < 50000 THEN 'cheap' WHEN o_custkey % 2 = 1 THEN 'odd' WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'late' ELSE 'kept' END AS m FROM orders),
f AS (SELECT o_orderstatus, m AS motif, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT o_orderstatus, 'all', count(*) FROM o GROUP BY ALL),
s AS (SELECT o_orderstatus, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS missing_share, count(*) AS days FROM o GROUP BY ALL)
SELECT o_orderstatus, motif, n, missing_share, days FROM f JOIN s USING (o_orderstatus)
"""


def night_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, as nights, whose length differs from the sum of their stages."""
    price = F.col("o_totalprice")
    start = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        start.alias("night_start"),
        (start + F.make_dt_interval(F.lit(0), F.lit(7))).alias("night_end"),
        *(F.when(F.col("o_orderkey") % (i + 2) > 0, price % m).alias(c) for i, (c, m) in enumerate({"deep_s": 9000, "light_s": 14000, "rem_s": 6000, "awake_s": 3000, "unmeasurable_s": 900}.items())),
    )
    return rows.select("o_orderkey", days.night_mismatch().alias("mismatch"))


NIGHT_SQL = """
SELECT o_orderkey, abs(25200 - (CASE WHEN o_orderkey % 2 > 0 THEN o_totalprice % 9000 ELSE 0 END + CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice % 14000 ELSE 0 END
       + CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice % 6000 ELSE 0 END + CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice % 3000 ELSE 0 END
       + CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice % 900 ELSE 0 END)) > 210 AS mismatch FROM orders
"""


CHECKS = {
    "civil_days": Check(civil_days, CIVIL_SQL),
    "clock_readings": Check(clock_readings, CLOCK_SQL),
    "spline_terms": Check(spline_terms, SPLINE_SQL),
    "usage_errors": Check(usage_errors, USAGE_SQL),
    "descent_shares": Check(descent_shares, DESCENT_SQL),
    "member_means": Check(member_means, MEMBER_SQL),
    "window_pairs": Check(window_pairs, WINDOW_SQL),
    "resting_states": Check(resting_states, RESTING_SQL),
    "edge_points": Check(edge_points, EDGE_SQL),
    "first_points": Check(first_points, FIRST_SQL),
    "curve_file": Check(curve_file, CURVE_SQL),
    "candidate_outings": Check(candidate_outings, CANDIDATE_SQL),
    "day_performances": Check(day_performances, PERFORMANCE_SQL),
    "activity_ends": Check(activity_ends, END_SQL),
    "stray_points": Check(stray_points, STRAY_SQL),
    "missing_days": Check(missing_days, MISSING_SQL),
    "night_mismatches": Check(night_mismatches, NIGHT_SQL),
}
