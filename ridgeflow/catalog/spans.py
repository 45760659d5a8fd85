"""Spans of tracks: heart rate, holes, chronometer stops, places and closing drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeflow.catalog import Check
from ridgeflow.operators import climbs, clocks, matching, panel
from ridgeflow.tables import compact, table

USER = ["user_id"]


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """A record per event, 5 s apart and 25 s behind every thirteenth: a hole."""
    order = Window.partitionBy("user_id").orderBy("ts")
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "value", F.row_number().over(order).alias("n"),
        F.when(F.col("event_id") % 13 == 0, 25.0).otherwise(5.0).alias("dt"),
    )
    upto = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("time_s", F.sum("dt").over(upto))


def _steps(records: DataFrame) -> DataFrame:
    """Intervals to the next record, moving, stopped or unknown by the event's number."""
    order = Window.partitionBy("user_id").orderBy("n")
    states = F.element_at(F.array(*map(F.lit, clocks.STATES)), (F.col("event_id") % 3 + 1).cast("int"))
    return (
        records.select("*", F.lead("time_s").over(order).alias("end_s"), F.lead("dt").over(order).alias("_d"))
        .filter(F.col("end_s").isNotNull())
        .select("user_id", "time_s", "end_s", (F.col("_d") > 10).alias("hole"), states.alias(f"state_{clocks.CENTRAL}"))
    )


def _spans(records: DataFrame) -> DataFrame:
    """Spans of 61 s, one every 37 s: they overlap, and may begin and end inside an interval."""
    last = records.groupBy("user_id").agg(F.max("time_s").alias("last_s"))
    numbered = last.select("user_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last_s") / 37).cast("int"))).alias("j"))
    return numbered.select("user_id", "j", (F.col("j") * 37 + 3.5).cast("double").alias("start_s"), (F.col("j") * 37 + 64.5).cast("double").alias("end_s"))


BASE_SQL = """
WITH e AS (SELECT user_id AS u, event_id AS e, event_type AS y, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n,
                  CASE WHEN event_id % 13 = 0 THEN 25.0 ELSE 5.0 END AS dt FROM events),
r AS (SELECT *, sum(dt) OVER (PARTITION BY u ORDER BY n) AS t FROM e),
st AS (SELECT u, e, v, t AS a, lead(t) OVER w AS b, lead(dt) OVER w > 10 AS hole,
              CASE e % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'S' ELSE 'U' END AS state
       FROM r WINDOW w AS (PARTITION BY u ORDER BY n) QUALIFY b IS NOT NULL),
sp AS (SELECT u, j, j * 37 + 3.5 AS a, j * 37 + 64.5 AS b
       FROM (SELECT u, unnest(range(0, CAST(floor(max(t) / 37) AS BIGINT) + 1)) AS j FROM r GROUP BY u))
"""


def span_heart(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of a channel over the moving intervals of a span that have a value."""
    records = _records(spark, sf)
    channel = records.filter(F.col("event_id") % 4 != 0).select("user_id", "time_s", "value")
    return compact(climbs.exact_moving_mean(_steps(records), channel, _spans(records), USER, "j"))


HEART_SQL = BASE_SQL + """,
p AS (SELECT sp.u, sp.j, least(sp.b, st.b) - greatest(sp.a, st.a) AS w, CASE WHEN st.e % 4 <> 0 THEN v END AS v
      FROM sp JOIN st ON st.u = sp.u AND st.a < sp.b AND sp.a < st.b AND state = 'M')
SELECT u AS user_id, CAST(j AS INTEGER) AS j, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS mean,
       round(coalesce(sum(CASE WHEN v IS NOT NULL THEN w END), 0) / sum(w), 6) AS coverage
FROM p GROUP BY 1, 2
"""


def span_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Holes inside each span, and the chronometer's stops in it, both ends included."""
    records = _records(spark, sf)
    timer = records.select(
        "user_id",
        "time_s",
        F.when(F.col("event_type") == "purchase", "stop").otherwise("start").alias("event_type"),
        F.when(F.col("value") > 40, "auto").otherwise("manual").alias("trigger"),
    )
    return compact(climbs.gaps_and_stops(_spans(records), _steps(records), timer, USER, "j"))


GAPS_SQL = BASE_SQL + """,
h AS (SELECT sp.u, sp.j, count(*) AS c, sum(least(sp.b, st.b) - greatest(sp.a, st.a)) AS s
      FROM sp JOIN st ON st.u = sp.u AND st.a < sp.b AND sp.a < st.b AND hole GROUP BY 1, 2),
k AS (SELECT sp.u, sp.j, count(*) AS c, sum(CASE WHEN v > 40 THEN 1 ELSE 0 END) AS auto
      FROM sp JOIN r ON r.u = sp.u AND r.t BETWEEN sp.a AND sp.b AND y = 'purchase' GROUP BY 1, 2)
SELECT sp.u AS user_id, CAST(sp.j AS INTEGER) AS j, CAST(sp.a AS DOUBLE) AS start_s, CAST(sp.b AS DOUBLE) AS end_s,
       coalesce(h.c, 0) AS gap_count, round(CAST(coalesce(h.s, 0) AS DOUBLE), 6) AS gap_s,
       coalesce(k.c, 0) AS timer_stops, CAST(coalesce(k.auto, 0) AS BIGINT) AS auto_stops
FROM sp LEFT JOIN h ON h.u = sp.u AND h.j = sp.j LEFT JOIN k ON k.u = sp.u AND k.j = sp.j
"""


def hole_ascent(spark: SparkSession, sf: str) -> DataFrame:
    """Gain of the elevation channel inside holes: samples at every record and 2.5 s after."""
    records = _records(spark, sf)
    samples = records.select("user_id", F.inline(F.array(
        F.struct(F.col("time_s").alias("time_s"), F.col("value").alias("value")),
        F.struct((F.col("time_s") + 2.5).alias("time_s"), (F.col("value") + F.col("event_id") % 7 - 3).alias("value")),
    )))
    return compact(climbs.hole_ascent(_steps(records), samples, USER))


HOLE_SQL = BASE_SQL + """,
z AS (SELECT u, t, v FROM r UNION ALL SELECT u, t + 2.5, v + e % 7 - 3 FROM r),
d AS (SELECT u, t AS a, lead(t) OVER w AS b, lead(v) OVER w - v AS dz FROM z WINDOW w AS (PARTITION BY u ORDER BY t))
SELECT d.u AS user_id, round(sum(greatest(dz, 0.0)), 6) AS hole_ascent_m
FROM d JOIN st ON st.u = d.u AND hole AND d.a >= st.a AND d.b <= st.b GROUP BY 1
"""


def last_places(spark: SparkSession, sf: str) -> DataFrame:
    """The farthest place of each supplier's span of prices: parts as places, closed at both ends."""
    items = table(spark, sf, "lineitem")
    places = items.select("l_suppkey", F.concat(F.lit("p"), "l_partkey").alias("name"), F.col("l_extendedprice").alias("at_m"))
    spans = items.groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("from_m"), F.avg("l_extendedprice").alias("to_m"))
    spans = spans.withColumn("from_m", F.when(F.col("l_suppkey") % 10 == 3, F.col("to_m") + 1e9).otherwise(F.col("from_m")))
    return matching.last_place(places, spans, ["l_suppkey"], "from_m", "to_m")


PLACE_SQL = """
WITH s AS (SELECT l_suppkey, CASE WHEN l_suppkey % 10 = 3 THEN avg(l_extendedprice) + 1e9 ELSE min(l_extendedprice) END AS a,
                  avg(l_extendedprice) AS b FROM lineitem GROUP BY 1),
p AS (SELECT s.l_suppkey, 'p' || l_partkey AS name, row_number() OVER (PARTITION BY s.l_suppkey ORDER BY l_extendedprice DESC, 'p' || l_partkey DESC) AS n
      FROM s JOIN lineitem l ON l.l_suppkey = s.l_suppkey AND l_extendedprice BETWEEN a AND b)
SELECT s.l_suppkey, p.name AS last_place FROM s LEFT JOIN p ON p.l_suppkey = s.l_suppkey AND p.n = 1
"""


def closing_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as recordings: loops whose closing elevation gap per second is too large."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 400).cast("double").alias("distance_m"),
        (F.col("o_custkey") % 61 - 30).cast("double").alias("elevation_m"),
        F.when(F.col("o_orderkey") % 17 != 0, (F.col("o_totalprice") / 40)).otherwise(0.0).alias("duration_s"),
    )
    rules = climbs.QualityRules()
    drift = climbs.altimetric_drift(rules, F.col("distance_m"), F.col("elevation_m"), F.col("duration_s"))
    return orders.groupBy(F.floor(F.col("distance_m") / 50).cast("int").alias("tens")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(drift.cast("long")).alias("drifting")
    )


_RULES = climbs.QualityRules()
DRIFT_SQL = f"""
WITH o AS (SELECT o_orderkey % 400 AS d, o_custkey % 61 - 30 AS z, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 40 ELSE 0.0 END AS s FROM orders)
SELECT CAST(d // 50 AS INTEGER) AS tens, count(*) AS n,
       CAST(sum(CASE WHEN d < {_RULES.loop_distance_m} AND s > 0 AND abs(z) / s > {_RULES.max_loop_rate_ms} THEN 1 ELSE 0 END) AS BIGINT) AS drifting
FROM o GROUP BY 1
"""


def day_means(spark: SparkSession, sf: str) -> DataFrame:
    """Unweighted means of the line items of a supplier's day."""
    items = table(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return compact(panel.day_features(items, ["l_suppkey"], ["l_quantity", "l_discount"]))


MEANS_SQL = """
SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, count(*) AS climbs, round(avg(l_quantity), 6) AS l_quantity,
       round(avg(l_discount), 6) AS l_discount
FROM lineitem GROUP BY 1, 2
"""

CHECKS = {
    "span_heart": Check(span_heart, HEART_SQL),
    "span_gaps": Check(span_gaps, GAPS_SQL),
    "hole_ascent": Check(hole_ascent, HOLE_SQL),
    "last_places": Check(last_places, PLACE_SQL),
    "closing_drift": Check(closing_drift, DRIFT_SQL),
    "day_means": Check(day_means, MEANS_SQL),
}
