"""Climbs, matching, retention and origin rules on events, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeflow.catalog import Check
from ridgeflow.operators import (
    climbs,
    clocks,
    matching,
    ordered,
    origin,
    passages,
    route,
    track,
)
from ridgeflow.session import cut_lineage
from ridgeflow.tables import compact, day_number, events, table

USER = ["user_id"]
METRE = 1 / 111195.07973436875  # degrees of latitude


def zigzag_climbs(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("user_id", "time_s", "value")
    out = climbs.zigzag(rows, USER, "time_s", "value", 25.0)
    return compact(
        out.withColumnRenamed("low", "low_s").withColumnRenamed("high", "high_s"), digits=3
    )


ZIGZAG_SQL = """
WITH RECURSIVE e AS (SELECT user_id, value AS z, epoch_us(ts) / 1000000.0 AS t,
                            row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
f AS (
  SELECT user_id, i, t AS lt, z AS lz, t AS ht, z AS hz, false AS up, false AS done, t AS dlt, z AS dlz, t AS dht, z AS dhz
  FROM e WHERE i = 1
  UNION ALL
  SELECT f.user_id, e.i,
    CASE WHEN (NOT up AND e.z < lz) OR (up AND e.z <= hz AND hz - e.z >= 25) THEN e.t ELSE lt END,
    CASE WHEN (NOT up AND e.z < lz) OR (up AND e.z <= hz AND hz - e.z >= 25) THEN e.z ELSE lz END,
    CASE WHEN (NOT up AND e.z >= lz AND e.z - lz >= 25) OR (up AND e.z > hz) THEN e.t ELSE ht END,
    CASE WHEN (NOT up AND e.z >= lz AND e.z - lz >= 25) OR (up AND e.z > hz) THEN e.z ELSE hz END,
    (up OR (e.z >= lz AND e.z - lz >= 25)) AND NOT (up AND e.z <= hz AND hz - e.z >= 25),
    up AND e.z <= hz AND hz - e.z >= 25, lt, lz, ht, hz
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1),
n AS (SELECT user_id, max(i) AS i FROM e GROUP BY user_id)
SELECT user_id, round(dlt, 3) AS low_s, round(dlz, 3) AS low_z, round(dht, 3) AS high_s, round(dhz, 3) AS high_z
FROM f WHERE done
UNION ALL
SELECT f.user_id, round(lt, 3), round(lz, 3), round(ht, 3), round(hz, 3)
FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i WHERE up
"""


def _spans(spark: SparkSession, sf: str, shift: int, grow: int) -> DataFrame:
    start = day_number("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_custkey",
        "o_orderkey",
        (start + shift).cast("double").alias("a"),
        (start + shift + 10 + F.col("o_orderkey") % 23 + grow).cast("double").alias("b"),
    )


def jaccard_best_match(spark: SparkSession, sf: str) -> DataFrame:
    """Order spans against two shifted variants of every span of the customer."""
    reference = _spans(spark, sf, 0, 0).select(
        "o_custkey", F.col("o_orderkey").alias("ref"), F.col("a").alias("start_s"), F.col("b").alias("end_s")
    )
    variants = [
        _spans(spark, sf, s, g).select(
            "o_custkey",
            F.lit(f"v{s}").alias("variant"),
            F.col("a").alias("v_start_s"),
            F.col("b").alias("v_end_s"),
            F.col("o_orderkey").alias("v_ref"),
        )
        for s, g in ((3, 0), (6, 4))
    ]
    out = climbs.best_matches(
        reference, variants[0].unionByName(variants[1]), ["o_custkey"], cell_s=30.0, min_jaccard=0.5
    )
    return compact(out, "o_custkey", "ref", "variant", "jaccard", "v_start_s")


JACCARD_SQL = """
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k,
                  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders),
r AS (SELECT c, k, d AS a, d + 10 + k % 23 AS b FROM o),
v AS (SELECT c, 'v3' AS variant, d + 3 AS a, d + 13 + k % 23 AS b FROM o
      UNION ALL SELECT c, 'v6', d + 6, d + 20 + k % 23 FROM o),
j AS (SELECT r.c, r.k, variant, v.a AS va, (least(r.b, v.b) - greatest(r.a, v.a)) / (greatest(r.b, v.b) - least(r.a, v.a)) AS jac
      FROM r JOIN v ON v.c = r.c AND r.a < v.b AND v.a < r.b),
p AS (SELECT *, row_number() OVER (PARTITION BY c, k, variant ORDER BY jac DESC, va) AS n FROM j)
SELECT c AS o_custkey, k AS ref, variant, round(jac, 6) AS jaccard, round(va, 6) AS v_start_s FROM p WHERE n = 1 AND jac >= 0.5
"""


def climb_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Stability of each order span: share of two variants that find it, largest gap."""
    reference = _spans(spark, sf, 0, 0).select(
        "o_custkey", F.col("o_orderkey").alias("ref"), F.col("a").alias("start_s"), F.col("b").alias("end_s"),
        (1 + F.col("o_orderkey") % 40).cast("double").alias("speed"),
    )
    variants = [
        _spans(spark, sf, s, g).select(
            "o_custkey", F.lit(f"v{s}").alias("variant"), F.col("a").alias("v_start_s"),
            F.col("b").alias("v_end_s"), ((1 + F.col("o_orderkey") % 40) * (1 + s / 100)).alias("v_speed"),
        )
        for s, g in ((3, 0), (6, 4))
    ]
    matches = climbs.best_matches(
        reference.drop("speed"), variants[0].unionByName(variants[1]), ["o_custkey"], cell_s=30.0
    )
    found = matches.withColumn("v_speed", F.col("v_speed"))
    out = climbs.climb_stability(reference, found, ["o_custkey"], 2)
    return compact(out.groupBy("stable", "found_fraction").agg(F.count(F.lit(1)).alias("climbs")))


STABILITY_SQL = JACCARD_SQL[: JACCARD_SQL.rindex("SELECT c AS o_custkey")].replace(
    "j AS (SELECT r.c, r.k, variant, v.a AS va,", "j AS (SELECT r.c, r.k, variant, v.a AS va, v.speed AS vs,"
).replace("d + 13 + k % 23 AS b FROM o", "d + 13 + k % 23 AS b, (1 + k % 40) * 1.03 AS speed FROM o").replace(
    "d + 6, d + 20 + k % 23 FROM o", "d + 6, d + 20 + k % 23, (1 + k % 40) * 1.06 FROM o"
) + """,
f AS (SELECT c, k, count(*) AS found, max(abs(vs / (1 + k % 40) - 1)) AS gap FROM p WHERE n = 1 AND jac >= 0.5 GROUP BY 1, 2),
a AS (SELECT coalesce(found, 0) / 2.0 AS found_fraction, coalesce(found / 2.0 >= 0.8 AND gap < 0.05, false) AS stable
      FROM r LEFT JOIN f ON f.c = r.c AND f.k = r.k)
SELECT stable, round(found_fraction, 6) AS found_fraction, count(*) AS climbs FROM a GROUP BY 1, 2
"""


def month_flow(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    out = climbs.month_flow(
        orders,
        "o_orderpriority",
        "o_orderdate",
        {
            "climbs": F.lit(True),
            "flagged": F.col("o_orderstatus") == "P",
            "kept": (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 250000),
        },
    )
    return out.select("o_orderpriority", "month", "climbs", "flagged", "kept")


FLOW_SQL = """
WITH m AS (SELECT strftime(unnest(generate_series(date_trunc('month', (SELECT min(o_orderdate) FROM orders))::TIMESTAMP,
             date_trunc('month', (SELECT max(o_orderdate) FROM orders))::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m') AS month),
p AS (SELECT DISTINCT o_orderpriority FROM orders),
g AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n,
             sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS f,
             sum(CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 250000 THEN 1 ELSE 0 END) AS k FROM orders GROUP BY 1, 2)
SELECT p.o_orderpriority, m.month, coalesce(n, 0) AS climbs, CAST(coalesce(f, 0) AS BIGINT) AS flagged,
       CAST(coalesce(k, 0) AS BIGINT) AS kept
FROM p CROSS JOIN m LEFT JOIN g ON g.o_orderpriority = p.o_orderpriority AND g.month = m.month
"""


def figure_points(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as climbs of an order with values per convention."""
    items = table(spark, sf, "lineitem")
    q, t = F.col("l_quantity"), F.col("l_extendedprice") / 1000 + 1

    def five(value, step):
        return F.array(*(value * (1 + step * k) for k in range(5)))

    rows = items.select(
        F.col("l_orderkey").alias("activity_ref"),
        F.col("l_returnflag").alias("panel"),
        F.col("l_linestatus").alias("stratum"),
        five(F.when(F.col("l_linenumber") == 7, 0.0).otherwise(t), 0.01).alias("moving_s"),
        five(t, -0.02).alias("undetermined_s"),
        five(q - 10.3, 0.005).alias("moving_gain_m"),
        five(q, -0.01).alias("undetermined_gain_m"),
    )
    out = climbs.figure_points(rows, ["panel", "stratum", "activity_ref"], ["panel", "stratum"])
    return compact(out, digits=8)


FIGURE_SQL = """
WITH r AS (SELECT l_orderkey AS a, l_returnflag AS p, l_linestatus AS s, count(*) AS n,
                  sum(CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_extendedprice / 1000 + 1 END) AS t,
                  sum(l_extendedprice / 1000 + 1) AS u, sum(l_quantity - 10.3) AS g, sum(l_quantity) AS h
           FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT unnest(range(0, 5)) AS k),
v AS (SELECT a, p, s, CASE WHEN t > 0 THEN g * (1 + 0.005 * k) / (t * (1 + 0.01 * k)) END AS x,
             CASE WHEN t * (1 + 0.01 * k) + u * (1 - 0.02 * k) > 0
                  THEN (g * (1 + 0.005 * k) + h * (1 - 0.01 * k)) / (t * (1 + 0.01 * k) + u * (1 - 0.02 * k)) END AS y
      FROM r CROSS JOIN k),
e AS (SELECT a, p, s, least(min(x), min(y)) AS lo, greatest(max(x), max(y)) AS hi FROM v GROUP BY 1, 2, 3),
c AS (SELECT r.*, CASE WHEN t > 0 THEN g * 1.005 / (t * 1.01) END AS sp FROM r),
z AS (SELECT p, s, count(DISTINCT a) AS m FROM c WHERE sp > 0 GROUP BY 1, 2)
SELECT c.a AS activity_ref, c.p AS panel, c.s AS stratum, n AS climbs, round(g * 1.005, 8) AS gain_m,
       round(t * 1.01, 8) AS moving_s, round(sp, 8) AS speed_ms, round(lo, 8) AS speed_low_ms, round(hi, 8) AS speed_high_ms,
       CASE WHEN coalesce(sp, 0) <= 0 THEN 'non_positive' WHEN coalesce(m, 0) < 5 THEN 'small_facet' ELSE 'shown' END AS status
FROM c JOIN e ON e.a = c.a AND e.p = c.p AND e.s = c.s LEFT JOIN z ON z.p = c.p AND z.s = c.s
"""


def quality_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Flags, regimes and strata of line items seen as measured climbs, counted."""
    items = table(spark, sf, "lineitem")
    rules, low = climbs.QualityRules(), 0.05
    rows = items.select(
        (F.col("l_discount") * 4).alias("outside_gain_fraction"),
        (F.col("l_tax") * 2).alias("slow_fraction"),
        (F.col("l_quantity") / 55).alias("vertical_speed_ms"),
        (F.col("l_linenumber") * 2.0).alias("horizontal_speed_ms"),
        (F.col("l_quantity") / 14).alias("max_vertical_rate_ms"),
        F.when(F.col("l_partkey") % 9 != 0, F.col("l_linenumber") * 1.0).alias("sinuosity"),
        (F.col("l_quantity") / 120).alias("grade"),
        (F.col("l_extendedprice") / 30).alias("moving_mean_elevation_m"),
        (F.col("l_quantity") * 6).alias("gain_m"),
        F.when(F.col("l_returnflag") == "A", "foot").when(F.col("l_returnflag") == "N", "ski_touring")
        .otherwise("bike").alias("sport"),
        (F.col("l_suppkey") % 2 == 0).alias("barometric"),
    )
    tagged = rows.select(
        climbs.climb_flags(
            rules, low, barometric=F.col("barometric"), drift=F.lit(False), sport=F.col("sport")
        ).alias("flags"),
        climbs.climb_regime(rules, F.col("gain_m"), F.col("sport")).alias("regime"),
        climbs.grade_stratum(rules, low).alias("grade_stratum"),
        climbs.altitude_stratum(rules).alias("altitude_stratum"),
    )
    return tagged.groupBy("regime", "grade_stratum", "altitude_stratum").agg(
        F.count(F.lit(1)).alias("climbs"),
        F.sum(F.size("flags")).alias("flags"),
        F.sum(F.when(F.array_contains("flags", "non_human"), 1).otherwise(0)).alias("non_human"),
    )


QUALITY_SQL = """
WITH r AS (SELECT l_discount * 4 AS o, l_tax * 2 AS sl, l_quantity / 55 AS v, l_linenumber * 2.0 AS h, l_quantity / 14 AS rate,
                  CASE WHEN l_partkey % 9 <> 0 THEN l_linenumber * 1.0 END AS si, l_quantity / 120 AS g,
                  l_extendedprice / 30 AS z, l_quantity * 6 AS gain, l_suppkey % 2 = 0 AS baro,
                  CASE l_returnflag WHEN 'A' THEN 'foot' WHEN 'N' THEN 'ski' ELSE 'bike' END AS sport FROM lineitem),
t AS (SELECT *, si IS NULL OR si > 6 OR g <= 0.05 AS unresolved,
             v > 3000.0 / 3600 OR (sport = 'foot' AND h > 10) AS fast FROM r)
SELECT CASE WHEN sport = 'foot' AND gain <= 75 THEN 'short_climb' WHEN sport = 'foot' AND gain >= 225 THEN 'long_climb'
            WHEN sport = 'foot' THEN 'intermediate' WHEN sport = 'ski' AND gain > 75 THEN 'ski_touring'
            WHEN sport = 'ski' THEN 'short_ski_touring' ELSE 'other_sport' END AS regime,
       CASE WHEN unresolved THEN 'unresolved' WHEN g <= 0.15 THEN 'moderate' WHEN g <= 0.3 THEN 'steep' ELSE 'very_steep' END AS grade_stratum,
       CASE WHEN z < 1500 THEN 'low' WHEN z < 2500 THEN 'mid' ELSE 'high' END AS altitude_stratum, count(*) AS climbs,
       CAST(sum(CASE WHEN o > 0.2 THEN 1 ELSE 0 END + CASE WHEN sl > 0.1 THEN 1 ELSE 0 END + CASE WHEN fast THEN 1 ELSE 0 END
           + CASE WHEN rate > 3 THEN 1 ELSE 0 END + CASE WHEN unresolved THEN 1 ELSE 0 END + CASE WHEN NOT baro THEN 1 ELSE 0 END) AS BIGINT) AS flags,
       CAST(sum(CASE WHEN fast THEN 1 ELSE 0 END) AS BIGINT) AS non_human
FROM t GROUP BY 1, 2, 3
"""


def device_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_custkey",
        day_number("o_orderdate").cast("double").alias("start_s"),
        F.col("o_orderkey").alias("activity_ref"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("manufacturer"),
        F.col("o_orderpriority").substr(1, 1).alias("product"),
    )
    return climbs.device_changes(rows, ["o_custkey"]).select(
        "o_custkey", "activity_ref", "manufacturer", "product"
    )


CHANGE_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus AS m, substr(o_orderpriority, 1, 1) AS p
           FROM orders WHERE o_orderkey % 5 <> 0),
l AS (SELECT *, lag(m) OVER w AS pm, lag(p) OVER w AS pp FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey AS activity_ref, m AS manufacturer, p AS product FROM l WHERE pm IS NOT NULL AND (m <> pm OR p <> pp)
"""


def retained_outings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a nation's day as outings: kept first or under four hours together."""
    rows = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    outings = rows.select(
        "c_nationkey",
        F.col("o_orderdate").cast("date").alias("civil_date"),
        (F.col("o_orderkey") % 1000).cast("double").alias("start_s"),
        F.col("o_orderkey").alias("outing_id"),
        F.round(F.col("o_totalprice") / 30).alias("elapsed_s"),
    )
    out = origin.retain_outings(outings, ["c_nationkey"])
    return out.select("outing_id", F.col("rank").cast("long").alias("rank"), "cumulated_s", "retained")


RETAIN_SQL = """
WITH o AS (SELECT c_nationkey AS n, CAST(o_orderdate AS DATE) AS d, o_orderkey % 1000 AS s, o_orderkey AS id, round(o_totalprice / 30) AS e
           FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT *, row_number() OVER w AS rank, sum(e) OVER w AS c FROM o
      WINDOW w AS (PARTITION BY n, d ORDER BY s, id ROWS UNBOUNDED PRECEDING))
SELECT id AS outing_id, rank, c AS cumulated_s, rank = 1 OR c < 14400 AS retained FROM r
"""


def origin_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as activities against the declared origins of each customer's orders."""
    start = day_number("o_orderdate").cast("double")
    orders = table(spark, sf, "orders")
    activities = orders.select(
        "o_custkey",
        F.col("o_orderkey").alias("activity_ref"),
        F.when(F.col("o_orderkey") % 8 != 0, start + 1).alias("index_end"),
        F.when(F.col("o_orderkey") % 5 != 0, start + 1 + F.col("o_orderkey") % 3).alias("safe_end"),
    )
    declared = orders.groupBy("o_custkey").agg(F.max(start).alias("origin"))
    windows = F.array(
        *(F.struct(F.lit(n).alias("window"), F.lit(d).alias("_d")) for n, d in (("year", 365), ("all", None)))
    )
    origins = declared.select("o_custkey", "origin", F.inline(windows))
    origins = origins.withColumn("bound", F.col("origin") - F.col("_d")).drop("_d")
    out = origin.select_at_origins(activities, origins, ["o_custkey"])
    return out.groupBy("o_custkey", "window", "decision").agg(F.count(F.lit(1)).alias("activities"))


DECISION_SQL = """
WITH a AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS s FROM orders),
e AS (SELECT c, k, CASE WHEN k % 8 <> 0 THEN s + 1 END AS ie, CASE WHEN k % 5 <> 0 THEN s + 1 + k % 3 END AS se FROM a),
o AS (SELECT c, max(s) AS o FROM a GROUP BY c),
w AS (SELECT c, o, 'year' AS win, o - 365 AS b FROM o UNION ALL SELECT c, o, 'all', NULL FROM o),
d AS (SELECT w.c, win, CASE WHEN b IS NOT NULL AND ie < b THEN 'before_window' WHEN se IS NULL THEN 'unknown_end'
             WHEN se >= o THEN 'after_origin' WHEN b IS NOT NULL AND se < b THEN 'before_window' ELSE 'candidate' END AS decision
      FROM e JOIN w ON w.c = e.c AND e.ie < w.o)
SELECT c AS o_custkey, win AS "window", decision, count(*) AS activities FROM d GROUP BY 1, 2, 3
"""


def origin_history(spark: SparkSession, sf: str) -> DataFrame:
    """What is known strictly before each order of a customer."""
    start = day_number("o_orderdate").cast("double")
    orders = table(spark, sf, "orders")
    activities = orders.select(
        "o_custkey",
        (start + 2).alias("safe_end"),
        F.col("o_orderpriority").alias("activity_type"),
        (F.col("o_orderkey") % 3 != 0).alias("has_recording"),
    )
    origins = orders.select("o_custkey", "o_orderkey", start.alias("origin"))
    out = origin.origin_history(activities, origins, ["o_custkey"], ["1-URGENT", "2-HIGH"])
    return out.drop("origin")


HISTORY_SQL = """
WITH a AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS p, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders)
SELECT x.c AS o_custkey, x.k AS o_orderkey, count(y.k) AS known,
       CAST(sum(CASE WHEN y.p IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS known_kind,
       CAST(sum(CASE WHEN y.k % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS known_recorded,
       sum(CASE WHEN y.p IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) = 0 AS cold_start
FROM a x LEFT JOIN a y ON y.c = x.c AND y.s + 2 < x.s GROUP BY 1, 2
"""


def attached_places(spark: SparkSession, sf: str) -> DataFrame:
    """Events as places on a route of their user's length: role and score point."""
    rows = events(spark, sf)
    lengths = rows.groupBy("user_id").agg((F.max("event_id") * 1.0 + 900).alias("length_m"))
    places = rows.join(lengths, "user_id").select(
        "event_id", (F.col("event_id") * 1.0).alias("at_m"), "length_m"
    )
    return passages.attach(places, 250.0).select("event_id", "role", "k", "snapped")


ATTACH_SQL = """
WITH l AS (SELECT user_id, max(event_id) + 900.0 AS len FROM events GROUP BY 1),
p AS (SELECT event_id, event_id * 1.0 AS s, CAST(len AS DOUBLE) AS len, CAST(ceil(len / 250) AS INTEGER) AS last FROM events JOIN l ON l.user_id = events.user_id),
k AS (SELECT *, least(CAST(floor(s / 250) AS INTEGER), last - 1) AS k FROM p),
a AS (SELECT *, CASE WHEN k + 1 = last THEN len ELSE (k + 1) * 250.0 END AS nxt FROM k)
SELECT event_id, CASE WHEN abs(len - s) < 1 THEN 'arrival' WHEN s < 1 THEN 'departure' ELSE 'intermediate' END AS role,
       CASE WHEN abs(len - s) < 1 THEN last WHEN s < 1 THEN 0 WHEN s - k * 250.0 < 1 THEN k WHEN nxt - s < 1 THEN k + 1 ELSE k END AS k,
       abs(len - s) < 1 OR s < 1 OR s - k * 250.0 < 1 OR nxt - s < 1 AS snapped
FROM a
"""


def stop_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Error events as stops, purchases near in time as candidate places."""
    rows = events(spark, sf)
    stops = rows.filter(F.col("event_type") == "error").select(
        "user_id", F.col("event_id").alias("stop"), F.col("time_s").alias("start_s"),
        (F.col("time_s") + 3600).alias("end_s"),
    )
    buys = rows.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("rank"), "time_s", F.floor(F.col("value") / 40).alias("away"),
        (F.col("time_s") - 86400).alias("w0"), (F.col("time_s") + 86400).alias("w1"),
    )
    from ridgeflow.operators.lookup import overlap_join

    pairs = overlap_join(stops, buys, USER, ("start_s", "end_s"), ("w0", "w1"), 86400.0, closed=True)
    delay = passages.time_distance(F.col("time_s"), F.col("start_s"), F.col("end_s"))
    candidates = pairs.withColumn("delay_s", F.floor(delay / 43200).cast("double")).withColumn(
        "away_m", F.col("away").cast("double")
    )
    out = passages.attribute(candidates, ["user_id", "stop"])
    return out.withColumn("passage", F.coalesce("passage", F.lit(-1)))


ATTRIBUTION_SQL = """
WITH s AS (SELECT user_id, event_id AS stop, epoch_us(ts) / 1000000.0 AS a, epoch_us(ts) / 1000000.0 + 3600 AS b FROM events WHERE event_type = 'error'),
p AS (SELECT user_id, event_id AS rank, epoch_us(ts) / 1000000.0 AS t, floor(value / 40) AS away FROM events WHERE event_type = 'purchase'),
c AS (SELECT s.user_id, stop, rank, away, floor(CASE WHEN t BETWEEN a AND b THEN 0.0 ELSE least(abs(t - a), abs(t - b)) END / 43200) AS d
      FROM s JOIN p ON p.user_id = s.user_id AND t - 86400 <= b AND a <= t + 86400),
n AS (SELECT * FROM (SELECT *, min(d) OVER (PARTITION BY user_id, stop) AS m FROM c) WHERE d - m <= 1),
k AS (SELECT * FROM (SELECT *, min(away) OVER (PARTITION BY user_id, stop) AS w, count(*) OVER (PARTITION BY user_id, stop) AS z FROM n)
      WHERE z = 1 OR away - w <= 1)
SELECT user_id, stop, CASE WHEN count(*) = 1 THEN max(rank) ELSE -1 END AS passage,
       CASE WHEN count(*) = 1 THEN 'attributed' ELSE 'tie' END AS outcome
FROM k GROUP BY 1, 2
"""


def chronology(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as places: violations between neighbours and at the end."""
    rows = table(spark, sf, "orders").select(
        "o_custkey",
        F.col("o_orderkey").alias("rank"),
        F.col("o_totalprice").alias("at_m"),
        (F.col("o_totalprice") / 1000 - F.col("o_orderkey") % 13).alias("arrival_s"),
        (F.col("o_totalprice") / 1000 + F.col("o_orderkey") % 17).alias("departure_s"),
        F.lit(5).alias("prefix_count"),
        F.lit(5).alias("k_last"),
        F.lit(480.0).alias("final_s"),
    )
    return passages.chronology(rows, ["o_custkey"])


CHRONOLOGY_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey AS rank, o_totalprice AS s, o_totalprice / 1000 - o_orderkey % 13 AS a,
                  o_totalprice / 1000 + o_orderkey % 17 AS d FROM orders),
l AS (SELECT *, lead(a) OVER w AS na, lag(d) OVER w AS pd, lead(rank) OVER w IS NULL AS last FROM o
      WINDOW w AS (PARTITION BY o_custkey ORDER BY s, rank))
SELECT o_custkey, rank, coalesce(d > na, false) OR coalesce(pd > a, false) OR (last AND d > 480) AS violation FROM l
"""

NATION = ["c_nationkey"]


def _nation_route(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a nation, 20.3 m apart along a meridian."""
    rows = ordered.running(
        table(spark, sf, "customer").select("c_nationkey", "c_custkey"),
        NATION,
        ["c_custkey"],
        {"seq": ("sum", F.lit(1))},
    )
    m = (F.col("seq") - 1) * 20.3
    return rows.select(
        "c_nationkey",
        "seq",
        (45 + m * METRE).alias("lat"),
        F.lit(6.0).alias("lon"),
        (500 + F.abs(m % 1600 - 800) * 0.15).alias("ele"),
    )


def _nation_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a nation's customers as records every 5 s, 2.2 m apart."""
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    rows = ordered.running(
        orders.select("c_nationkey", "o_orderkey"), NATION, ["o_orderkey"], {"n": ("sum", F.lit(1))}
    )
    m = (F.col("n") - 1) * 2.2
    return rows.select(
        "c_nationkey",
        ((F.col("n") - 1) * 5.0).alias("time_s"),
        (45 + m * METRE).alias("lat"),
        F.lit(6.00002).alias("lon"),
        (500 + F.abs(m % 1600 - 800) * 0.15).alias("ele"),
    )


def _matched(spark: SparkSession, sf: str):
    line = cut_lineage(route.polyline(_nation_route(spark, sf), NATION))
    series = track.build_series(_nation_trace(spark, sf), NATION)
    records = cut_lineage(matching.indexed(series, NATION))
    return line, records, matching.match_points(line, records, NATION)


def matched_points(spark: SparkSession, sf: str) -> DataFrame:
    _, _, points = _matched(spark, sf)
    return compact(points, "c_nationkey", "k", "status", "t", "d", digits=2)


NATION_SQL = """
WITH r AS (SELECT c_nationkey AS n, CAST((count(*) - 1) * 20.3 AS DOUBLE) AS len FROM customer GROUP BY 1),
t AS (SELECT c_nationkey AS n, count(*) AS records FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
g AS (SELECT n, len, unnest(range(0, CAST(ceil(len / 250) AS BIGINT) + 1)) AS k, ceil(len / 250) AS last FROM r),
s AS (SELECT g.n, k, len, CASE WHEN k = last THEN len ELSE CAST(k * 250.0 AS DOUBLE) END AS s, CAST((records - 1) * 2.2 AS DOUBLE) AS reach FROM g JOIN t ON t.n = g.n)
"""

POINT_SQL = NATION_SQL + """
SELECT n AS c_nationkey, CAST(k AS INTEGER) AS k,
       CASE WHEN s <= reach THEN 'found' WHEN s = len AND len - reach <= 30 THEN 'anchored' ELSE 'absent' END AS status,
       round(CASE WHEN s <= reach THEN s / 2.2 * 5 WHEN s = len AND len - reach <= 30 THEN reach / 2.2 * 5 END, 2) AS t,
       round(CASE WHEN s <= reach THEN s WHEN s = len AND len - reach <= 30 THEN reach END, 2) AS d
FROM s
"""


def matched_segments(spark: SparkSession, sf: str) -> DataFrame:
    line, records, points = _matched(spark, sf)
    profile = cut_lineage(route.build_profile(_nation_route(spark, sf), NATION))
    out = matching.observe_segments(points, line, profile, records, NATION)
    return compact(
        out.withColumn("elapsed_s", F.col("end_s") - F.col("start_s")),
        "c_nationkey",
        "k",
        "klass",
        "exclusion",
        "elapsed_s",
        "length_ratio",
        digits=3,
    )


def climb_table(spark: SparkSession, sf: str) -> DataFrame:
    """Climbs of every nation's trace: clocks, hysteresis, flats, time bounds, measures."""
    series = cut_lineage(track.build_series(_nation_trace(spark, sf), NATION))
    partition = cut_lineage(clocks.clock_partition(series, NATION))
    moves = cut_lineage(climbs.motion(partition, NATION))
    c = clocks.CENTRAL
    slim = moves.select(*NATION, "time_s", "realized_m", "ele_s", F.col(f"c_t_M_{c}").alias("moving_s"), F.col("c_moving_m").alias("moving_m"))
    profile = cut_lineage(
        route.build_profile(series.withColumn("seq", F.col("time_s")), NATION)
    )
    spans = cut_lineage(climbs.detect_climbs(slim, profile, NATION))
    out = climbs.measure_climbs(spans, moves, NATION)
    return compact(
        out, "c_nationkey", "start_s", "end_s", "gain_m", "moving_distance_m", "grade", "vertical_speed_ms", digits=3
    )


CHECKS = {
    "zigzag_climbs": Check(zigzag_climbs, ZIGZAG_SQL),
    "jaccard_best_match": Check(jaccard_best_match, JACCARD_SQL),
    "climb_stability": Check(climb_stability, STABILITY_SQL),
    "month_flow": Check(month_flow, FLOW_SQL),
    "figure_points": Check(figure_points, FIGURE_SQL),
    "quality_strata": Check(quality_strata, QUALITY_SQL),
    "device_changes": Check(device_changes, CHANGE_SQL),
    "retained_outings": Check(retained_outings, RETAIN_SQL),
    "origin_decisions": Check(origin_decisions, DECISION_SQL),
    "origin_history": Check(origin_history, HISTORY_SQL),
    "attached_places": Check(attached_places, ATTACH_SQL),
    "stop_attribution": Check(stop_attribution, ATTRIBUTION_SQL),
    "passage_chronology": Check(chronology, CHRONOLOGY_SQL),
    "matched_points": Check(matched_points, POINT_SQL),
    "matched_segments": Check(matched_segments),
    "climb_table": Check(climb_table),
}
