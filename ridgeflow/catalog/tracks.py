"""Records, blocks, clocks, look-ups and intervals on events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeflow.catalog import Check
from ridgeflow.functions import geo
from ridgeflow.operators import clocks, islands, lookup, ordered, track
from ridgeflow.tables import compact, events, seconds, table

USER = ["user_id"]
GAP_S = 21600


def blocks_and_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    rows = track.with_blocks(
        events(spark, sf).select("user_id", "event_id", "time_s", "value"), USER, "time_s", GAP_S
    )
    out = track.centred_mean(rows, USER, "time_s", "block", ["value"])
    return compact(
        out.withColumn("block", F.col("block").cast("long")),
        "user_id",
        "event_id",
        "block",
        "hole_before",
        "value_s",
        "smooth_ok",
    )


BLOCKS_SQL = """
WITH r AS (
  SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, value,
         epoch_us(ts) / 1000000.0
           - lag(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts) AS step
  FROM events),
b AS (
  SELECT *, coalesce(step > 21600, false) AS hole_before,
         sum(CASE WHEN step > 21600 THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY t) AS block
  FROM r)
SELECT user_id, event_id, CAST(block AS BIGINT) AS block, hole_before,
       round(avg(value) OVER w, 6) AS value_s, count(*) OVER w = 5 AS smooth_ok
FROM b
WINDOW w AS (PARTITION BY user_id, block ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
"""

POSITION_SQL = "45 + (event_id % 100) * 0.0005 AS lat, 6 + (event_id % 77) * 0.0007 AS lon"


def located(spark: SparkSession, sf: str) -> DataFrame:
    """Events at positions derived from their number."""
    return events(spark, sf).select(
        "user_id",
        "event_id",
        "time_s",
        (45 + (F.col("event_id") % 100) * 0.0005).alias("lat"),
        (6 + (F.col("event_id") % 77) * 0.0007).alias("lon"),
        F.col("value").alias("ele"),
    )


def realized_distance(spark: SparkSession, sf: str) -> DataFrame:
    out = track.with_realized_distance(located(spark, sf), USER)
    return compact(out, "user_id", "event_id", "step_m", "realized_m", digits=4)


HAVERSINE_SQL = """2 * 6371008.8 * asin(sqrt(least(1.0, greatest(0.0,
    pow(sin(radians({b}lat - {a}lat) / 2), 2)
    + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))))"""

DISTANCE_SQL = f"""
WITH p AS (SELECT user_id, event_id, ts, {POSITION_SQL} FROM events),
q AS (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM p
      WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, coalesce({HAVERSINE_SQL.format(a="p_", b="")}, 0.0) AS step FROM q)
SELECT user_id, event_id, round(step, 4) AS step_m,
       round(sum(step) OVER (PARTITION BY user_id ORDER BY ts), 4) AS realized_m
FROM s
"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("user_id", "event_id", "time_s", "value")
    led = ordered.shift(rows, USER, ["time_s"], {"end_s": F.col("time_s")}, forward=True)
    steps = led.filter(F.col("end_s").isNotNull()).withColumn(
        "dt", F.col("end_s") - F.col("time_s")
    )
    return clocks.confirm(steps, USER, "time_s", "end_s", F.col("value") < 15, "run")


def _stopped(spark: SparkSession, sf: str) -> DataFrame:
    judged = F.when(F.col("value") < 15, clocks.IMMOBILE).when(
        F.col("value") < 30, clocks.INDETERMINATE
    ).otherwise(clocks.MOBILE)
    return _runs(spark, sf).withColumn(
        "state_0", clocks.state_of(judged, F.col("run_start"), F.col("run_end"), 43200.0)
    )


def stop_runs(spark: SparkSession, sf: str) -> DataFrame:
    totals = clocks.totals(_stopped(spark, sf), USER, count=1)
    return compact(
        totals, "user_id", "elapsed_s", "moving_s", "stopped_s", "undetermined_s", digits=3
    )


def stop_episodes(spark: SparkSession, sf: str) -> DataFrame:
    out = clocks.stop_episodes(_stopped(spark, sf), USER, 0)
    return compact(out, "user_id", "start_s", "end_s", "intervals", digits=3)


STATES_SQL = """
WITH r AS (
  SELECT user_id, epoch_us(ts) / 1000000.0 AS a,
         lead(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts) AS b, value
  FROM events),
s AS (SELECT *, value < 15 AS still FROM r WHERE b IS NOT NULL),
g AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a)
            - row_number() OVER (PARTITION BY user_id, still ORDER BY a) AS island
  FROM s),
t AS (
  SELECT *, min(a) OVER (PARTITION BY user_id, still, island) AS first_s,
         max(b) OVER (PARTITION BY user_id, still, island) AS last_s
  FROM g),
st AS (
  SELECT user_id, a, b, still, island, first_s, last_s,
         CASE WHEN still AND last_s - first_s >= 43200 THEN 'S'
              WHEN value >= 30 THEN 'M' ELSE 'U' END AS state
  FROM t)
"""

STOP_SQL = STATES_SQL + """
SELECT user_id, round(sum(b - a), 3) AS elapsed_s,
       round(sum(CASE WHEN state = 'M' THEN b - a ELSE 0 END), 3) AS moving_s,
       round(sum(CASE WHEN state = 'S' THEN b - a ELSE 0 END), 3) AS stopped_s,
       round(sum(CASE WHEN state = 'U' THEN b - a ELSE 0 END), 3) AS undetermined_s
FROM st GROUP BY user_id
"""

EPISODES_SQL = STATES_SQL + """
SELECT user_id, round(first_s, 3) AS start_s, round(last_s, 3) AS end_s, count(*) AS intervals
FROM st WHERE state = 'S' GROUP BY user_id, first_s, last_s
"""


def _cumulated(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("user_id", "time_s", "value")
    moved = F.when(F.col("value") < 20, 0.0).otherwise(F.floor("value").cast("double"))
    return ordered.running(rows, USER, ["time_s"], {"distance_m": ("sum", moved)}).drop("value")


def time_at_distance(spark: SparkSession, sf: str) -> DataFrame:
    records = _cumulated(spark, sf)
    length = records.groupBy("user_id").agg(F.max("distance_m").alias("length_m"))
    probes = length.select(
        "user_id",
        F.explode(F.sequence(F.lit(0), F.floor(F.col("length_m") / 500).cast("int"))).alias("i"),
    ).withColumn("at_m", F.col("i") * 500.0)
    out = lookup.interpolated_at(
        probes, records, USER, "at_m", "distance_m", ["distance_m", "time_s"], ["time_s"]
    )
    return compact(
        out.filter(F.col("time_s_at").isNotNull()), "user_id", "i", "time_s_at", digits=3
    )


TIME_AT_SQL = """
WITH d AS (
  SELECT user_id, epoch_us(ts) / 1000000.0 AS t,
         sum(CASE WHEN value < 20 THEN 0.0 ELSE CAST(floor(value) AS DOUBLE) END)
           OVER (PARTITION BY user_id ORDER BY ts) AS d
  FROM events),
s AS (SELECT *, lead(d) OVER w AS d2, lead(t) OVER w AS t2 FROM d
      WINDOW w AS (PARTITION BY user_id ORDER BY d, t)),
p AS (SELECT user_id, unnest(range(0, CAST(floor(max(d) / 500) AS BIGINT) + 1)) AS i
      FROM d GROUP BY user_id)
SELECT p.user_id, CAST(p.i AS INTEGER) AS i,
       round(CASE WHEN s.d2 IS NULL THEN s.t
                  ELSE s.t + (p.i * 500.0 - s.d) / (s.d2 - s.d) * (s.t2 - s.t) END, 3) AS time_s_at
FROM p JOIN s ON s.user_id = p.user_id AND s.d <= p.i * 500.0
            AND (s.d2 > p.i * 500.0 OR s.d2 IS NULL)
"""


def _asof(spark: SparkSession, sf: str, strict: bool, forward: bool = False) -> DataFrame:
    rows = events(spark, sf)
    clicks = rows.filter(F.col("event_type").isin("click", "purchase")).select(
        "user_id", F.col("event_id").alias("probe_id"), F.col("time_s").alias("at_s")
    )
    buys = rows.filter(F.col("event_type") == "purchase").select(
        "user_id", "time_s", F.col("event_id").alias("found_id"), F.col("value").alias("found")
    )
    out = lookup.asof(
        clicks,
        buys,
        USER,
        "at_s",
        "time_s",
        ["time_s", "found_id", "found"],
        strict=strict,
        forward=forward,
    )
    return compact(
        out.withColumn("age_s", F.col("at_s") - F.col("time_s")).fillna(-1, ["found_id"]),
        "user_id",
        "probe_id",
        "found_id",
        "found",
        "age_s",
        digits=3,
    )


def _asof_sql(condition: str, pick: str) -> str:
    return f"""
WITH c AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t FROM events
           WHERE event_type IN ('click', 'purchase')),
b AS (SELECT user_id, event_id, value, epoch_us(ts) / 1000000.0 AS t FROM events
      WHERE event_type = 'purchase'),
m AS (SELECT c.user_id, c.event_id, {pick}(b.t) AS bt
      FROM c LEFT JOIN b ON b.user_id = c.user_id AND {condition}
      GROUP BY c.user_id, c.event_id)
SELECT c.user_id, c.event_id AS probe_id, coalesce(b.event_id, -1) AS found_id, round(b.value, 3) AS found,
       round(c.t - b.t, 3) AS age_s
FROM c JOIN m ON m.event_id = c.event_id
LEFT JOIN b ON b.user_id = c.user_id AND b.t = m.bt
"""


def _order_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as an interval of days: its date plus 3 to 20 days."""
    start = F.unix_date(F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select(
        "o_custkey",
        "o_orderkey",
        start.cast("double").alias("start_d"),
        (start + 3 + F.col("o_orderkey") % 18).cast("double").alias("end_d"),
    )


SPANS_SQL = """
WITH iv AS (
  SELECT o_custkey, o_orderkey,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS a,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3
              + o_orderkey % 18 AS DOUBLE) AS b
  FROM orders)
"""


def interval_union_cover(spark: SparkSession, sf: str) -> DataFrame:
    spans = _order_spans(spark, sf)
    covered = islands.covered_length(spans, ["o_custkey"], "start_d", "end_d")
    groups = islands.interval_groups(spans, ["o_custkey"], "start_d", "end_d")
    counts = groups.groupBy("o_custkey").agg(F.max("grp").alias("groups"))
    return compact(covered.join(counts, "o_custkey"))


COVER_SQL = SPANS_SQL + """,
r AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)
SELECT o_custkey, round(sum(greatest(0.0, b - greatest(a, coalesce(reach, a)))), 6) AS covered,
       CAST(sum(CASE WHEN reach IS NULL OR a >= reach THEN 1 ELSE 0 END) AS BIGINT) AS groups
FROM r GROUP BY o_custkey
"""


def interval_unions(spark: SparkSession, sf: str) -> DataFrame:
    return islands.interval_union(_order_spans(spark, sf), ["o_custkey"], "start_d", "end_d")


UNION_SQL = SPANS_SQL + """,
r AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END)
                OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM r)
SELECT o_custkey, min(a) AS start_d, max(b) AS end_d FROM g GROUP BY o_custkey, grp
"""


def overlap_times(spark: SparkSession, sf: str) -> DataFrame:
    """Days of each customer's orders inside each 90-day period."""
    spans = _order_spans(spark, sf)
    periods = spans.select("o_custkey", F.floor(F.col("start_d") / 90).alias("period")).union(
        spans.select("o_custkey", F.floor(F.col("end_d") / 90).alias("period"))
    ).distinct()
    periods = periods.withColumn("p0", F.col("period") * 90.0).withColumn(
        "p1", (F.col("period") + 1) * 90.0
    )
    pairs = lookup.overlap_join(
        spans, periods, ["o_custkey"], ("start_d", "end_d"), ("p0", "p1"), 90.0
    )
    common = F.least("end_d", "p1") - F.greatest("start_d", "p0")
    return pairs.groupBy("o_custkey", "period").agg(
        F.round(F.sum(common), 6).alias("days"), F.count(F.lit(1)).alias("orders")
    )


OVERLAP_SQL = SPANS_SQL + """,
p AS (SELECT o_custkey, o_orderkey, a, b,
             unnest(range(CAST(floor(a / 90) AS BIGINT), CAST(floor(b / 90) AS BIGINT) + 1)) AS period
      FROM iv)
SELECT o_custkey, period, round(sum(least(b, (period + 1) * 90.0) - greatest(a, period * 90.0)), 6) AS days,
       count(*) AS orders
FROM p WHERE b > period * 90.0 AND a < (period + 1) * 90.0
GROUP BY o_custkey, period
"""


def local_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Signed coordinates of each event in the frame of the previous one."""
    back = ordered.shift(
        located(spark, sf),
        USER,
        ["time_s"],
        {"q_lat": F.col("lat"), "q_lon": F.col("lon")},
    ).filter(F.col("q_lat").isNotNull())
    along, across = geo.along_across(
        F.col("q_lat"), F.col("q_lon"), F.lit(0.6), F.lit(0.8), F.col("lat"), F.col("lon")
    )
    share, offset = geo.foot_on_segment(
        F.col("q_lat"),
        F.col("q_lon"),
        F.lit(45.02),
        F.lit(6.02),
        F.col("lat"),
        F.col("lon"),
    )
    return compact(
        back.withColumn("along_m", along)
        .withColumn("across_m", across)
        .withColumn("share", share)
        .withColumn("offset_m", offset),
        "event_id",
        "along_m",
        "across_m",
        "share",
        "offset_m",
        digits=4,
    )


FRAMES_SQL = f"""
WITH p AS (SELECT user_id, event_id, ts, {POSITION_SQL} FROM events),
q AS (SELECT *, lag(lat) OVER w AS q_lat, lag(lon) OVER w AS q_lon FROM p
      WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
v AS (SELECT event_id,
        6371008.8 * cos(radians(q_lat)) * radians(lon - q_lon) AS x, 6371008.8 * radians(lat - q_lat) AS y,
        6371008.8 * cos(radians(q_lat)) * radians(6.02 - q_lon) AS bx, 6371008.8 * radians(45.02 - q_lat) AS by_
      FROM q WHERE q_lat IS NOT NULL),
f AS (SELECT *, CASE WHEN bx * bx + by_ * by_ > 0
                 THEN least(1.0, greatest(0.0, (x * bx + y * by_) / (bx * bx + by_ * by_))) ELSE 0.0 END AS sh FROM v)
SELECT event_id, round(x * 0.6 + y * 0.8, 4) AS along_m, round(y * 0.6 - x * 0.8, 4) AS across_m,
       round(sh, 4) AS share, round(sqrt(pow(x - sh * bx, 2) + pow(y - sh * by_, 2)), 4) AS offset_m
FROM f
"""


def heart_rate_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of an interpolated channel over the two hours after each click; steps
    longer than a day are not linked."""
    rows = events(spark, sf)
    scale = 8640.0  # one day becomes the ten-second link of the channel
    samples = rows.select(
        "user_id", (F.col("time_s") / scale).alias("time_s"), F.col("value").alias("bpm")
    )
    spans = rows.filter(F.col("event_type") == "click").select(
        "user_id",
        "event_id",
        (F.col("time_s") / scale).alias("a"),
        ((F.col("time_s") + 7200) / scale).alias("b"),
    )
    out = track.heart_rate_over(spans, samples, USER, "a", "b", coverage=0.5)
    return compact(out, "user_id", "event_id", "hr_mean", digits=4)


HEART_SQL = """
WITH r AS (SELECT user_id, epoch_us(ts) / 1000000.0 / 8640.0 AS t, value AS v FROM events),
s AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM r
      WINDOW w AS (PARTITION BY user_id ORDER BY t)),
e AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM r GROUP BY user_id),
c AS (SELECT ev.user_id, event_id, epoch_us(ts) / 1000000.0 / 8640.0 AS a,
             (epoch_us(ts) / 1000000.0 + 7200) / 8640.0 AS b
      FROM events ev WHERE event_type = 'click'),
x AS (
  SELECT c.user_id, c.event_id, c.a, c.b,
         greatest(s.t, c.a) AS u0, least(s.t2, c.b) AS u1, s.t, s.t2, s.v, s.v2
  FROM c LEFT JOIN s ON s.user_id = c.user_id AND s.t2 > c.a AND s.t < c.b AND s.t2 - s.t <= 10),
g AS (
  SELECT user_id, event_id, a, b,
         sum(((v + (v2 - v) / (t2 - t) * (u0 - t)) + (v + (v2 - v) / (t2 - t) * (u1 - t))) / 2
             * (u1 - u0)) AS area,
         sum(u1 - u0) AS cover
  FROM x GROUP BY user_id, event_id, a, b)
SELECT g.user_id, event_id,
       round(CASE WHEN a >= lo AND b <= hi AND cover > 0 AND cover >= 0.5 * (b - a) - 1e-6
                  THEN area / cover END, 4) AS hr_mean
FROM g JOIN e ON e.user_id = g.user_id
"""


def span_overlap_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Time and gain of each user's rising steps inside week spans, partial at the ends."""
    rows = events(spark, sf).select("user_id", "time_s", "value")
    led = ordered.shift(
        rows, USER, ["time_s"], {"end_s": F.col("time_s"), "v2": F.col("value")}, forward=True
    ).filter(F.col("end_s").isNotNull())
    up = F.col("v2") > F.col("value")
    steps = led.withColumn(
        "up_s", F.when(up, F.col("end_s") - F.col("time_s")).otherwise(0.0)
    ).withColumn("up_m", F.when(up, F.col("v2") - F.col("value")).otherwise(0.0))
    summed = ordered.running(
        steps, USER, ["time_s"], {"c_s": ("sum", F.col("up_s")), "c_m": ("sum", F.col("up_m"))}
    )
    bounds = summed.groupBy("user_id").agg(F.min("time_s").alias("t0"), F.max("end_s").alias("t1"))
    week = 604800.0
    marks = bounds.select(
        "user_id",
        "t0",
        "t1",
        F.explode(
            F.sequence(F.floor(F.col("t0") / week), F.floor(F.col("t1") / week) + 1)
        ).alias("week"),
    ).withColumn("at", F.least(F.greatest(F.col("week") * week, F.col("t0")), F.col("t1")))
    taken = ["time_s", "end_s", "up_s", "up_m", "c_s", "c_m"]
    read = lookup.asof(
        marks.select("user_id", "week", "at"),
        summed.select("user_id", *(F.col(c).alias(f"s_{c}") for c in taken)),
        USER,
        "at",
        "s_time_s",
        [f"s_{c}" for c in taken],
    )
    left = (F.col("s_end_s") - F.least(F.col("at"), F.col("s_end_s"))) / (
        F.col("s_end_s") - F.col("s_time_s")
    )
    read = read.withColumn("r_s", F.col("s_c_s") - F.col("s_up_s") * left).withColumn(
        "r_m", F.col("s_c_m") - F.col("s_up_m") * left
    )
    nxt = ordered.shift(read, USER, ["week"], {"e_s": F.col("r_s"), "e_m": F.col("r_m")}, forward=True)
    out = nxt.filter(F.col("e_s").isNotNull())
    return compact(
        out.withColumn("state_s", F.col("e_s") - F.col("r_s")).withColumn(
            "state_gain", F.col("e_m") - F.col("r_m")
        ),
        "user_id",
        "week",
        "state_s",
        "state_gain",
        digits=3,
    )


GAIN_SQL = """
WITH r AS (
  SELECT user_id, epoch_us(ts) / 1000000.0 AS a, value AS v, lead(value) OVER w AS v2,
         lead(epoch_us(ts) / 1000000.0) OVER w AS b
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT * FROM r WHERE b IS NOT NULL),
p AS (SELECT *, unnest(range(CAST(floor(a / 604800) AS BIGINT), CAST(floor(b / 604800) AS BIGINT) + 1)) AS week FROM s),
o AS (SELECT user_id, week,
        CASE WHEN v2 > v THEN least(b, (week + 1) * 604800.0) - greatest(a, week * 604800.0) ELSE 0.0 END AS x,
        CASE WHEN v2 > v THEN (v2 - v) * (least(b, (week + 1) * 604800.0) - greatest(a, week * 604800.0)) / (b - a)
             ELSE 0.0 END AS y
      FROM p)
SELECT user_id, week, round(sum(x), 3) AS state_s, round(sum(y), 3) AS state_gain
FROM o GROUP BY user_id, week
"""


def channel_view(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as channels of an order: instants (line numbers) with both."""
    items = table(spark, sf, "lineitem")
    name = F.when(F.col("l_returnflag") == "A", "position").when(
        F.col("l_returnflag") == "N", "elevation"
    ).otherwise("heart_rate")
    channels = items.select(
        F.col("l_suppkey").alias("activity_ref"),
        name.alias("channel"),
        F.col("l_orderkey").cast("double").alias("time_s"),
        F.col("l_quantity").alias("value"),
        F.when(name == "position", F.col("l_quantity")).alias("lat"),
        F.when(name == "position", F.col("l_discount")).alias("lon"),
    )
    view = track.channel_view(channels, ["activity_ref"], ["elevation"])
    return compact(view, "activity_ref", "time_s", "offset_s", "lat", "lon", "elevation")


CHANNEL_SQL = """
WITH p AS (SELECT l_suppkey AS r, CAST(l_orderkey AS DOUBLE) AS t, max(l_quantity) AS lat, max(l_discount) AS lon
           FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
e AS (SELECT l_suppkey AS r, CAST(l_orderkey AS DOUBLE) AS t, max(l_quantity) AS ele
      FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
j AS (SELECT p.r, p.t, lat, lon, ele FROM p JOIN e ON e.r = p.r AND e.t = p.t),
o AS (SELECT r, min(t) AS t0 FROM j GROUP BY r)
SELECT j.r AS activity_ref, j.t - t0 AS time_s, t0 AS offset_s, round(lat, 6) AS lat, round(lon, 6) AS lon,
       round(ele, 6) AS elevation
FROM j JOIN o ON o.r = j.r
"""


def motion_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Full chain on derived positions: series, exact windows, five conventions."""
    rows = located(spark, sf)
    # Two minutes of real time per second, so that steps fall under the hole limit.
    quick = rows.withColumn(
        "time_s", F.floor(F.col("time_s") / 900).cast("double")
    ).groupBy("user_id", "time_s").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("ele").alias("ele")
    )
    near = quick.withColumn("lat", 45 + (F.col("lat") - 45) / 4000).withColumn(
        "lon", 6 + (F.col("lon") - 6) / 4000
    ).withColumn("ele", F.col("ele") / 200)
    series = track.build_series(near, USER)
    totals = clocks.totals(clocks.clock_partition(series, USER), USER)
    return compact(totals, digits=3)


CHECKS = {
    "blocks_and_smoothing": Check(blocks_and_smoothing, BLOCKS_SQL),
    "realized_distance": Check(realized_distance, DISTANCE_SQL),
    "stop_runs": Check(stop_runs, STOP_SQL),
    "stop_episodes": Check(stop_episodes, EPISODES_SQL),
    "time_at_distance": Check(time_at_distance, TIME_AT_SQL),
    "asof_last_purchase": Check(
        lambda s, d: _asof(s, d, False), _asof_sql("b.t <= c.t", "max")
    ),
    "asof_before_purchase": Check(
        lambda s, d: _asof(s, d, True), _asof_sql("b.t < c.t", "max")
    ),
    "asof_next_purchase": Check(
        lambda s, d: _asof(s, d, True, True), _asof_sql("b.t > c.t", "min")
    ),
    "interval_union_cover": Check(interval_union_cover, COVER_SQL),
    "interval_unions": Check(interval_unions, UNION_SQL),
    "overlap_times": Check(overlap_times, OVERLAP_SQL),
    "local_frames": Check(local_frames, FRAMES_SQL),
    "heart_rate_windows": Check(heart_rate_windows, HEART_SQL),
    "span_overlap_gain": Check(span_overlap_gain, GAIN_SQL),
    "channel_view": Check(channel_view, CHANNEL_SQL),
    "motion_sessions": Check(motion_sessions),
}

__all__ = ["CHECKS", "seconds"]
