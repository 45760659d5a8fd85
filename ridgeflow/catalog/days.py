"""Day tables, nights, normals, merged exports and journals on events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeflow.catalog import Check
from ridgeflow.operators import days, experiments, panel
from ridgeflow.tables import compact, day_number, events, table

USER = ["user_id"]

DAY_SQL = "CAST(date_diff('day', DATE '1970-01-01', CAST({c} AS DATE)) AS INTEGER)"


def calendar_spine(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per day and priority class, empty days included."""
    orders = table(spark, sf, "orders").select(
        F.lit("all").alias("athlete"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderpriority").alias("activity_type"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("load"),
        F.when(F.col("o_orderkey") % 6 != 0, F.round(F.col("o_totalprice") / 1000)).alias(
            "elapsed_s"
        ),
    )
    families = {"foot": ["1-URGENT", "2-HIGH"], "bike": ["3-MEDIUM"]}
    sums = days.activity_columns(orders, ["athlete"], families)
    spine = days.calendar_spine(orders, ["athlete"]).join(sums, ["athlete", "day"], "left")
    return compact(days.empty_day_defaults(spine, list(families)), digits=2)


SPINE_SQL = """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p,
                  CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS load,
                  CASE WHEN o_orderkey % 6 <> 0 THEN round(o_totalprice / 1000) END AS e FROM orders),
c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM o)::TIMESTAMP, (SELECT max(day) FROM o)::TIMESTAMP,
                                         INTERVAL 1 DAY)) AS DATE) AS day),
g AS (SELECT day, count(*) AS n, sum(load) AS load, count(*) - count(load) AS nl,
             sum(CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN coalesce(e, 0) ELSE 0 END) AS foot,
             sum(CASE WHEN p = '3-MEDIUM' THEN coalesce(e, 0) ELSE 0 END) AS bike,
             sum(CASE WHEN p NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN coalesce(e, 0) ELSE 0 END) AS other,
             sum(CASE WHEN p NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1 ELSE 0 END) AS oc,
             count(*) - count(e) AS ne FROM o GROUP BY day)
SELECT 'all' AS athlete, c.day, coalesce(n, 0) AS activity_count,
       round(CASE WHEN n IS NULL THEN 0 ELSE load END, 2) AS training_load, coalesce(nl, 0) AS activities_without_load,
       round(coalesce(foot, 0), 2) AS foot_elapsed_s, round(coalesce(bike, 0), 2) AS bike_elapsed_s,
       round(coalesce(other, 0), 2) AS other_elapsed_s, CAST(coalesce(oc, 0) AS BIGINT) AS other_activity_count,
       coalesce(ne, 0) AS activities_without_elapsed
FROM c LEFT JOIN g ON g.day = c.day
"""


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    """Mean value per user and day on the calendar spine; admitted unless an error day."""
    rows = events(spark, sf).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.avg("value").alias("v"),
        F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("bad"),
        F.sort_array(F.collect_set(F.length("event_type"))).alias("ranks"),
        F.max(F.when(F.col("event_type") == "view", F.col("event_id") % 3)).alias("version"),
    )
    return days.on_spine(rows, USER).withColumn(
        "admitted", F.coalesce(F.col("bad") == 0, F.lit(False))
    )


DAILY_SQL = """
WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v,
                  max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS bad,
                  list_sort(list_distinct(list(length(event_type)))) AS ranks,
                  max(CASE WHEN event_type = 'view' THEN event_id % 3 END) AS version
           FROM events GROUP BY 1, 2),
b AS (SELECT user_id, min(day) AS a, max(day) AS z FROM r GROUP BY user_id),
c AS (SELECT user_id, CAST(unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
d AS (SELECT c.user_id, c.day, v, coalesce(bad = 0, false) AS admitted, ranks, version,
             date_diff('day', DATE '1970-01-01', c.day) AS n
      FROM c LEFT JOIN r ON r.user_id = c.user_id AND r.day = c.day)
"""


def _normals(spark: SparkSession, sf: str, log_scale: bool) -> DataFrame:
    rules = days.NormalRules(window_days=14, min_admitted=5, resolution=1.0, log_scale=log_scale)
    out = days.rolling_normals(_daily(spark, sf), USER, "v", "admitted", rules)
    shown = out.withColumn("admitted_days", F.col("admitted_days").cast("long")).withColumn(
        "segment", F.col("segment").cast("long")
    )
    return compact(
        shown,
        "user_id",
        "day",
        "normal",
        "dispersion",
        "range_low",
        "range_high",
        "admitted_days",
        "absence",
        "segment",
        digits=10,
    )


def _normal_sql(log_scale: bool) -> str:
    value = "ln(v)" if log_scale else "v"
    center = "exp(m)" if log_scale else "m"
    floor = "ln(1 + 1.0 / exp(m))" if log_scale else "1.0"
    low = "exp(m - s)" if log_scale else "m - s"
    high = "exp(m + s)" if log_scale else "m + s"
    return DAILY_SQL + f""",
p AS (SELECT d.user_id, d.day, d.n, {value.replace("v", "e.v")} AS x FROM d JOIN d e ON e.user_id = d.user_id
      AND e.n BETWEEN d.n - 14 AND d.n - 1 AND e.admitted),
m AS (SELECT user_id, day, count(*) AS k, median(x) AS m FROM p GROUP BY 1, 2),
a AS (SELECT p.user_id, p.day, median(abs(x - m)) AS mad FROM p JOIN m ON m.user_id = p.user_id AND m.day = p.day
      GROUP BY 1, 2),
f AS (SELECT d.user_id, d.day, coalesce(k, 0) AS k, CASE WHEN k >= 5 THEN m END AS m, mad
      FROM d LEFT JOIN m ON m.user_id = d.user_id AND m.day = d.day
      LEFT JOIN a ON a.user_id = d.user_id AND a.day = d.day),
g AS (SELECT *, CASE WHEN m IS NOT NULL THEN greatest(1.4826 * mad, {floor}) END AS s,
             CASE WHEN k = 0 THEN 'no_admitted_day' WHEN k < 5 THEN 'too_few_admitted_days' END AS absence FROM f)
SELECT user_id, day, round({center}, 10) AS normal, round(s, 10) AS dispersion, round({low}, 10) AS range_low,
       round({high}, 10) AS range_high, k AS admitted_days, absence,
       CAST(coalesce(sum(CASE WHEN absence IS NOT NULL THEN 1 ELSE 0 END)
         OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment
FROM g
"""


def ruptures_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = days.ruptures(_daily(spark, sf), USER, window_days=7)
    return compact(
        out, "user_id", "day", "rank_rupture", "version_rupture", "uncertain", "straddles"
    )


RUPTURE_SQL = DAILY_SQL + """,
k AS (SELECT *, coalesce(len(ranks), 0) AS c FROM d),
bb AS (SELECT *, last_value(CASE WHEN c > 0 THEN ranks END IGNORE NULLS) OVER w AS br,
             last_value(version IGNORE NULLS) OVER w AS bv
      FROM k WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rt AS (SELECT *, c > 0 AND br IS NOT NULL AND NOT list_has_all(br, coalesce(ranks, [])) AS rr,
             coalesce(version <> bv, false) AS vr FROM bb),
u AS (SELECT *, c >= 2 OR (c = 0 AND coalesce(first_value(CASE WHEN c > 0 THEN rr END IGNORE NULLS) OVER w, false)) AS unc
      FROM rt WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id, day, coalesce(rr, false) AS rank_rupture, vr AS version_rupture, unc AS uncertain,
       coalesce(bool_or(coalesce(rr, false) OR vr) OVER (PARTITION BY user_id ORDER BY n RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING), false)
       OR coalesce(bool_or(unc) OVER (PARTITION BY user_id ORDER BY n RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), false) AS straddles
FROM u
"""


def watch_normals(spark: SparkSession, sf: str) -> DataFrame:
    marked = days.ruptures(_daily(spark, sf), USER, window_days=7)
    out = panel.watch_normals(marked, USER, "v", "admitted", window_days=10, min_days=2)
    return compact(out, "user_id", "day", "watch_normal")


WATCH_SQL = DAILY_SQL + """,
k AS (SELECT *, coalesce(len(ranks), 0) AS c FROM d),
bb AS (SELECT *, last_value(CASE WHEN c > 0 THEN ranks END IGNORE NULLS) OVER w AS br
      FROM k WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rt AS (SELECT *, coalesce(c > 0 AND br IS NOT NULL AND NOT list_has_all(br, coalesce(ranks, [])), false) AS rr FROM bb),
e AS (SELECT *, sum(CASE WHEN rr THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS era FROM rt)
SELECT e.user_id, e.day, round(CASE WHEN count(f.v) >= 2 THEN median(f.v) END, 6) AS watch_normal
FROM e LEFT JOIN e f ON f.user_id = e.user_id AND f.era = e.era AND f.n BETWEEN e.n - 10 AND e.n - 1 AND f.admitted
GROUP BY e.user_id, e.day
"""


def series_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive days with the same admission."""
    runs = days.series_runs(_daily(spark, sf), USER, ["admitted"])
    return compact(
        runs.groupBy("user_id", "run", "admitted").agg(
            F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days")
        )
    )


RUNS_SQL = DAILY_SQL + """,
s AS (SELECT *, CASE WHEN lag(admitted) OVER w IS NULL OR lag(admitted) OVER w <> admitted THEN 1 ELSE 0 END AS f
      FROM d WINDOW w AS (PARTITION BY user_id ORDER BY n)),
t AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY n) AS run FROM s)
SELECT user_id, CAST(run AS BIGINT) AS run, admitted, min(day) AS first_day, count(*) AS days
FROM t GROUP BY 1, 2, 3
"""


def last_days(spark: SparkSession, sf: str) -> DataFrame:
    """The last ten days of every user's series: a report of a fixed length."""
    return compact(days.last_days(_daily(spark, sf), USER, 10), "user_id", "day", "admitted")


LAST_SQL = DAILY_SQL + """,
t AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS z FROM d)
SELECT user_id, day, admitted FROM t WHERE z - n < 10
"""


def lowest_window(spark: SparkSession, sf: str) -> DataFrame:
    points = events(spark, sf).select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value"
    )
    out = days.lowest_window(points, USER, "at", "value", 172_800_000_000, 0.5)
    return compact(
        out.withColumn("start_s", F.col("start") / 1e6).withColumn(
            "midpoint_s", F.col("midpoint") / 1e6
        ),
        "user_id",
        "start_s",
        "mean",
        "midpoint_s",
        digits=5,
    )


LOWEST_SQL = """
WITH r AS (SELECT user_id, epoch_us(ts) AS t, value AS v,
                  epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events),
m AS (SELECT user_id, median(step) AS med FROM r GROUP BY user_id),
w AS (SELECT r.user_id, t, avg(v) OVER x AS mean, count(*) OVER x AS n FROM r
      WINDOW x AS (PARTITION BY r.user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 172799999999 FOLLOWING)),
k AS (SELECT w.*, row_number() OVER (PARTITION BY w.user_id ORDER BY mean, t) AS pick
      FROM w JOIN m ON m.user_id = w.user_id WHERE n >= 0.5 * 172800000000 / med)
SELECT user_id, round(t / 1000000.0, 5) AS start_s, round(mean, 5) AS mean,
       round((t + 86400000000) / 1000000.0, 5) AS midpoint_s
FROM k WHERE pick = 1
"""


def _exports(spark: SparkSession, sf: str) -> DataFrame:
    """Events hashed into three overlapping exports of a user's day."""
    rows = events(spark, sf).withColumn("day", F.col("ts").cast("date"))
    listed = F.filter(
        F.array(F.lit(1), F.lit(2), F.lit(3)), lambda e: (F.col("event_id") + e * 7) % 3 != 0
    )
    return rows.withColumn("position", F.explode(listed))


def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One value per user and half day: that of the earliest export, others counted."""
    rows = _exports(spark, sf).groupBy(
        "user_id", F.floor(F.col("time_s") / 43200).alias("instant"), "position"
    ).agg(F.min("value").alias("value"))
    kept, duplicates = days.first_wins(rows, USER, "instant", "position")
    out = kept.join(duplicates, USER)
    return compact(out, "user_id", "instant", "position", "value", "duplicates")


FIRST_SQL = """
WITH x AS (SELECT user_id, ts, value, event_id, unnest([1, 2, 3]) AS pos FROM events),
g AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000.0 / 43200) AS BIGINT) AS instant, pos, min(value) AS v
      FROM x WHERE (event_id + pos * 7) % 3 <> 0 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, instant ORDER BY pos) AS r FROM g),
d AS (SELECT user_id, count(*) - count(DISTINCT instant) AS dup FROM g GROUP BY user_id)
SELECT k.user_id, instant, pos AS position, round(v, 6) AS value, dup AS duplicates
FROM k JOIN d ON d.user_id = k.user_id WHERE r = 1
"""


def _export_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = _exports(spark, sf).groupBy("user_id", "day", "position").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("v"), F.min("event_id").alias("e")
    )
    state = days.export_state(
        F.when(F.col("n") > 2, 86400.0).otherwise(80000.0), F.col("v") > 20, F.col("v") > 5
    )
    return rows.withColumn("state", state).withColumn("detail", F.col("n") > 3).withColumn(
        "window_start", F.col("e") % 2
    )


def export_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Reference export of each day, and where each family (event type) comes from."""
    references = days.reference_exports(_export_days(spark, sf), ["user_id", "day"])
    starts = _export_days(spark, sf).select("user_id", "day", "position", "window_start")
    families = (
        _exports(spark, sf)
        .groupBy("user_id", "day", "position", F.col("event_type").alias("family"))
        .agg(F.max("value").alias("value"))
        .join(starts, ["user_id", "day", "position"])
    )
    out = days.merge_families(families, references, ["user_id", "day"])
    return compact(out, "user_id", "day", "family", "position", "state", "value", "origin")


MERGE_SQL = """
WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, value, event_id, event_type, unnest([1, 2, 3]) AS pos FROM events),
y AS (SELECT * FROM x WHERE (event_id + pos * 7) % 3 <> 0),
s AS (SELECT user_id, day, pos, count(*) AS n, max(value) AS v, min(event_id) % 2 AS ws FROM y GROUP BY 1, 2, 3),
t AS (SELECT *, CASE WHEN v <= 5 THEN 'empty' WHEN v <= 20 THEN 'no_measurement' WHEN n <= 2 THEN 'truncated'
                     ELSE 'complete' END AS state FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY
        CASE WHEN state = 'complete' AND n > 3 THEN 0 WHEN state = 'complete' THEN 1 WHEN state = 'truncated' THEN 2
             WHEN state = 'no_measurement' THEN 3 ELSE 9 END, pos DESC) AS pick FROM t),
ref AS (SELECT user_id, day, pos, state, ws FROM r WHERE pick = 1),
f AS (SELECT y.user_id, y.day, y.pos, event_type AS family, max(value) AS value, max(s.ws) AS ws
      FROM y JOIN s ON s.user_id = y.user_id AND s.day = y.day AND s.pos = y.pos GROUP BY 1, 2, 3, 4),
p AS (SELECT f.*, ref.pos AS rp, ref.state, ref.ws AS rws,
             row_number() OVER (PARTITION BY f.user_id, f.day, family ORDER BY CASE WHEN f.pos = ref.pos THEN 0 ELSE 1 END, f.pos DESC) AS k
      FROM f JOIN ref ON ref.user_id = f.user_id AND ref.day = f.day)
SELECT user_id, day, family, pos AS position, state, round(value, 6) AS value,
       CASE WHEN pos = rp THEN 'own' WHEN ws <> rws THEN 'refused' ELSE 'borrowed' END AS origin
FROM p WHERE k = 1
"""


def export_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf differences between the reference export and the others, per family."""
    references = days.reference_exports(_export_days(spark, sf), ["user_id", "day"])
    leaves = _exports(spark, sf).groupBy(
        "user_id", "day", "position", F.col("event_type").alias("family")
    ).agg(F.max("value").alias("value")).withColumn("path", F.lit("value"))
    return days.compare_exports(leaves, references, ["user_id", "day"])


DIFF_SQL = MERGE_SQL[: MERGE_SQL.index("p AS (SELECT f.*")] + """
l AS (SELECT f.user_id, f.day, family, max(CASE WHEN f.pos = ref.pos THEN value END) AS own,
             min(CASE WHEN f.pos <> ref.pos THEN value END) AS lo, max(CASE WHEN f.pos <> ref.pos THEN value END) AS hi
      FROM f JOIN ref ON ref.user_id = f.user_id AND ref.day = f.day GROUP BY 1, 2, 3),
c AS (SELECT family, CASE WHEN own IS NULL THEN 'borrowing' WHEN lo IS NULL THEN 'degradation'
                          WHEN lo <> own OR hi <> own THEN 'revision' END AS kind FROM l)
SELECT family, 'value' AS path, kind, count(*) AS days FROM c WHERE kind IS NOT NULL GROUP BY 1, 3
"""


def decisive_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Order statuses as exports of a customer's months: kept and retired months."""
    rows = table(spark, sf, "orders").select(
        "o_custkey",
        F.month("o_orderdate").alias("activity_ref"),
        F.year("o_orderdate").alias("position"),
        F.col("o_orderpriority").alias("sha"),
    )
    kept, retired = experiments.decisive_exports(rows, ["o_custkey"])
    return kept.withColumn("kind", F.lit("kept")).unionByName(
        retired.withColumn("kind", F.lit("retired"))
    )


DECISIVE_SQL = """
WITH e AS (SELECT o_custkey, CAST(month(o_orderdate) AS INTEGER) AS a, CAST(year(o_orderdate) AS INTEGER) AS p,
                  o_orderpriority AS s FROM orders),
l AS (SELECT o_custkey, max(p) AS last FROM e GROUP BY 1),
g AS (SELECT o_custkey, a, max(p) AS d, count(*) AS n, count(DISTINCT s) AS v FROM e GROUP BY 1, 2)
SELECT g.o_custkey, a AS activity_ref, d AS decisive, n AS exports, v AS versions,
       CASE WHEN d = last THEN 'kept' ELSE 'retired' END AS kind
FROM g JOIN l ON l.o_custkey = g.o_custkey
"""


def nights(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's day as a night from its first to its last event."""
    rows = events(spark, sf).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.min("ts").cast("timestamp").alias("night_start"),
        F.max("ts").cast("timestamp").alias("night_end"),
        F.min("time_s").alias("a"),
        F.max("time_s").alias("b"),
        F.min("event_id").alias("e"),
        F.count(F.lit(1)).alias("n"),
    ).filter(F.col("n") > 1)
    length = F.col("b") - F.col("a")
    shaped = rows.select(
        "user_id",
        "day",
        "night_start",
        "night_end",
        F.when(F.col("e") % 10 != 0, F.col("night_end")).otherwise(F.col("night_start")).alias("data_end"),
        (F.col("e") % 13 != 1).alias("window_confirmed"),
        (F.col("e") % 11 != 2).alias("from_device"),
        F.when(F.col("e") % 7 != 3, length * (F.col("e") % 5) / 10).alias("unmeasurable_s"),
        (length * 0.3).alias("deep_s"),
        (length * 0.4).alias("light_s"),
        F.when(F.col("e") % 9 != 4, length * 0.1).alias("rem_s"),
        (F.col("e") % 2 == 0).alias("rem_capable"),
        (((F.col("a") + F.col("b")) / 2) % 86400).alias("midpoint_s"),
    )
    out = days.assess_nights(
        shaped,
        USER,
        max_unmeasured=0.25,
        short_sleep_s=14400,
        shift_s=7200,
        usual_window_days=10,
        usual_min_nights=2,
    )
    return compact(
        out.withColumn("usual_nights", F.col("usual_nights").cast("long")),
        "user_id",
        "day",
        "night_state",
        "night_short",
        "night_short_absence",
        "night_shifted",
        "night_shifted_absence",
        "usual_nights",
        "usual_midpoint_s",
        digits=3,
    )


NIGHT_SQL = """
WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, min(epoch_us(ts)) / 1000000.0 AS a, max(epoch_us(ts)) / 1000000.0 AS b,
                  min(event_id) AS e FROM events GROUP BY 1, 2 HAVING count(*) > 1),
n AS (SELECT *, date_diff('day', DATE '1970-01-01', day) AS dn, CASE WHEN e % 7 <> 3 THEN (e % 5) / 10.0 END AS un,
             (b - a) * 0.7 + CASE WHEN e % 2 = 0 THEN CASE WHEN e % 9 <> 4 THEN (b - a) * 0.1 END ELSE 0 END AS sleep,
             fmod((a + b) / 2, 86400) AS mid FROM r),
s AS (SELECT *, CASE WHEN e % 11 = 2 THEN 'declared' WHEN e % 10 = 0 OR e % 13 = 1 THEN 'in_progress'
                     WHEN un IS NULL OR un > 0.25 THEN 'partial' ELSE 'complete' END AS state FROM n),
u AS (SELECT *, state = 'complete' AND coalesce(sleep >= 14400, false) AS ok FROM s),
w AS (SELECT *, sum(CASE WHEN ok THEN sin(mid * 2 * pi() / 86400) END) OVER x AS si,
             sum(CASE WHEN ok THEN cos(mid * 2 * pi() / 86400) END) OVER x AS co,
             count(CASE WHEN ok THEN 1 END) OVER x AS k
      FROM u WINDOW x AS (PARTITION BY user_id ORDER BY dn RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN k > 0 AND sqrt(si * si + co * co) / k > 1e-12
                     THEN fmod(atan2(si, co) / (2 * pi()) * 86400 + 86400, 86400) END AS usual FROM w),
g AS (SELECT *, least(abs(mid - usual), 86400 - abs(mid - usual)) AS dist,
             CASE WHEN k < 2 THEN 'below_usual_minimum' WHEN usual IS NULL THEN 'dispersed_midpoints' END AS why FROM c)
SELECT user_id, day, state AS night_state, sleep < 14400 AS night_short,
       CASE WHEN sleep IS NULL THEN 'no_measured_sleep' END AS night_short_absence,
       CASE WHEN why IS NULL THEN dist > 7200 END AS night_shifted, why AS night_shifted_absence,
       k AS usual_nights, round(usual, 3) AS usual_midpoint_s
FROM g
"""


def nights_after(spark: SparkSession, sf: str) -> DataFrame:
    """The three first days that end strictly after each purchase."""
    rows = events(spark, sf)
    ends = rows.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.max("time_s").alias("night_end_s")
    )
    probes = rows.filter(F.col("event_type") == "purchase").select("user_id", "event_id", "time_s")
    out = days.nights_after(probes, ends, USER, "time_s", "event_id", 3)
    return compact(out, "user_id", "event_id", "rank", "day", "delay_s", digits=3)


AFTER_SQL = """
WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, max(epoch_us(ts)) / 1000000.0 AS t FROM events GROUP BY 1, 2),
p AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t FROM events WHERE event_type = 'purchase'),
j AS (SELECT p.user_id, p.event_id, n.day, n.t - p.t AS delay,
             row_number() OVER (PARTITION BY p.event_id ORDER BY n.t) AS r
      FROM p JOIN n ON n.user_id = p.user_id AND n.t > p.t)
SELECT user_id, event_id, CAST(r AS INTEGER) AS rank, day, round(delay, 3) AS delay_s FROM j WHERE r <= 3
"""


def battery(spark: SparkSession, sf: str) -> DataFrame:
    """Merged day/night level at each click: errors open nights of six hours, views are
    night points, signups day points."""
    rows = events(spark, sf)
    nights_table = rows.filter(F.col("event_type") == "error").groupBy(
        "user_id", F.floor(F.col("time_s") / 86400).alias("n")
    ).agg(F.min("time_s").alias("n0")).select(
        "user_id", "n", "n0", (F.col("n0") + 21600).alias("n1")
    )
    views = rows.filter(F.col("event_type") == "view").select(
        "user_id", F.col("time_s").alias("t"), F.col("value").alias("level"),
        F.floor(F.col("time_s") / 86400).alias("n"), F.col("ts").cast("date").alias("file_day"),
    )
    night_points = views.join(nights_table, ["user_id", "n"]).drop("n")
    day_points = rows.filter(F.col("event_type") == "signup").select(
        "user_id", F.col("time_s").alias("t"), F.col("value").alias("level"),
        F.col("ts").cast("date").alias("file_day"),
    )
    probes = rows.filter(F.col("event_type") == "click").select(
        "user_id", "event_id", F.col("time_s").alias("at_s")
    )
    out = days.battery_at(probes, day_points, night_points, nights_table, USER, "at_s")
    return compact(out, "user_id", "event_id", "level", "from_night", "age_s", digits=3)


BATTERY_SQL = """
WITH e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1000000.0 AS t FROM events),
n AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS k, min(t) AS n0, min(t) + 21600 AS n1 FROM e
      WHERE event_type = 'error' GROUP BY 1, 2),
np AS (SELECT e.user_id, e.t, e.value, n0, n1 FROM e JOIN n ON n.user_id = e.user_id AND n.k = CAST(floor(e.t / 86400) AS BIGINT)
       WHERE event_type = 'view' AND t BETWEEN n0 AND n1),
p AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'click'),
c AS (SELECT p.event_id, np.t, np.value, true AS night FROM p JOIN np ON np.user_id = p.user_id AND np.n1 <= p.t
      UNION ALL
      SELECT p.event_id, d.t, d.value, false FROM p JOIN e d ON d.user_id = p.user_id AND d.event_type = 'signup' AND d.t <= p.t
      WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = p.user_id AND n.n1 <= p.t AND d.t BETWEEN n.n0 AND n.n1)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY t DESC) AS r FROM c)
SELECT p.user_id, p.event_id, round(k.value, 3) AS level, k.night AS from_night, round(p.t - k.t, 3) AS age_s
FROM p LEFT JOIN k ON k.event_id = p.event_id AND r = 1
"""


def sleep_within(spark: SparkSession, sf: str) -> DataFrame:
    """Sleep of the orders (as episodes of 3 to 20 days) finished in each 60-day span."""
    start = day_number("o_orderdate")
    orders = table(spark, sf, "orders").select(
        "o_custkey",
        F.col("o_orderkey").alias("episode"),
        start.cast("double").alias("e0"),
        (start + 3 + F.col("o_orderkey") % 18).cast("double").alias("e1"),
    )
    episodes = orders.withColumn("sleep_s", (F.col("e1") - F.col("e0")) * 0.75).withColumn(
        "unmeasurable_s", F.lit(1.0)
    )
    segments = orders.select(
        "o_custkey",
        "episode",
        F.inline(
            F.array(
                F.struct((F.col("e0") + 1).alias("s0"), F.col("e1").alias("s1"), F.lit(True).alias("asleep")),
                F.struct(F.col("e0").alias("s0"), (F.col("e0") + 1).alias("s1"), F.lit(False).alias("asleep")),
            )
        ),
    )
    spans = orders.select(
        "o_custkey", F.floor(F.col("e1") / 60).alias("span_id")
    ).distinct().withColumn("start_s", F.col("span_id") * 60.0).withColumn(
        "end_s", F.col("span_id") * 60.0 + 59.5
    )
    out = days.sleep_within(spans, episodes, segments, ["o_custkey"], cell_s=60.0)
    return compact(out, "o_custkey", "span_id", "episodes", "sleep_s", "coverage")


SLEEP_SQL = """
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k,
                  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS a,
                  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3 + o_orderkey % 18 AS DOUBLE) AS b FROM orders),
e AS (SELECT *, CAST(floor(b / 60) AS BIGINT) AS s FROM o WHERE b <= floor(b / 60) * 60 + 59.5),
r AS (SELECT *, max(b) OVER (PARTITION BY c, s ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY c, s ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM r),
u AS (SELECT *, max(b) OVER (PARTITION BY c, s, grp ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ru FROM g),
k AS (SELECT *, max(a + 1) OVER (PARTITION BY c, s, grp ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rd FROM u),
t AS (SELECT c, s, grp, count(*) AS n, sum((b - a) * 0.75) AS total, sum(1.0) AS un, min(a) AS g0, max(b) AS g1,
             sum(greatest(0.0, b - greatest(a + 1, coalesce(ru, a + 1)))) AS un_sleep,
             sum(greatest(0.0, a + 1 - greatest(a, coalesce(rd, a)))) AS dark
      FROM k GROUP BY 1, 2, 3),
z AS (SELECT c, s, sum(n) AS n, sum(CASE WHEN n > 1 THEN least(total, un_sleep) ELSE total END) AS sleep,
             sum(g1 - g0) AS win, sum(CASE WHEN n > 1 THEN dark ELSE un END) AS unm FROM t GROUP BY 1, 2),
spans AS (SELECT DISTINCT c, CAST(floor(b / 60) AS BIGINT) AS s FROM o)
SELECT spans.c AS o_custkey, spans.s AS span_id, CAST(coalesce(n, 0) AS BIGINT) AS episodes, round(sleep, 6) AS sleep_s,
       round(greatest(0.0, (win - unm) / win), 6) AS coverage
FROM spans LEFT JOIN z ON z.c = spans.c AND z.s = spans.s
"""


def series_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Points in each user's week and the share covered by six hours after each."""
    rows = events(spark, sf)
    week = 604800.0
    spans = rows.select("user_id", F.floor(F.col("time_s") / week).alias("span_id")).distinct()
    spans = spans.withColumn("a", F.col("span_id") * week).withColumn("b", (F.col("span_id") + 1) * week - 1)
    out = days.coverage_of(
        spans, rows.select("user_id", "time_s"), USER, "span_id", "a", "b", "time_s", 21600.0, week
    )
    return compact(out, "user_id", "span_id", "points", "coverage")


COVERAGE_SQL = """
WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t, CAST(floor(epoch_us(ts) / 1000000.0 / 604800) AS BIGINT) AS w FROM events),
s AS (SELECT *, w * 604800.0 AS a, (w + 1) * 604800.0 - 1 AS b FROM e),
k AS (SELECT *, max(least(t + 21600, b)) OVER (PARTITION BY user_id, w ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM s WHERE t <= b)
SELECT user_id, w AS span_id, count(*) AS points,
       round(sum(greatest(0.0, least(t + 21600, b) - greatest(t, coalesce(reach, t)))) / 604799.0, 6) AS coverage
FROM k GROUP BY user_id, w
"""


def journal_days(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as journal spans of up to three days: types present on each day."""
    rows = table(spark, sf, "orders").select(
        "o_custkey",
        F.col("o_orderdate").cast("date").alias("start"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 4).cast("int")).alias("end"),
        F.col("o_orderstatus").alias("type"),
    )
    out = days.journal_by_day(rows, ["o_custkey"])
    return compact(out.withColumn("types", F.array_join("types", ",")))


JOURNAL_SQL = """
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) + CAST(unnest(range(0, o_orderkey % 4 + 1)) AS INTEGER) AS day,
                  o_orderstatus AS s FROM orders)
SELECT o_custkey, day, string_agg(s, ',' ORDER BY s) AS types FROM d GROUP BY 1, 2
"""


def admissions(spark: SparkSession, sf: str) -> DataFrame:
    """First refusal of each order's value, under the ordered rules of a night measure."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    key = F.col("o_orderkey")
    state = F.when(key % 5 == 0, "partial").otherwise("complete")
    journal = F.when(key % 11 == 3, F.array(F.lit("illness"))).when(
        key % 11 == 4, F.array(F.lit("altitude_stay"))
    ).otherwise(F.array().cast("array<string>"))
    refusal = days.admission_refusal(
        absent=F.col("o_orderstatus") == "P",
        value=F.when(key % 3 != 0, F.col("o_totalprice")),
        invalid=F.col("o_totalprice") < 50000,
        night=(state, key % 7 == 1, F.when(key % 2 == 0, key % 13 == 2)),
        short_admitted=False,
        journal=journal,
    )
    return rows.groupBy(F.coalesce(refusal, F.lit("admitted")).alias("refusal")).agg(
        F.count(F.lit(1)).alias("n")
    )


ADMISSION_SQL = """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'absent_row' WHEN o_orderkey % 3 = 0 THEN 'no_value'
            WHEN o_totalprice < 50000 THEN 'invalid_value' WHEN o_orderkey % 5 = 0 THEN 'night_not_complete'
            WHEN o_orderkey % 7 = 1 THEN 'short_night' WHEN o_orderkey % 2 = 0 AND o_orderkey % 13 = 2 THEN 'shifted_night'
            WHEN o_orderkey % 11 = 3 THEN 'illness' WHEN o_orderkey % 11 = 4 THEN 'altitude_stay' ELSE 'admitted' END AS refusal,
       count(*) AS n
FROM orders GROUP BY 1
"""


def _text(sql: str, column: str = "day") -> str:
    """The check with a date column as text."""
    return f"SELECT * REPLACE (CAST({column} AS VARCHAR) AS {column}) FROM ({sql})"


CHECKS = {
    "calendar_spine": Check(calendar_spine, _text(SPINE_SQL)),
    "rolling_robust_normal": Check(lambda s, d: _normals(s, d, False), _text(_normal_sql(False))),
    "rolling_log_normal": Check(lambda s, d: _normals(s, d, True), _text(_normal_sql(True))),
    "ruptures_segments": Check(ruptures_segments, _text(RUPTURE_SQL)),
    "watch_normals": Check(watch_normals, _text(WATCH_SQL)),
    "series_runs": Check(series_runs, _text(RUNS_SQL, "first_day")),
    "last_days": Check(last_days, _text(LAST_SQL, "day")),
    "lowest_window": Check(lowest_window, LOWEST_SQL),
    "first_wins_dedup": Check(first_wins_dedup, FIRST_SQL),
    "export_merge": Check(export_merge, _text(MERGE_SQL)),
    "export_differences": Check(export_differences, DIFF_SQL),
    "decisive_exports": Check(decisive_exports, DECISIVE_SQL),
    "night_assessment": Check(nights, _text(NIGHT_SQL)),
    "nights_after": Check(nights_after, _text(AFTER_SQL)),
    "body_battery_asof": Check(battery, BATTERY_SQL),
    "sleep_within": Check(sleep_within, SLEEP_SQL),
    "series_coverage": Check(series_coverage, COVERAGE_SQL),
    "journal_days": Check(journal_days, _text(JOURNAL_SQL)),
    "admission_refusals": Check(admissions, ADMISSION_SQL),
}
