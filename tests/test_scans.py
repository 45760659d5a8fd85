"""Ordered scans, look-ups, islands and quantiles against brute force, split or not."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ridgeflow.operators import calibration, climbs, islands, lookup, ordered, quantiles


def _series(spark, n=60):
    rng = random.Random(3)
    rows = [("hot", float(i * 3 + i % 2), rng.randrange(100)) for i in range(n)]
    rows += [("cold", float(i), rng.randrange(100)) for i in range(5)]
    return spark.createDataFrame(rows, "k string, t double, v int"), rows


def _by_key(rows):
    out = {}
    for k, t, v in sorted(rows):
        out.setdefault(k, []).append((t, v))
    return out


@pytest.mark.parametrize("mode", ["plain", "split"])
def test_running_shift_frame(spark, request, mode):
    if mode == "split":
        request.getfixturevalue("split")
    df, rows = _series(spark)
    df = ordered.assign_chunks(df, ["k"], "t")
    assert ordered.is_chunked(df) == (mode == "split")
    out = ordered.running(
        df,
        ["k"],
        ["t"],
        {
            "s": ("sum", F.col("v")),
            "m": ("max", F.col("v")),
            "last": ("last", F.when(F.col("v") > 50, F.col("v"))),
        },
    )
    out = ordered.shift(out, ["k"], ["t"], {"p": F.col("v")})
    out = ordered.shift(out, ["k"], ["t"], {"n": F.col("v")}, forward=True)
    out = ordered.framed(out, ["k"], "t", -5, 5, {"f": lambda w: F.sum("v").over(w)})
    back = ordered.running(out, ["k"], ["t"], {"r": ("sum", F.col("v"))}, reverse=True)
    got = {(r.k, r.t): r for r in back.collect()}
    for k, points in _by_key(rows).items():
        total = sum(v for _, v in points)
        run, top, last = 0, None, None
        for i, (t, v) in enumerate(points):
            row = got[k, t]
            assert row.r == total - run
            run += v
            top = v if top is None else max(top, v)
            last = v if v > 50 else last
            assert (row.s, row.m, row.last) == (run, top, last)
            assert row.p == (points[i - 1][1] if i else None)
            assert row.n == (points[i + 1][1] if i + 1 < len(points) else None)
            assert row.f == sum(w for u, w in points if t - 5 <= u <= t + 5)


@pytest.mark.parametrize("mode", ["plain", "split"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, request, mode, strict, forward):
    if mode == "split":
        request.getfixturevalue("split")
    df, rows = _series(spark, 40)
    probes = spark.createDataFrame(
        [("hot", float(t)) for t in range(-2, 130, 7)] + [("none", 1.0)], "k string, at double"
    )
    out = lookup.asof(probes, df, ["k"], "at", "t", ["t", "v"], strict=strict, forward=forward)
    points = _by_key(rows)
    for r in out.collect():
        def fits(t, at=r.at):
            if forward:
                return t > at if strict else t >= at
            return t < at if strict else t <= at

        known = [p for p in points.get(r.k, []) if fits(p[0])]
        want = (known[0] if forward else known[-1]) if known else (None, None)
        assert (r.t, r.v) == want
    assert out.count() == probes.count()


def test_unions_and_coverage(spark, split):
    rng = random.Random(5)
    rows = [("a", float(s), float(s + rng.randrange(1, 9))) for s in (rng.randrange(90) for _ in range(40))]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    covered = islands.covered_length(df, ["k"], "a", "b").collect()[0]["covered"]
    units = {u for _, a, b in rows for u in range(int(a), int(b))}
    assert covered == len(units)
    merged = islands.interval_union(df, ["k"], "a", "b").collect()
    assert sum(r.b - r.a for r in merged) == len(units)
    # Touching intervals do not overlap: they stay in different groups.
    pair = spark.createDataFrame([("a", 0.0, 2.0), ("a", 2.0, 3.0)], "k string, a double, b double")
    assert islands.interval_groups(pair, ["k"], "a", "b").select("grp").distinct().count() == 2


def test_overlap_join_has_no_duplicates(spark):
    left = spark.createDataFrame([(1, 0.0, 50.0), (2, 49.0, 51.0)], "l int, a double, b double")
    right = spark.createDataFrame([(1, 10.0, 49.5), (2, 50.0, 60.0)], "r int, c double, d double")
    k = F.lit(1)
    pairs = lookup.overlap_join(
        left.withColumn("k", k), right.withColumn("k", k), ["k"], ("a", "b"), ("c", "d"), 7.0
    )
    assert sorted((p.l, p.r) for p in pairs.collect()) == [(1, 1), (2, 1), (2, 2)]
    closed = lookup.overlap_join(
        left.withColumn("k", k), right.withColumn("k", k), ["k"], ("a", "b"), ("c", "d"), 7.0, closed=True
    )
    assert sorted((p.l, p.r) for p in closed.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_rank_quantiles(spark, split):
    values = [random.Random(1).randrange(20) for _ in range(31)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    row = quantiles.rank_quantiles(df, [], "v", {"a": (1, 10), "b": (1, 2), "c": (9, 10)}).collect()[0]
    ordered_values = sorted(values)
    assert [row.a, row.b, row.c] == [ordered_values[r - 1] for r in (4, 16, 28)]


def test_prefix_ranks(spark):
    rng = random.Random(2)
    points = [("a", float(i), rng.random()) for i in range(70)]
    df = spark.createDataFrame(points, "k string, t double, z double")
    probes = spark.createDataFrame([("a", float(i)) for i in (0, 1, 2, 17, 40, 80)], "k string, at double")
    out = calibration.prefix_ranks(probes, df, ["k"], "at", "t", "z", calibration.BAND_ORDERS)
    for r in out.collect():
        known = sorted(z for _, t, z in points if t < r.at)
        if not known:
            assert r.n_known is None
            continue
        n = len(known)
        for name, (a, b) in calibration.BAND_ORDERS.items():
            assert r[name] == known[(n * a + b - 1) // b - 1]


def _zigzag(values, h):
    found, low, high, up = [], 0, 0, False
    for i, z in enumerate(values):
        if not up and z < values[low]:
            low = i
        elif not up and z - values[low] >= h:
            up, high = True, i
        elif up and z > values[high]:
            high = i
        elif up and values[high] - z >= h:
            found.append((low, high))
            up, low = False, i
    return [*found, (low, high)] if up else found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_zigzag_split_equals_plain(spark, seed):
    rng = random.Random(seed)
    values, z = [], 0.0
    for _ in range(150):
        z += rng.choice([-6, -3, -1, 0, 1, 3, 7])
        values.append(z)
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i long, z double")
    want = _zigzag(values, 10)
    for rows in (None, "9"):
        if rows:
            spark.conf.set("spark.ridgeflow.chunkRows", rows)
        try:
            got = climbs.zigzag(df, ["k"], "i", "z", 10.0).collect()
        finally:
            spark.conf.unset("spark.ridgeflow.chunkRows")
        assert sorted((r.low, r.high) for r in got) == want


def test_a_stray_instant_does_not_defeat_the_slices(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") + 1_700_000_000).cast("double").alias("t"))
    rows = rows.unionByName(spark.createDataFrame([("k", 0.0)], "k string, t double"))
    spark.conf.set("spark.ridgeflow.chunkRows", "1000")
    try:
        tagged = ordered.assign_chunks(rows, ["k"], "t")
        sizes = [r["count"] for r in tagged.groupBy(ordered.CHUNK).count().collect()]
        assert len(sizes) >= 20 and max(sizes) <= 1100 and sum(sizes) == 20_001
        counted = ordered.running(rows, ["k"], ["t"], {"n": ("count", F.lit(1))})
        assert counted.filter("n <> 1 AND n <> CAST(t - 1700000000 + 2 AS LONG)").count() == 0
    finally:
        spark.conf.unset("spark.ridgeflow.chunkRows")
