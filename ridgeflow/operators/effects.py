"""Two-way additive effects, connected components and leave-one-day-out references."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeflow.operators import scoring
from ridgeflow.session import cut_lineage

# Certification of a fit and its largest number of iterations.
TOLERANCE = 1e-8
MAX_ITERATIONS = 10_000


def alternate(
    cells: DataFrame, keys: Sequence[str], day: str, segment: str, y: str, levels: DataFrame
) -> DataFrame:
    """One round of alternating means: day levels (keys, ``day``, ``c``) after centring.

    Both means are partial aggregations; levels (one row per day or segment) are the
    only tables joined to the cells."""
    keys = list(keys)
    seg = (
        cells.join(levels, [*keys, day])
        .groupBy(*keys, segment)
        .agg(F.avg(F.col(y) - F.col("c")).alias("a"))
    )
    raw = (
        cells.join(seg, [*keys, segment])
        .groupBy(*keys, day)
        .agg(F.avg(F.col(y) - F.col("a")).alias("c"))
    )
    return centre(raw, keys)


def centre(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    mean = levels.groupBy(*keys).agg(F.avg("c").alias("_m"))
    joined = levels.join(mean, keys) if keys else levels.crossJoin(F.broadcast(mean))
    return joined.withColumn("c", F.col("c") - F.col("_m")).drop("_m")


def fixed_rounds(
    cells: DataFrame, keys: Sequence[str], day: str, segment: str, y: str, rounds: int
) -> tuple[DataFrame, DataFrame]:
    """(day levels, segment levels) after a given number of rounds, as one plan."""
    levels = cells.select(*keys, day).distinct().withColumn("c", F.lit(0.0))
    for _ in range(rounds):
        levels = alternate(cells, keys, day, segment, y, levels)
    return levels, segment_levels(cells, keys, day, segment, y, levels)


def segment_levels(
    cells: DataFrame, keys: Sequence[str], day: str, segment: str, y: str, levels: DataFrame
) -> DataFrame:
    """Segment levels that match given day levels."""
    return (
        cells.join(levels, [*keys, day])
        .groupBy(*keys, segment)
        .agg(F.avg(F.col(y) - F.col("c")).alias("a"))
    )


def two_way_fit(
    cells: DataFrame,
    keys: Sequence[str],
    day: str,
    segment: str,
    y: str,
    *,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    check_every: int = 5,
) -> tuple[DataFrame, DataFrame, int, bool]:
    """Fit of every component at once: (day levels, segment levels, rounds, certified).

    Rounds run as DataFrame jobs; every ``check_every`` rounds the (small) level table is
    written and the largest move of a level decides whether to stop."""
    levels = cut_lineage(cells.select(*keys, day).distinct().withColumn("c", F.lit(0.0)))
    done = 0
    while done < max_iterations:
        moved = levels
        for _ in range(min(check_every, max_iterations - done)):
            before = moved
            moved = alternate(cells, keys, day, segment, y, moved)
            done += 1
        gap = (
            moved.join(before.withColumnRenamed("c", "_b"), [*keys, day])
            .agg(F.max(F.abs(F.col("c") - F.col("_b"))).alias("g"))
        )
        levels = cut_lineage(moved)
        worst = gap.collect()[0]["g"]
        if worst is None or worst < tolerance:
            return levels, segment_levels(cells, keys, day, segment, y, levels), done, True
    return levels, segment_levels(cells, keys, day, segment, y, levels), done, False


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: ``node``, ``component`` (smallest node of each).

    Large-star / small-star rounds: each round links every node to the smallest node it
    sees, so depth falls geometrically; star tables are written. A hub's messages
    are minima by node, combined on the map side. Ends at the fixed point, which the count
    and a checksum of the links show."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = both.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    links = cut_lineage(both.filter(F.col("u") != F.col("v")).distinct())
    seen = None
    while True:
        mirrored = links.unionByName(
            links.select(F.col("v").alias("u"), F.col("u").alias("v"))
        )
        least = mirrored.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            mirrored.filter(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.filter(F.col("u") != F.col("v")).distinct()
        down = large.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = (
            small.unionByName(low.select("u", F.col("m").alias("v")))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        links = cut_lineage(following)
        mark = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
        now = links.agg(F.count(F.lit(1)), mark).first()
        if now == seen:
            break
        seen = now
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, "u", "left").select(
        F.col("u").alias("node"), F.coalesce("component", "u").alias("component")
    )


#: Days of a route up to which its folds are solved by downdating one day system.
FOLD_DAYS = 64
#: Segments of a route that one task sums.
FOLD_SEGMENTS = 2_000


def downdated_folds(
    cells: DataFrame,
    route: Sequence[str],
    *,
    day: str = "day",
    segment: str = "k",
    y: str = "y",
    chunk_segments: int = FOLD_SEGMENTS,
) -> DataFrame:
    """Segment levels of every fold: keys, ``fold``, ``segment``, ``a`` and ``part``.

    ``cells``: one row per route, day and segment; a null ``y`` is a cell to be predicted that
    teaches nothing. The fold of a day is fitted without it; ``a`` is given for the segments
    of that day that other days have, ``part`` is the connected part of their days.

    Segment levels are eliminated from the normal equations, which leaves a system of days:
    with ``n`` days of a segment, L = diag(cells of a day) - sum of b b' / n over segments, b
    their days. Without day j, each segment of j has n - 1 days: L loses its row and column
    and, of rank as many as j's segments, b b' / (n (n - 1)). These sums are added up by
    chunks of segments in one pass over the cells; a route's days squared (at most
    ``FOLD_DAYS``) times its days are all that meets in one task, however many segments it
    has. Every day system is centred in each of its parts and solved directly."""
    route = list(route)
    schema = cells.schema
    numbered = (
        cells.select(*route, day)
        .distinct()
        .withColumn("_i", F.row_number().over(Window.partitionBy(*route).orderBy(day)) - 1)
        .withColumn("_days", F.count(F.lit(1)).over(Window.partitionBy(*route)))
    )
    lists = (
        cells.join(numbered, [*route, day])
        .groupBy(*route, segment, "_days")
        .agg(F.collect_list(F.struct("_i", F.col(y).cast("double").alias("y"))).alias("_cells"))
    )
    many = lists.groupBy(*route).agg(F.count(F.lit(1)).alias("_segments"))
    chunk = F.pmod(F.xxhash64(F.col(segment)), F.ceil(F.col("_segments") / chunk_segments)).cast("int")
    lists = cut_lineage(
        lists.join(many, route).select(
            *route, segment, "_days", F.col("_cells._i").alias("_at"), F.col("_cells.y").alias("_y"), chunk.alias("_chunk")
        )
    )
    named = [schema[c] for c in route]
    held = ("cells", "pairs", "right", "lost", "lost_right")
    parts = [("_days", T.IntegerType()), *((name, T.BinaryType()) for name in held)]
    sums_schema = T.StructType([*named, *(T.StructField(n, t) for n, t in parts)])

    def table(rows: pd.DataFrame, days: int) -> tuple[np.ndarray, np.ndarray]:
        values, known = np.zeros((len(rows), days)), np.zeros((len(rows), days))
        for n, (at, ys) in enumerate(zip(rows["_at"], rows["_y"], strict=True)):
            ys = np.array([np.nan if v is None else v for v in ys], float)
            at = np.asarray(at)[~np.isnan(ys)]
            values[n, at], known[n, at] = ys[~np.isnan(ys)], 1.0
        return values, known

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        days = int(rows["_days"].iloc[0])
        values, known = table(rows, days)
        n = known.sum(axis=1)
        mean = values.sum(axis=1) / np.maximum(n, 1)
        pairs = (known / np.maximum(n, 1)[:, None]).T @ known
        right = (known * (values - mean[:, None])).sum(axis=0)
        lost, lost_right = np.zeros((days, days, days)), np.zeros((days, days))
        for j in range(days):
            own = (known[:, j] > 0) & (n > 1)
            b, m = known[own], n[own]
            lost[j] = (b / (m * (m - 1))[:, None]).T @ b
            lost_right[j] = b.T @ (mean[own] - (m * mean[own] - values[own, j]) / (m - 1))
        held = [known.sum(axis=0), pairs, right, lost, lost_right]
        return pd.DataFrame([[*rows[route].iloc[0], days, *(h.tobytes() for h in held)]], columns=sums_schema.names)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        days = int(rows["_days"].iloc[0])
        count, pairs, right, lost, lost_right = (
            sum(np.frombuffer(v) for v in rows[c]) for c in ("cells", "pairs", "right", "lost", "lost_right")
        )
        pairs, lost, lost_right = pairs.reshape(days, days), lost.reshape(days, days, days), lost_right.reshape(days, days)
        levels, part = np.zeros((days, days)), np.full((days, days), -1, np.int32)
        for j in range(days):
            system = np.diag(count) - pairs - lost[j]
            for own in _linked(pairs, [d for d in range(days) if d != j and count[d] > 0]):
                at = np.ix_(own, own)
                levels[j, own] = np.linalg.solve(system[at] + 1.0 / len(own), (right + lost_right[j])[own])
                part[j, own] = own[0]
        return pd.DataFrame([[*rows[route].iloc[0], levels.tobytes(), part.tobytes()]], columns=[*route, "_levels", "_part"])

    fold_schema = T.StructType(
        [*named, T.StructField("_i", T.IntegerType()), schema[segment], T.StructField("a", T.DoubleType()), T.StructField("part", T.IntegerType())]
    )

    def predict(rows: pd.DataFrame, solved: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(solved):
            days = int(rows["_days"].iloc[0])
            levels = np.frombuffer(solved["_levels"].iloc[0]).reshape(days, days)
            part = np.frombuffer(solved["_part"].iloc[0], np.int32).reshape(days, days)
            values, known = table(rows, days)
            key = list(rows[route].iloc[0])
            for n, (name, at) in enumerate(zip(rows[segment], rows["_at"], strict=True)):
                for j in {int(i) for i in at}:
                    others = np.flatnonzero(known[n] > 0)
                    others = others[others != j]
                    if len(others):
                        a = float((values[n, others] - levels[j, others]).mean())
                        out.append([*key, j, name, a, int(part[j, others[0]])])
        return pd.DataFrame(out, columns=fold_schema.names)

    summed = lists.groupBy(*route, "_chunk").applyInPandas(sums, sums_schema)
    solved_schema = T.StructType([*named, T.StructField("_levels", T.BinaryType()), T.StructField("_part", T.BinaryType())])
    solved = summed.groupBy(*route).applyInPandas(solve, solved_schema)
    by_chunk = lists.select(*route, "_chunk").distinct().join(solved, route)
    # Names of its own: both sides come from one table.
    own = [f"_own_{c}" for c in (*route, "_chunk")]
    by_chunk = by_chunk.select(*(F.col(c).alias(n) for c, n in zip((*route, "_chunk"), own, strict=True)), "_levels", "_part")
    folds = lists.groupBy(*route, "_chunk").cogroup(by_chunk.groupBy(*own)).applyInPandas(predict, fold_schema)
    names = numbered.select(*route, "_i", F.col(day).alias("fold"))
    return folds.join(names, [*route, "_i"]).drop("_i")


def _linked(pairs: np.ndarray, days: list[int]) -> list[list[int]]:
    """Connected parts of some days, linked where they share a segment."""
    left, out = set(days), []
    while left:
        part, edge = set(), {min(left)}
        while edge:
            part |= edge
            edge = {e for d in edge for e in left if pairs[d, e] > 0} - part
        out.append(sorted(part))
        left -= part
    return out


def iterated_folds(
    cells: DataFrame, route: Sequence[str], *, day: str = "day", segment: str = "k", y: str = "y"
) -> tuple[DataFrame, bool]:
    """The same levels by alternating fits of all folds, for routes of very many days."""
    route = list(route)
    days = cells.select(*route, F.col(day).alias("fold")).distinct()
    training = cut_lineage(cells.filter(F.col(y).isNotNull()).join(days, route).filter(F.col("fold") != F.col(day)))
    keys = [*route, "fold"]
    _, segments, _, certified = two_way_fit(training, keys, day, segment, y)
    place = [F.col(c).cast("string") for c in keys]
    left = F.concat_ws("|", F.lit("d"), *place, F.col(day).cast("string"))
    right = F.concat_ws("|", F.lit("s"), *place, F.col(segment).cast("string"))
    linked = components(training.select(left.alias("u"), right.alias("v")), "u", "v")
    levels = segments.withColumn("node", right).join(linked, "node")
    levels = levels.select(*keys, segment, "a", F.hash("component").alias("part"))
    held = cells.select(*route, segment, F.col(day).alias("fold"))
    return levels.join(held, [*keys, segment]), certified


def leave_one_day_out(
    cells: DataFrame,
    route: Sequence[str],
    *,
    day: str = "day",
    segment: str = "k",
    t: str = "t",
    klass: str = "klass",
    fold_days: int = FOLD_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """Predictive reference of each route: (class scores per fold, averages F).

    Every fold fits segment levels on the other days and scores the held-out day with
    them. Folds come from one day system per route, downdated by each day
    (``downdated_folds``); only routes of more than ``fold_days`` days, whose day systems are
    too large for a task, alternate over cells times days. Only segments seen by other days
    can be predicted. A class whose segments lie in several connected parts has the motif
    ``not_identified``, a fit that did not settle ``non-convergence``, and no scores."""
    route = list(route)
    taught = cells.withColumn("y", F.when(F.col(t) > 0, F.log(t)))
    sizes = taught.groupBy(*route).agg(F.count_distinct(day).alias("_d"))
    few = sizes.filter(F.col("_d") <= fold_days).select(*route)
    folds = downdated_folds(taught.join(few, route, "left_semi"), route, day=day, segment=segment)
    folds = folds.withColumn("settled", F.lit(True))
    if not sizes.filter(F.col("_d") > fold_days).isEmpty():
        more, certified = iterated_folds(taught.join(few, route, "left_anti"), route, day=day, segment=segment)
        folds = folds.unionByName(more.withColumn("settled", F.lit(certified)))
    keys = [*route, "fold"]
    held = cells.withColumn("fold", F.col(day))
    predicted = cut_lineage(held.join(folds, [*keys, segment]).withColumn("p", F.exp("a")))
    scores = scoring.support_scores(predicted, keys, "p", t, klass)
    spread = predicted.groupBy(*keys, klass).agg(
        (F.min("part") != F.max("part")).alias("_apart"), F.min("settled").alias("_settled")
    )
    judged = scores.classes.join(spread, [*keys, klass]).withColumn(
        "motif",
        F.when(F.col("_apart"), "not_identified").when(~F.col("_settled"), "non-convergence").otherwise(F.col("motif")),
    )
    for score in ("class_level", "class_dispersion", "class_offset"):
        judged = judged.withColumn(score, F.when(F.col("motif").isNull(), F.col(score)))
    means = judged.groupBy(*route, klass).agg(
        F.avg(F.abs("class_level")).alias("reference_level"),
        F.avg("class_dispersion").alias("reference_dispersion"),
        F.count("class_level").alias("folds"),
    )
    return judged.drop("_apart", "_settled"), means
