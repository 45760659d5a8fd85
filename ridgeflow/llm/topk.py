"""Exact top-k search by inner product over norm buckets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.session import cut_lineage

K = 10
QUERY_STEP = 100
SCALE = 1024
#: Vectors of a bucket and queries of a block: what one task holds at a time.
BUCKET_VECTORS, QUERY_BLOCK = 2048, 512
#: Local cosine thresholds from which coordinates prune, and the coordinates looked at.
COORDINATE_FROM, FOCUS = 0.5, 8


def whole_vector(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _matrix(cells: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(c, np.int64) for c in cells])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; floating point only where every sum is a whole number below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(q: pd.DataFrame, rows: pd.DataFrame, k: int, floor: np.ndarray) -> pd.DataFrame:
    """Best k rows of one bucket for each query of a block, at least as good as its floor."""
    a, b = _matrix(q["whole"]), _matrix(rows["whole"])
    ids, qid = rows["vec_id"].to_numpy(np.int64), q["vec_id"].to_numpy(np.int64)
    qn, bn = np.sqrt((a.astype(float) ** 2).sum(1)), np.sqrt((b.astype(float) ** 2).sum(1))
    longest = bn.max(initial=0.0)
    # Local threshold: the cosine a row of this bucket needs; above one, none can have it.
    needed = np.where(qn * longest > 0, floor / np.maximum(qn * longest, 1e-300), np.where(floor > 0, 2.0, -1.0))
    out = []
    by_length = needed < COORDINATE_FROM
    for chosen, coordinates in ((by_length, False), (~by_length & (needed <= 1 + 1e-9), True)):
        at = np.flatnonzero(chosen)
        if not len(at):
            continue
        if not coordinates:
            # Length pruning: rows too short for every query of the block fall away.
            least = (floor[at] / np.maximum(qn[at], 1e-300)).min()
            live = np.flatnonzero(bn >= least * (1 - 1e-9) - 1e-9) if least > 0 else np.arange(len(bn))
            part = _products(a[at], b[live])
            pairs = [(i, live, part[j]) for j, i in enumerate(at)]
        else:
            # Coordinate pruning: the query's largest coordinates, exactly, and a bound for the rest.
            pairs = []
            unit = b / np.maximum(bn, 1e-300)[:, None]
            for i in at:
                focus = np.argsort(-np.abs(a[i]), kind="stable")[:FOCUS]
                seen = unit[:, focus]
                rest_q = np.sqrt(max(qn[i] ** 2 - float((a[i, focus].astype(float) ** 2).sum()), 0.0))
                rest_b = np.sqrt(np.maximum(1.0 - (seen**2).sum(1), 0.0))
                bound = bn * (seen @ a[i, focus].astype(float) + rest_q * rest_b)
                live = np.flatnonzero(bound >= floor[i] * (1 - 1e-9) - 1e-6 * max(qn[i] * longest, 1.0))
                pairs.append((i, live, _products(a[i : i + 1], b[live])[0]))
        for i, live, scores in pairs:
            fine = (ids[live] != qid[i]) & (scores >= floor[i])
            live, scores = live[fine], scores[fine]
            best = _best(ids[live], scores, k)
            out.append(
                pd.DataFrame({"query_id": qid[i], "vec_id": ids[live[best]], "score": scores[best]})
            )
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    return pd.concat(out, ignore_index=True) if out else empty


_FOUND = "query_id long, vec_id long, score long"


def top_k(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    query_step: int = QUERY_STEP,
    scale: int = SCALE,
    bucket_vectors: int = BUCKET_VECTORS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k rows with the highest integer inner product for each query, exactly.

    Queries are the rows whose id is divisible by ``query_step``; every other row is a
    candidate. Returns ``query_id``, ``rank``, ``vec_id``, ``score``; ties go to the smaller id.

    Rows are dealt into buckets of like length (norm), longest first. A first pass over the
    bucket of the longest vectors gives every query a floor: its k-th score there. A bucket
    whose longest vector cannot reach the floor is skipped; in the others the local cosine
    threshold, floor / (query length * bucket length), picks length pruning (low) or
    coordinate pruning (high), and what is left is verified by exact products. Queries meet
    buckets in blocks; each meeting yields k rows per query at most, merged at the end.

    Vectors that are null, hold a null or a non-finite component, or whose id is null, take no
    part. Components that a shorter vector lacks count as zero. Rows that repeat an id
    are candidates each, but never for the query of the same id; a repeated query id is
    searched once, with the row of the largest vector. Fewer than k candidates give fewer
    rows; an empty table gives none."""
    whole = cut_lineage(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_vector(F.col(vector), scale).alias("whole"))
        .where("vec_id IS NOT NULL AND whole IS NOT NULL AND size(whole) > 0")
        .withColumn("norm", F.sqrt(F.aggregate("whole", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    )
    spark = whole.sparkSession
    sizes = whole.agg(F.count("*").alias("rows"), F.min(F.size("whole")).alias("least"), F.max(F.size("whole")).alias("most")).first()
    if not sizes["rows"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if sizes["least"] < sizes["most"]:
        missing = F.array_repeat(F.lit(0).cast("long"), F.lit(sizes["most"]) - F.size("whole"))
        whole = whole.withColumn("whole", F.concat(F.col("whole").cast("array<long>"), missing))
    total = sizes["rows"]
    # Edges between buckets: quantiles of the length, a bounded number whatever the table.
    count = max(1, -(-total // bucket_vectors))
    cuts = [i / min(count, 1000) for i in range(1, min(count, 1000))]
    edges = sorted(set(whole.approxQuantile("norm", cuts, 0.0005))) if cuts else []
    salts = max(1, -(-count // max(1, len(edges) + 1)))
    bucket = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e < F.col("norm"))) if edges else F.lit(0)
    # Equal lengths share a bucket; a salt splits a bucket that holds more than its share.
    dealt = whole.withColumn("bucket", bucket.cast("int"))
    spread = dealt.groupBy("bucket").agg(F.count("*").alias("rows"), F.max("norm").alias("longest"))
    held = spread.collect()  # one row per bucket, a thousand at most
    parts = {r["bucket"]: max(salts, -(-r["rows"] // bucket_vectors)) for r in held}
    table = F.create_map(*(F.lit(x) for pair in parts.items() for x in pair))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("vec_id"), table[F.col("bucket")].cast("long")).cast("int"))

    queries = (
        whole.where(F.col("vec_id") % query_step == 0)
        .groupBy("vec_id").agg(F.max_by("whole", "norm").alias("whole"), F.max("norm").alias("norm"))
    )
    blocks = max(1, -(-queries.count() // query_block))
    queries = cut_lineage(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")))

    def meet(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return _search(q, rows, k, q["floor"].to_numpy(np.float64))

    longest = F.create_map(*(F.lit(x) for r in held for x in (r["bucket"], float(r["longest"]))))
    keys = ("block", "bucket", "piece")

    def search(q: DataFrame, rows: DataFrame, buckets: dict[int, int]) -> DataFrame:
        """Every query block against the pieces of the given buckets that can reach its floor."""
        pieces = F.create_map(*(F.lit(x) for pair in buckets.items() for x in pair))
        reach = F.col("norm") * longest[F.col("bucket")] * (1 + 1e-9) + 1e-6
        wanted = (
            q.select("*", F.explode(pieces).alias("bucket", "pieces"))
            .where(reach >= F.col("floor"))
            .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .drop("pieces")
        )
        # A piece is copied to the blocks that it can still help, and to no other.
        met = wanted.select(*(F.col(c).alias(f"_{c}") for c in keys)).distinct()
        own = (F.col("bucket") == F.col("_bucket")) & (F.col("piece") == F.col("_piece"))
        copied = rows.join(met, own).select(*rows.columns, F.col("_block").alias("block"))
        return wanted.groupBy(*keys).cogroup(copied.groupBy(*keys)).applyInPandas(meet, _FOUND)

    top = max(parts)
    first = search(queries.withColumn("floor", F.lit(float("-inf"))), dealt.where(F.col("bucket") == top), {top: parts[top]})
    first = cut_lineage(first)
    by_query = _merged(first, k)
    floors = by_query.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor")
    )
    ready = queries.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").fillna({"floor": float("-inf")})
    rest = {b: n for b, n in sorted(parts.items()) if b != top}
    found = first.unionByName(search(ready, dealt.where(F.col("bucket") != top), rest)) if rest else first
    return _merged(found, k).select("query_id", "rank", "vec_id", "score")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Best k of each query; the rows of a query are k per piece of a bucket at most."""

    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    rows = found.groupBy("query_id").agg(F.slice(order, 1, k).alias("best"))
    return rows.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score")
    )
