"""Writing and reading back our tables, curve files, reports and fingerprints."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ridgeflow.session import cut_lineage
from ridgeflow.sources import table_sets

PROVENANCE = "provenance_id"


def write_activities(activities: DataFrame, points: DataFrame, root: str, provenance: str) -> None:
    """Publishes activities and their channel points together: all of them or none."""
    table_sets.publish({"activities": activities, "points": points}, root, provenance)


def write_bronze(df: DataFrame, path: str, partition: Sequence[str] = ("athlete_id",)) -> None:
    """Replaces only the athletes present in ``df`` (dynamic partition overwrite)."""
    present = [c for c in partition if c in df.columns]
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*present) if present else writer).parquet(path)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_tables(tables: Mapping[str, DataFrame], root: str, provenance: str) -> None:
    """Publishes the processed tables as one set under one provenance."""
    stamped = {name: df.withColumn(PROVENANCE, F.lit(provenance)) for name, df in tables.items()}
    table_sets.publish(stamped, root, provenance)


def read_tables(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of the published set, which are of one writing; refuses names that it lacks."""
    return table_sets.read_set(spark, root, names)


def write_curve(rows: DataFrame, path: str, companion: Mapping[str, object]) -> None:
    """Curve CSV and its JSON companion, never overwritten (at most 38 rows)."""
    spark = rows.sparkSession
    rows.coalesce(1).orderBy("grade_pct").write.mode("errorifexists").option("header", True).csv(
        f"{path}/curve"
    )
    note = spark.createDataFrame([(json.dumps(companion, default=str),)], "value string")
    note.coalesce(1).write.mode("errorifexists").text(f"{path}/companion")


def read_curve(spark: SparkSession, csv: str, companion: str) -> tuple[DataFrame, DataFrame]:
    """(bins, companion) of a curve file, speeds in m/s and grades as fractions."""
    raw = (
        spark.read.option("header", True)
        .schema("grade_pct DOUBLE, kmh DOUBLE, hr DOUBLE, vam_mh DOUBLE, time_min DOUBLE")
        .csv(csv)
    )
    bins = raw.select(
        (F.col("grade_pct") / 100).alias("grade"),
        (F.col("kmh") / 3.6).alias("speed_ms"),
        F.col("hr").alias("mean_hr_bpm"),
        "time_min",
    )
    schema = (
        "sport STRING, activity_count INT, hr_center_bpm DOUBLE, hr_width_bpm DOUBLE, "
        "date_from DATE, date_to DATE, source_activity_types ARRAY<STRING>, "
        "min_duration_s DOUBLE, estimator STRING, generated_at TIMESTAMP"
    )
    return bins, spark.read.schema(schema).option("multiLine", True).json(companion)


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header, arrays joined by spaces, never overwritten."""
    flat = [
        F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
        if kind.startswith("array")
        else F.col(c)
        for c, kind in df.dtypes
    ]
    df.select(*flat).write.mode("errorifexists").option("header", True).csv(path)


def write_report(
    tables: Mapping[str, DataFrame], root: str, provenance: Mapping[str, object]
) -> None:
    """A result folder: one CSV per table and a provenance row, never overwritten."""
    for name, df in tables.items():
        write_csv(df, f"{root}/{name}")
    spark = next(iter(tables.values())).sparkSession
    row = spark.createDataFrame([(json.dumps(provenance, default=str),)], "value string")
    row.coalesce(1).write.mode("errorifexists").text(f"{root}/provenance")


#: Children of a node of the hash tree, as hex digits of a path's hash; lines of a leaf, about.
_ARITY, _LEAF_LINES = 16, 64


def fingerprint(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """SHA-256 of an input tree, ``sha256``, and its number of ``files``.

    Files are hashed where they are read, as ``path<TAB>sha`` lines with paths under the root.
    The lines hang in a tree by the hex digits of the hash of their path: a leaf is the digest
    of its sorted lines, a node that of its sixteen children at most. Its depth follows from the
    number of files, so equal trees of files have equal digests wherever they stand, and no
    task ever holds more than a leaf's lines."""
    try:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True)
            .load(root)
        )
    except AnalysisException:  # nothing there: the digest of no files
        files = spark.createDataFrame([], "path string, content binary")
    inside = F.substring_index("path", root.rstrip("/") + "/", -1)
    lines = cut_lineage(
        files.select(
            F.sha2(inside, 256).alias("place"), F.concat_ws("\t", inside, F.sha2("content", 256)).alias("line")
        )
    )
    count = lines.count()
    depth = 0
    while _LEAF_LINES * _ARITY**depth < count:
        depth += 1

    def level(nodes: DataFrame, digits: int, sha: str) -> DataFrame:
        """Digests of the nodes that share so many digits; the root stands even over nothing."""
        joined = F.sha2(F.array_join(F.sort_array(F.collect_list(sha)), "\n"), 256).alias("line")
        prefix = F.substring("place", 1, digits).alias("place")
        return nodes.groupBy(prefix).agg(joined) if digits else nodes.agg(joined)

    tree = level(lines, depth, "line")
    for digits in range(depth - 1, -1, -1):
        own = tree.select("place", F.concat_ws("\t", "place", "line").alias("own"))
        tree = level(own, digits, "own")
    return tree.select(F.col("line").alias("sha256"), F.lit(count).alias("files"))


def append_events(events: DataFrame, path: str) -> None:
    """Appends to an event log table."""
    events.write.mode("append").parquet(path)
