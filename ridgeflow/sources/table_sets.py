"""Sets of tables that appear together: versioned folders and one published pointer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

_POINTER = (
    "number long, version string, provenance string, "
    "tables array<struct<name: string, rows: long, digest: string, schema: string>>"
)


def digest_of(df: DataFrame) -> DataFrame:
    """One row with ``rows`` and ``digest`` of a table, equal for equal rows in any order.

    Two sums of row hashes, combined per task; nothing but these numbers moves."""
    values = [F.to_json(c) if "map<" in kind else F.col(c) for c, kind in sorted(df.dtypes)]

    def total(seed: int):
        mark = F.pmod(F.xxhash64(F.lit(seed), *values), F.lit(1 << 31)) if values else F.lit(0)
        return F.coalesce(F.sum(mark), F.lit(0)).cast("long")

    names = F.lit(json.dumps(sorted(df.dtypes)))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sha2(F.concat_ws("|", names, F.count(F.lit(1)).cast("string"), total(1).cast("string"), total(2).cast("string")), 256).alias("digest"),
    )


def publish(tables: Mapping[str, DataFrame], root: str, provenance: str, partition: Sequence[str] = ("athlete_id",)) -> str:
    """Writes a set of tables and then, in one step, makes it the current one; its version.

    Every table goes to a folder of the new version. Only when all are there is the pointer
    written: one row in one file, which a job commit renames into place. A writer that dies at
    any point leaves readers with the set before, and readers never see a part of a set."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    held = []
    for name, df in tables.items():
        folders = [c for c in partition if c in df.columns]
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*folders) if folders else writer).parquet(f"{root}/sets/{version}/{name}")
        written = spark.read.schema(df.schema).parquet(f"{root}/sets/{version}/{name}")
        found = digest_of(written).first()
        held.append((name, found["rows"], found["digest"], df.schema.json()))
    before = pointers(spark, root).agg(F.max("number")).first()[0]
    row = spark.createDataFrame([((before or 0) + 1, version, provenance, held)], _POINTER)
    row.coalesce(1).write.mode("errorifexists").json(f"{root}/published/{version}")
    return version


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """All published pointers, those of earlier sets too; none where nothing was published."""
    try:
        return spark.read.schema(_POINTER).json(f"{root}/published/*")
    except AnalysisException:
        return spark.createDataFrame([], _POINTER)


def current(spark: SparkSession, root: str):
    """Pointer row of the current set (the highest number, then version), or None."""
    return pointers(spark, root).filter(F.col("version").isNotNull()).orderBy(F.desc("number"), F.desc("version")).first()


def read_set(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the current set; ``ValueError`` where nothing is published or a table is not in it.

    A reader keeps the version that it began with, whatever is published meanwhile."""
    pointer = current(spark, root)
    if pointer is None:
        raise ValueError(f"no published tables under {root}")
    schemas = {t["name"]: T.StructType.fromJson(json.loads(t["schema"])) for t in pointer["tables"]}
    missing = [n for n in names or () if n not in schemas]
    if missing:
        raise ValueError(f"not in the published set: {missing}")
    return {
        n: spark.read.schema(schemas[n]).parquet(f"{root}/sets/{pointer['version']}/{n}") for n in names or schemas
    }


def verify_set(spark: SparkSession, root: str) -> DataFrame:
    """Tables of the current set with what was published and what is there: ``name``, ``rows``,
    ``digest``, ``found_rows``, ``found_digest``, ``intact``."""
    pointer = current(spark, root)
    out = None
    for t in pointer["tables"] if pointer else ():
        found = digest_of(read_set(spark, root, [t["name"]])[t["name"]])
        row = found.select(
            F.lit(t["name"]).alias("name"),
            F.lit(t["rows"]).alias("rows"),
            F.lit(t["digest"]).alias("digest"),
            F.col("rows").alias("found_rows"),
            F.col("digest").alias("found_digest"),
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        return spark.createDataFrame([], "name string, rows long, digest string, found_rows long, found_digest string, intact boolean")
    return out.withColumn("intact", (F.col("digest") == F.col("found_digest")) & (F.col("rows") == F.col("found_rows")))


_REPORT = "generated_on string, tables map<string, string>"


def stored_reports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Result folders under ``root``: (``folder``, ``generated_on``, ``tables``), and one row that
    counts them, ``readable`` and ``unreadable``.

    A folder ``DATE_NAME`` is readable if its ``provenance`` parses as JSON, names its tables
    and is generated on the date in its name. Folders whose names begin with a dot are not
    finished and do not count. Names come from a listing; only provenance is read."""
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    except AnalysisException:
        listed = spark.createDataFrame([], "path string")
    inside = F.substring_index("path", root.rstrip("/") + "/", -1)
    # A file counts for its folder only if it stands in one.
    folders = listed.filter(inside.contains("/")).select(F.substring_index(inside, "/", 1).alias("folder")).distinct()
    folders = folders.filter(~F.col("folder").startswith("."))
    try:
        said = spark.read.option("wholetext", True).text(f"{root}/*/provenance").select("value", F.col("_metadata.file_path").alias("path"))
    except AnalysisException:
        said = spark.createDataFrame([], "value string, path string")
    said = said.select(F.substring_index(inside, "/", 1).alias("folder"), F.from_json("value", _REPORT).alias("p"))
    said = said.groupBy("folder").agg(F.first("p").alias("p"))
    dated = F.try_to_date("p.generated_on", "yyyy-MM-dd")
    good = F.col("p.tables").isNotNull() & dated.isNotNull() & (F.col("p.generated_on") == F.substring_index("folder", "_", 1))
    judged = folders.join(said, "folder", "left").withColumn("good", F.coalesce(good, F.lit(False)))
    results = judged.filter("good").select("folder", dated.alias("generated_on"), F.col("p.tables").alias("tables"))
    counts = judged.agg(
        F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("readable"),
        F.coalesce(F.sum((~F.col("good")).cast("long")), F.lit(0)).alias("unreadable"),
    )
    return results, counts
