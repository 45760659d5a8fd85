"""Session helpers: local test sessions and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


#: Folder of this process where the setting is unset (local sessions only).
_local: list[str] = []
#: Tables that this process has cut from their lineage and not removed.
_cuts: list[str] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ridgeflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: the one the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset, as in
    local tests, a temporary folder is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _local[0]


@contextmanager
def cuts_removed() -> Iterator[None]:
    """Removes, at the end of the block, the tables that were cut inside it.

    For jobs whose results are written inside the block: frames that still read such a
    table cannot be used afterwards."""
    first = len(_cuts)
    try:
        yield
    finally:
        for path in _cuts[first:]:
            files, place = fs.FileSystem.from_uri(path)
            if files.get_file_info(place).type == fs.FileType.Directory:
                files.delete_dir(place)
        del _cuts[first:]


#: HotSpot never compiles a longer method; Spark's own default lets it be interpreted.
HUGE_METHOD, HUGE_METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


#: By default both sides of a join move again unless they are dealt by all of its keys.
ALL_JOIN_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _compiled(spark: SparkSession) -> Iterator[None]:
    """Inside the block, steps whose generated method is too long for the compiler run in
    smaller pieces: wide tables are written a few times as fast."""
    before = spark.conf.get(HUGE_METHOD, "65535")
    spark.conf.set(HUGE_METHOD, str(min(int(before), HUGE_METHOD_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(HUGE_METHOD, before)


@contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """Inside the block, tables that are dealt alike by some keys of a join are joined where they lie."""
    before = spark.conf.get(ALL_JOIN_KEYS, "true")
    spark.conf.set(ALL_JOIN_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_JOIN_KEYS, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    The result survives lost executors, its plan is one columnar scan, and its readers
    prune columns and know its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    _cuts.append(path)
    with _compiled(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
