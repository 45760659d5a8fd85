"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeflow.llm.exact_dedup import exact_groups
from ridgeflow.llm.jaccard_join import near_duplicates
from ridgeflow.llm.mixing import mixed_documents
from ridgeflow.llm.packing import pack_documents
from ridgeflow.llm.rows import numbered
from ridgeflow.llm.toxicity import clean_documents, fit_toxicity
from ridgeflow.session import cuts_removed, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _staying(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Numbered rows but for those judged to go: by number, as ids and texts may repeat."""
    return rows.join(judged.where("NOT kept").select("__row"), "__row", "left_anti").drop("__row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go; the labels of the corpus train the judge.

    Rows are judged by their own text, so repeated ids do not matter."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return clean_documents(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, whatever ids its rows have."""
    rows = numbered(docs, "__row")
    return _staying(rows, exact_groups(rows, row="__row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, one with the smallest id.

    Rows without an id or without words are classes of their own."""
    rows = numbered(docs, "__row")
    return _staying(rows, near_duplicates(rows, row="__row"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row per document and pass, with the words that it takes."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near duplicates", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Stages that learn, sample paths, or pack by tokens have no SQL form: tests compare.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
        with cuts_removed():  # what the stage wrote on its way is not read again
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
