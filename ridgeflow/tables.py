"""The given tables as inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str | Column) -> Column:
    """Epoch seconds of a zone-less timestamp (session zone UTC)."""
    value = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(value.cast("timestamp")) / 1_000_000.0


def day_number(column: str | Column) -> Column:
    """Days since 1970-01-01 of a timestamp or date."""
    value = F.col(column) if isinstance(column, str) else column
    return F.unix_date(value.cast("date"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: ``user_id``, ``time_s``, ``value``, ``event_type``, ..."""
    raw = table(spark, sf_dir, "events")
    return raw.withColumn("time_s", seconds("ts"))


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero on the scaled value, as SQL engines round doubles.

    Spark's own ``round`` reads the shortest decimal text of a double: a half that is one last
    bit short, such as 2358.1629374999997, goes down there."""
    scaled = value * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(value)


def compact(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Selected columns, doubles rounded and dates as text for the SQL check."""
    types = dict(df.dtypes)
    shown = columns or tuple(df.columns)

    def shown_as(column: str) -> Column:
        if types[column] in ("double", "float"):
            return rounded(F.col(column), digits).cast(types[column]).alias(column)
        if types[column] == "date":
            return F.col(column).cast("string").alias(column)
        return F.col(column)

    return df.select(*(shown_as(c) for c in shown))
