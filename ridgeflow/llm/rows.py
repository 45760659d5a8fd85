"""Numbers for rows, so that a decision names a row and not its id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeflow.session import cut_lineage


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number each; written, so that the numbers stay on any later read."""
    return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id()))
