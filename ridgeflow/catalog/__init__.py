"""Registered queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Check:
    """A query and its check; no SQL means that only the rows are checked."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def all_checks() -> dict[str, Check]:
    from ridgeflow.catalog import (
        curves,
        days,
        inference,
        measures,
        outings,
        scores,
        spans,
        tracks,
    )

    out: dict[str, Check] = {}
    for module in (tracks, curves, scores, outings, days, inference, measures, spans):
        for name, check in module.CHECKS.items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = check
    return out
