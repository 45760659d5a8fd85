"""Suffix statistics of URLs count all labelled rows and keep every value."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ridgeflow.llm import url_filter


def labelled(spark, pieces: int, each: int):
    rows = [(f"http://h.com/p{k}/{j}", float(k % 2)) for k in range(pieces) for j in range(each)]
    random.Random(1).shuffle(rows)
    urls = spark.createDataFrame(rows, "url string, label double")
    host, path = url_filter.url_parts("url")
    urls = urls.withColumns({"host": host, "path": path})
    return url_filter.lexical_features(urls, "url", F.col("host"), F.col("path")), rows


@pytest.mark.parametrize("few", [200_000, 0])
def test_rates_of_every_value(spark, monkeypatch, few):
    monkeypatch.setattr(url_filter, "BROADCAST_VALUES", few)
    given, rows = labelled(spark, 300, 40)
    model = url_filter.fit_url_model(given, fit_rows=2_000)
    rated = url_filter.with_rates(given, model.counts, model.share)
    got = {r["first"]: r["first_rate"] for r in rated.select("first", "first_rate").distinct().collect()}
    assert got == {f"p{k}": pytest.approx((40 * (k % 2) + 10) / 60) for k in range(300)}
    scores = {r["url"]: r["score"] for r in model.score(given).select("url", "score").collect()}
    assert all((scores[url] >= 0.5) == (label == 1.0) for url, label in rows)


def test_a_fitted_row_does_not_see_its_own_label(spark):
    given, _ = labelled(spark, 60, 1)
    counts = url_filter.suffix_counts(given)
    rates = url_filter.with_rates(given, counts, 0.5, fitted=True).select("first_rate").distinct().collect()
    assert [r["first_rate"] for r in rates] == [0.5]
