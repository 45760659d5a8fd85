"""Toxicity where labels are few or say nothing: ordinary documents stay."""

from __future__ import annotations

import os
import random

import corpus_pipeline
import pytest
from test_corpus_operators import sentence

from ridgeflow.llm import toxicity

GIVEN = "/root/testdata"


def test_labels_without_signal_condemn_nothing():
    rng = random.Random(1)
    texts = [sentence(rng, 40) for _ in range(60)]
    model = toxicity.fitted(texts[::6], [t for n, t in enumerate(texts) if n % 6])
    scores = model.score([*texts, None, ""], None if model.weights is None else model.lengths())
    assert (scores >= 0.5).mean() < 0.1
    if model.weights is None:
        assert len(set(scores)) == 1 and 0 < scores[0] < 0.5


def test_threshold_needs_logits_on_either_side():
    assert toxicity.best_threshold([1.0, 1.0, 1.0] * toxicity.np.ones(3), toxicity.np.array([1.0, 0.0, 0.0])) is None
    assert toxicity.best_threshold(toxicity.np.array([3.0, 1.0, 0.0]), toxicity.np.array([1.0, 0.0, 0.0])) == 2.0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_few_labels_find_toxic_words_and_keep_the_ordinary(spark, size):
    """The given labels mark some documents without any toxic word: those that have one count."""
    if not os.path.isdir(f"{GIVEN}/{size}"):
        pytest.skip("no given tables")
    docs = spark.read.parquet(f"{GIVEN}/{size}/documents.parquet")
    labels = spark.read.parquet(f"{GIVEN}/{size}/labels.parquet").where("toxic IS NOT NULL")
    bad = "(?i)\\b(scum|disgusting|moron|loser|clown|trash|worthless|pathetic|stupid|idiot)\\b"
    got = toxicity.judge_toxicity(docs, labels).join(labels, "doc_id").join(docs.selectExpr("doc_id", f"text rlike '{bad}' AS bad"), "doc_id").collect()
    toxic = [r["predicted"] for r in got if r["toxic"] == 1 and r["bad"]]
    ordinary = [r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(toxic) >= 0.8 * len(toxic)
    assert sum(ordinary) <= 0.03 * len(ordinary)
    assert corpus_pipeline.drop_toxic(spark, docs, f"{GIVEN}/{size}").count() >= 0.85 * docs.count()
