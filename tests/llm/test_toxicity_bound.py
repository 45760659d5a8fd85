"""The toxicity fit reads one text of each labelled id, however often the id stands."""

from __future__ import annotations

from test_corpus_operators import sentence

from ridgeflow.llm import toxicity


def test_fit_reads_one_row_of_each_chosen_id(spark, monkeypatch):
    import random

    rng = random.Random(2)
    rows = [(k, sentence(rng, 30) + (" vilethug" if k % 4 == 0 else "")) for k in range(40)]
    rows += [(1, f"{sentence(rng, 5)} z{n}") for n in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int")
    seen, train = [], toxicity.train_dictionaries
    monkeypatch.setattr(toxicity, "train_dictionaries", lambda t, o: seen.append((t, o)) or train(t, o))
    toxicity.fit_toxicity(docs, labels, fit_toxic=5, fit_ordinary=30)
    toxic, ordinary = seen[-1]
    assert len(toxic) == 5 and len(ordinary) == 30
    assert sum(" z" in t for t in ordinary) <= 1
