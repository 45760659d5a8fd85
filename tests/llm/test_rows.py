"""Ids that repeat, on equal and on different texts: decisions are about rows."""

from __future__ import annotations

import random
from collections import Counter

from test_corpus_operators import DOCS, WORDS, sentence

import corpus_pipeline
from ridgeflow.llm.jaccard_join import near_duplicates
from ridgeflow.llm.mixing import mixed_documents


def near(text: str, at: int = 9) -> str:
    """A copy with one word more: about 0.9 alike at 100 words."""
    words = text.split()
    return " ".join([*words[:at], "edit", *words[at:]])


def texts(n: int) -> list[str]:
    rng = random.Random(9)
    return [sentence(rng, 100) for _ in range(n)]


def kept(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS).repartition(3)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns
    return Counter((r["doc_id"], r["text"]) for r in out.collect())


def test_near_duplicates_of_one_id_on_two_texts(spark):
    a, b, c = texts(3)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, near(b, 60)), (5, c), (5, c), (6, near(c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for given in (docs, docs.repartition(5), docs.orderBy("text", ascending=False)):
        got = Counter(tuple(r) for r in near_duplicates(given).collect())
        assert got == Counter(
            [(1, 1, 1, 1, 1), (1, 1, 1, 2, 2), (2, 1, 2, 1, 1), (3, 1, 3, 2, 2), (4, 1, 4, 2, 2)]
            + 2 * [(5, 5, 5, 1, 1)] + [(6, 5, 6, 1, 2)]
        )


def test_exact_stage_keeps_one_row_of_each_text(spark):
    a, b, c, d = texts(4)
    # A row four times; an id on its own text and on a copy; copies and own texts without an id.
    rows = 4 * [(7, a)] + [(8, a), (8, d), (None, b), (None, b), (None, c), (1, c + "  "), (3, None), (4, "")]
    got = kept(spark, "exact dedup", rows)
    assert got == Counter([(7, a), (8, d), (None, b), (1, c + "  "), (3, None)])


def test_near_stage_keeps_one_row_of_each_class(spark):
    a, b, c = texts(3)
    rows = 3 * [(7, c)] + [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, a), (8, ""), (4, b.upper()), (7, near(c))]
    got = kept(spark, "near duplicates", rows)
    assert sum(n for (i, _), n in got.items() if i == 7) == 1
    assert {k: n for k, n in got.items() if k[0] != 7} == {(1, a): 1, (1, b): 1, (None, a): 1, (8, ""): 1}


def test_mixing_takes_from_every_row_its_own_words(spark):
    rows = [(1, t, "en", "a", 1) for t in texts(40)] + [(2, t, "en", "b", 1) for t in texts(80)[40:]]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    words = Counter()
    for r in mixed_documents(docs, block_words=4).collect():
        words[r["source"]] += len(WORDS.findall(r["text"]))
    # 8,000 words, 1.5 times: source a at its cap of twice its size, source b the rest.
    assert abs(words["a"] - 8000) <= 8 and abs(words["b"] - 4000) <= 8
