"""The corpus pipeline on a small corpus, every stage against brute force on its own input."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from test_corpus_operators import BLANKS, DOCS, WORDS, corpus, sentence, shingles

import corpus_pipeline
from ridgeflow.llm.packing import TOKENIZER
from ridgeflow.llm.tokens import public_path, word_tokens

BAD = ("blorkish", "snarfing", "vilethug")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    rows, labels = list(corpus()), []
    for i in range(1000, 1240):
        words = sentence(rng, 60).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "en", rng.choice("abc"), 1))
        if i < 1200:
            labels.append((i, 1, toxic))
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "near duplicates", "mixing", "packing"]

    def staged(name, given):
        stages[name](spark, given, sf_dir).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    clean = staged("toxicity", docs)
    before, after = docs.collect(), clean.collect()
    assert clean.columns == columns
    bad = lambda r: any(w in (r["text"] or "") for w in BAD)
    assert not any(bad(r) for r in after)
    assert len(after) >= 0.98 * sum(not bad(r) for r in before)

    single = staged("exact dedup", clean)
    best = {}
    for r in after:
        place = (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)
        key = BLANKS.sub("", r["text"] or "")
        best[key] = min(best.get(key, place), place)
    rows = single.collect()
    assert single.columns == columns
    # One row per normalised text, counted by row, and it is the best one.
    kept = [(BLANKS.sub("", r["text"] or ""), -len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) for r in rows]
    assert sorted(kept) == sorted((key, *place) for key, place in best.items())

    apart = staged("near duplicates", single)
    known = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
    root = {i: i for i, _ in known}
    for _ in known:
        for i, a in known:
            for j, b in known:
                if a and b and root[i] != root[j] and len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    want = Counter(r["doc_id"] for r in rows if r["doc_id"] is None or root[r["doc_id"]] == r["doc_id"])
    assert apart.columns == columns and Counter(r["doc_id"] for r in apart.collect()) == want

    given = {(r["doc_id"], r["source"]): WORDS.findall(r["text"] or "") for r in apart.collect()}
    mixed = staged("mixing", apart)
    assert mixed.columns == columns
    got, total = Counter(), Counter()
    for r in mixed.collect():
        words = WORDS.findall(r["text"])
        own = given[(r["doc_id"], r["source"])]
        assert words and not Counter(words) - Counter(own) and r["n_chars"] is not None
        got[(r["doc_id"], r["source"])] += 1
        total[r["source"]] += len(words)
    assert max(got.values()) <= 2
    assert sum(total.values()) == pytest.approx(1.5 * sum(map(len, given.values())), abs=16 * 5)

    packed = staged("packing", mixed).collect()
    tokenizer = word_tokens(public_path(TOKENIZER)).tokenizer
    tokens = Counter()
    for r in mixed.collect():
        tokens[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    filled, placed = Counter(), Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
        placed[r["doc_id"]] += r["length"]
    assert placed == tokens and max(filled.values()) <= 4096
    assert len(filled) <= -(-sum(tokens.values()) // 4096) + 1

    whole = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in whole.collect()) == Counter(
        (r["doc_id"], r["piece"], r["length"]) for r in packed
    )
