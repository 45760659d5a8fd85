"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from test_corpus_operators import corpus

from ridgeflow.llm.spelling_variants import one_edit_pairs, spelling_variants, word_counts


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_composition_is_all_pairs_once():
    rng = random.Random(5)
    for _ in range(30):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(60)})
        got = [tuple(sorted(p)) for p in one_edit_pairs(words)]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_long_words_need_no_deep_recursion():
    rng = random.Random(6)
    word = "".join(rng.choice("abc") for _ in range(4000))
    pair = sorted([word, word[:1000] + "d" + word[1000:]])
    assert [tuple(sorted(p)) for p in one_edit_pairs(pair)] == [tuple(pair)]


def brute(counts: dict[str, int]):
    near = {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), counts[w], len(near[w]), counts.get(form[w], -1)) for w in counts)


def shown(out):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in out.collect())


@pytest.mark.parametrize("state_words", [1, 4, 20_000])
def test_forms_and_roots(spark, state_words):
    rng = random.Random(9)
    counts: dict[str, int] = {}
    for n in range(60):
        word = "".join(rng.choice("abà") for _ in range(rng.randint(6, 8)))
        counts[word] = rng.choice([5, 6, 25, 130, 700])
        for _ in range(3):
            at = rng.randrange(len(word))
            other = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abà") + word[at:], word[:at] + "b" + word[at + 1 :]])
            if len(other) >= 6:
                counts[other] = rng.choice([5, 25, 140])
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    want = brute(counts)
    assert shown(spelling_variants(table, state_words=state_words)) == want
    assert any(w[1] and w[2] != w[1] for w in want)


def test_counts(spark):
    rng = random.Random(2)
    stems = ["straße", "Ähnlich", "naïveté", "ABCDEFG", "keyword", "×÷×÷×÷", "short", "Ünïcödés"]
    rows = [(r[0], r[1], "x") for r in corpus()]
    rows += [(n, ", ".join(rng.choice(stems) for _ in range(40)) + "1x_" * 3, "x") for n in range(100, 160)]
    table = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    want: Counter[str] = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = word_counts(table, misspelt=7)
    assert {r["word"]: r["n"] for r in got.collect()} == want
    assert shown(spelling_variants(got)) == brute(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(word_counts(empty, misspelt=199)).count() == 0
