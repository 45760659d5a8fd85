"""Alignment of two tokenizers against a plain computation on whole texts."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_right
from collections import Counter

import pytest
from test_corpus_operators import corpus

from ridgeflow.llm.token_alignment import BYTE_TOKENIZER, PIECE_TOKENIZER, Aligner, align_tokens, aligned_groups
from ridgeflow.llm.tokens import public_path

TEXTS = [
    None,
    "",
    " ",
    "  two  blanks  ",
    "one",
    " led by a blank",
    "ends with one ",
    "line\nbreak\n\ntwo \n mixed\ttab\r\n",
    "日本語のテキスト 𝔘𝔫𝔦 e\u0301 🙂👩‍👩‍👧 na\u00efve \u00a0nbsp \u3000 wide",
    "it's we'll 'quoted' 12345 3.14 <0x41> <|endoftext|> </s> <unk>",
    "a▁b lower one eighth block",
    "x" * 5000,
    "é" * 3000,
    "\u2028 \x1c \x85 odd blanks",
    "same same same same",
    "same same same same",
]


def plain(aligner: Aligner, text: str | None):
    """Tokens, groups and links of a whole text, from decoded bytes alone."""
    if not text:
        return None
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    own_a, own_b = [aligner.bytes_a[i] for i in a], [aligner.bytes_b[i] for i in b]
    whole = (" " + text).encode()
    if b"".join(own_a) != whole or b"".join(own_b) != whole:
        return None

    def ends(own):
        out, at = [], 0
        for t in own:
            at += len(t)
            out.append(at)
        return out

    ends_a, ends_b = ends(own_a), ends(own_b)
    cuts = sorted(set(ends_a) & set(ends_b))
    groups, before = [], 0
    for cut in cuts:
        held = [ids[bisect_right(ends, before) : bisect_right(ends, cut)] for ids, ends in ((a, ends_a), (b, ends_b))]
        groups.append((before, cut, *held))
        before = cut
    return groups


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [*TEXTS, *(r[1] for r in corpus())]
    alphabet = "aeiou nst.,'\n日é🙂▁<0x "
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    return [(None if n % 17 == 3 else n // 2, t, "x", n) for n, t in enumerate(texts)]


@pytest.mark.parametrize("frequent", [5, 100_000])
def test_alignment(spark, rows, frequent):
    table = spark.createDataFrame(rows, "doc_id long, text string, code string, row long").repartition(5)
    aligner = Aligner(public_path(BYTE_TOKENIZER), public_path(PIECE_TOKENIZER))
    found = [plain(aligner, r[1]) for r in rows]
    links = [
        Counter((x, y) for _, _, a, b in groups for x in a for y in b) if groups else Counter() for groups in found
    ]
    counts = Counter(pair for own in links for pair in own)
    highest: dict[int, int] = {}
    for (a, _), n in counts.items():
        highest[a] = max(highest.get(a, 0), n)
    want = []
    for r, groups, own in zip(rows, found, links, strict=True):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for _, _, a, b in groups or [])
        want.append(
            (
                r[0],
                sum(len(g[2]) for g in groups or []),
                sum(len(g[3]) for g in groups or []),
                len(groups or []),
                sum(own.values()),
                sum(n for p, n in own.items() if counts[p] == highest[p[0]]),
                sum(n * counts[p] for p, n in own.items()),
                hashlib.sha256(shown.encode()).hexdigest() if groups else "",
            )
        )
    out = align_tokens(table, frequent=frequent)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())
    assert sum(w[3] > 0 for w in want) > 60


def test_groups_keep_spans(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string, code string, row long").repartition(3)
    aligner = Aligner(public_path(BYTE_TOKENIZER), public_path(PIECE_TOKENIZER))
    got = sorted(str((r["doc_id"], [tuple(g) for g in r["groups"]])) for r in aligned_groups(table).collect())
    assert got == sorted(str((r[0], plain(aligner, r[1]) or [])) for r in rows)


def test_empty_table(spark):
    assert align_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_are_tokenised_many_at_a_time():
    """One call and one result for each word cost more than its tokens; words that a tokenizer
    changes are still found one by one."""
    paths = public_path(BYTE_TOKENIZER), public_path(PIECE_TOKENIZER)
    joined, single = Aligner(*paths), Aligner(*paths)
    given = {0: [], 1: []}
    spans = joined._spans
    joined._spans = lambda side, texts: given[side].extend(texts) or spans(side, texts)
    single._side = lambda *args, side=single._side: _one_by_one(single, side, args)
    rng = random.Random(5)
    letters = "abcdefghijklmnopéñß日本.,'1"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(1500)})
    odd = [w for t in TEXTS if t for w in joined.words(t)]
    for own in (words, odd, [*words[:700], "</s>", "a▁b", *words[700:]]):
        for one, two in zip(joined.groups(own), single.groups(own), strict=True):
            assert one.tolist() == two.tolist()
        if own is words:
            assert max(map(len, given.values())) < len(words) / 50
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(3)]
    joined.learn([joined.words(t) for t in texts])
    for t in texts:
        (_, _, n_groups, _), digest, codes, _ = joined.document(joined.words(t))
        groups = plain(joined, t)
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in groups)
        assert n_groups == len(groups) and digest == hashlib.sha256(text.encode()).hexdigest()
        assert sorted(codes.tolist()) == sorted({a * joined.base + b for g in groups for a in g[2] for b in g[3]})


def _one_by_one(aligner: Aligner, side, args: tuple):
    aligner.by_word = False
    try:
        return side(*args)
    finally:
        aligner.by_word = True
