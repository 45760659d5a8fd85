"""Operators for training corpora against brute force on small tables, edge cases included."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ridgeflow.llm import exact_dedup, jaccard_join, language_id, mixing, packing, suffix_repeats, token_shards, topk, toxicity, url_filter
from ridgeflow.llm.components import components
from ridgeflow.llm.feistel import permuted
from ridgeflow.llm.tokens import WordTokens, public_path, word_tokens

BLANKS = re.compile("[\x20\x09-\x0d]")
WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, bucket int, _rank int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus() -> list[tuple]:
    """Nulls, empties, blanks, long texts, copies, near copies, repeated rows and ids, shared passages."""
    rng = random.Random(3)
    rows: list[tuple] = [
        (None, None, None, None, None),
        (None, "text without an id", "en", None, 18),
        (1, None, "en", "a", None),
        (2, "", None, "b", 0),
        (3, " \t\n\x0b\x0c\r", "en", "a", 6),
        (4, "one", "de", "b", 3),
        (5, "Ünïcödé — 日本語 \u00a0 x", "fr", None, 20),
    ]
    base = sentence(rng, 120)
    rows += [(10 + k, base, "en", "a", len(base)) for k in range(4)]
    rows += [(20, base.replace(" ", "\n"), "en", "a", len(base)), (21, base + "  ", "en", "c", len(base))]
    rows += [(20, base.replace(" ", "\n"), "en", "a", len(base))]  # a row that stands twice
    words = base.split()
    for k in range(6):
        rows.append((30 + k, " ".join([*words[: 20 + k], f"edit{k}", *words[20 + k :]]), "en", "a", 1))
    passage = sentence(rng, 130)
    rows += [(50 + k, f"{sentence(rng, 30)} {passage} {sentence(rng, 25)}", "de", "b", 2) for k in range(5)]
    rows.append((60, sentence(rng, 9000, "xyz"), "fr", "d", 3))
    rows.append((61, "ab" * 700, "fr", "d", 3))  # one word that overlaps itself
    rows += [(70 + k, sentence(rng, rng.randint(1, 60)), rng.choice(["en", "de", None]), rng.choice("abcd"), 1) for k in range(40)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(*r, "k", 7, 7, 7) for r in rows]  # columns with names that the operators use
    return spark.createDataFrame(extra, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df, *columns) -> Counter:
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- exact dedup


@pytest.mark.parametrize("capacity, few", [(50_000, 1_000_000), (2, 0)])
def test_exact_groups(docs, rows, capacity, few):
    groups = defaultdict(list)
    for r in rows:
        groups[BLANKS.sub("", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0]))
    want = Counter()
    for r in rows:
        plain = BLANKS.sub("", r[1] or "")
        want[(r[0], min(groups[plain])[2], len(groups[plain]), hashlib.sha256(plain.encode()).hexdigest())] += 1
    got = exact_dedup.exact_groups(docs, capacity=capacity, broadcast_keys=few)
    assert counted(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert got.where("kept").count() == len(groups)


# --- near duplicates


def shingles(text: str | None) -> frozenset:
    w = WORDS.findall((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("options", [{}, {"bucket": 3, "block": 2, "depth": 2}])
def test_near_duplicates(docs, rows, options):
    members = {}
    for r in rows:
        s = shingles(r[1])
        if s and r[0] is not None:
            members.setdefault(s, []).append(r[0])
    links = {a: {b for b in members if b != a and len(a & b) >= 0.8 * len(a | b)} for a in members}
    root = {s: min(ids) for s, ids in members.items()}
    for _ in members:
        for a in members:
            for b in links[a]:
                root[a] = root[b] = min(root[a], root[b])
    want = Counter()
    for r in rows:
        s = shingles(r[1])
        if r[0] is None or not s:
            want[(r[0], r[0], 0)] += 1
        else:
            want[(r[0], root[s], len(links[s]))] += 1
    assert counted(jaccard_join.near_duplicates(docs, **options), "doc_id", "class_id", "n_links") == want
    assert any(n > 3 for _, _, n in want)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}


# --- repeated strings


@pytest.mark.parametrize("length", [400, 50])
def test_repeated_strings(docs, rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    want = Counter()
    for key, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[(key, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_repeats.repeated_strings(docs, length=length, bucket_suffixes=500)
    assert counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("r", [1, 2, 3, 5])
def test_difference_cover(r):
    period, residues = suffix_repeats.difference_cover(r)
    assert {(int(a) - int(b)) % period for a in residues for b in residues} == set(range(period))


# --- tokens, packing, shards


def pieces(rows, end, length):
    tokenizer = word_tokens(public_path(packing.TOKENIZER)).tokenizer
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, end], "<u4")
        for n, at in enumerate(range(0, len(ids), length)):
            yield r[0], n, at, ids[at : at + length]


def test_word_tokens_equal_the_tokenizer():
    odd = ["", None, "Don't STOP 'tis x.'s 12ab3 a,b..c e\u0301 <|endoftext|> Z<|ENDOFTEXT|>", "\x1c x-y_z ½ İ ΟΔΟΣ", "we'll'd it'S"]
    words = word_tokens(public_path(packing.TOKENIZER))
    ids, ends = words(pa.array([*odd, *odd], pa.string()))
    for i, text in enumerate([*odd, *odd]):
        assert ids[ends[i] : ends[i + 1]].tolist() == words.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_are_tokenised_many_at_a_time():
    words = WordTokens(public_path(packing.TOKENIZER))
    whole, texts = words.tokenizer, []

    class Told:
        def encode_batch_fast(self, given, **kind):
            texts.extend(given)
            return whole.encode_batch_fast(given, **kind)

    words.tokenizer = Told()
    text = sentence(random.Random(8), 3000, "abcdefghijklmnop") + " 4711 (x), caf\u00e9 don't ...!? e\u0301-z"
    ids, ends = words(pa.array([text, text], pa.string()))
    want = whole.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and ends.tolist() == [0, len(want), 2 * len(want)]
    assert len(texts) < len(words.keys) / 50
    # A tokenizer that does not mark the ends of words gets them one by one.
    words._clear()
    words.ending[:] = False
    assert words(pa.array([text], pa.string()))[0].tolist() == want


def test_packing(docs, rows):
    want = Counter((k, n, at, len(i), zlib.crc32(i.tobytes())) for k, n, at, i in pieces(rows, 1, 4096))
    got = packing.pack_documents(docs)
    assert counted(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    by_sequence = defaultdict(list)
    for r in got.collect():
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= -(-sum(x[3] * n for x, n in want.items()) // 4096) + 1


def test_packing_plan_covers_every_piece_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.minimum((rng.lognormal(6, 1, 20_000)).astype(int) + 1, 4096)
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    plan = packing.plan_packing(histogram)
    fill = Counter()
    for size, count in histogram.items():
        own = plan[plan[:, 0] == size]
        assert own[:, 1].tolist() == (np.cumsum(own[:, 2]) - own[:, 2]).tolist() and own[:, 2].sum() == count
        for _, _, n, first, _ in own.tolist():
            for s in range(first, first + n):
                fill[s] += size
    assert max(fill.values()) <= 4096
    assert len(fill) <= math.ceil(sizes.sum() / 4096 * 1.01) + 1


def test_shards_round_trip(docs, rows, tmp_path):
    folder = f"file://{tmp_path}/shards"
    options = {"folder": folder, "sequence": 16, "shard": 8}
    got = token_shards.write_shards(docs, **options).collect()
    want = Counter((k, n, tuple(i.tolist())) for k, n, _, i in pieces(rows, token_shards.END_ID, 16))
    slots = sorted(got, key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == list(range(len(got)))
    stored = [x.copy() for x in token_shards.read_slots(folder)]
    read = Counter((r["doc_id"], r["part"], tuple(int(i) for i in x[: r["tokens"]])) for r, x in zip(slots, stored, strict=True))
    assert read == want
    resumed = list(token_shards.read_slots(folder, 13, 9))
    assert [x.tolist() for x in resumed] == [x.tolist() for x in stored[13:22]]
    again = token_shards.write_shards(docs, **options).collect()  # whole files stay as they are
    assert len(again) == len(got) and json.loads((tmp_path / "shards/manifest.json").read_text())["sequences"] == len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation(n):
    assert sorted(permuted(np.arange(n), n, 99).tolist()) == list(range(n))
    assert n < 5 or permuted(np.arange(n), n, 99).tolist() != permuted(np.arange(n), n, 98).tolist()


# --- top k


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 5])]) for i in range(400)]
    rows += [(i + 400, rows[i][1]) for i in range(50)]  # ties
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (600, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(800, [0.0] * 8), (7, rows[7][1]), (900, [9.0] * 3), (901, [4.0, -9.0]), (902, [3.0] * 11), (903, [])]  # other lengths
    schema = "vec_id long, embedding array<float>, bucket int, score int"
    table = spark.createDataFrame([(*r, 1, 1) for r in rows], schema)
    whole = [
        (i, [math.floor(1024 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = Counter()
    for q, v in dict(whole).items():
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q and w)
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10]))
    for options in ({}, {"bucket_vectors": 40, "query_block": 2}):
        assert counted(topk.top_k(table, **options), "query_id", "rank", "vec_id", "score") == want
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 1, 1)], schema)).count() == 0


# --- URL filter


def brute_rule(url):
    text = url or ""
    rest = text.split("://", 1)[1] if "://" in text else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for verdict, rule in url_filter.RULES:
        name, start = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if (host == name or host.endswith("." + name)) and path.startswith(start) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, *best


def test_url_rules_and_trees(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/1", "x://a.b@c.example.org:80/en/1?q#f", "http://org", "://com/fr/?x"]
    urls += ["http://İx.com/de/a://b", "http://example.org/es/", "http://xexample.org/es/", "http://org/", "x" * 5000]
    for _ in range(300):
        host = rng.choice(["a.example.org", "b.example.com", "c.example.net", "www.org"])
        urls.append(f"http://{host}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randint(1, 40)}{rng.choice(['', '.html', '?a=1&b=2', '#t'])}")
    table = spark.createDataFrame([(n, u, "h", "r") for n, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(table).collect()}
    assert len(got) == len(urls)
    for n, url in enumerate(urls):
        host, path, rule, verdict = brute_rule(url)
        r = got[n]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
        assert 0 <= r["score"] <= 1
    fit = [r for r in got.values() if r["rule"]]
    assert sum((r["score"] >= 0.5) == (r["verdict"] == "block") for r in fit) > 0.9 * len(fit)
    assert url_filter.judge_urls(table.limit(0)).count() == 0
    only_null = table.where("url IS NULL")
    assert url_filter.judge_urls(only_null).collect()[0]["verdict"] in ("allow", "block")


# --- mixing


def test_mix(docs, rows):
    got = mixing.mix_sources(docs, block_words=4).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    sizes, taken, targets, of = Counter(), Counter(), {}, {}
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORDS.findall(r[1] or ""))) for r in rows)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    left, total = dict(weights), 1.5 * sum(sizes.values())
    while True:  # share, cap, and share the excess again
        level = total / sum(left.values())
        over = [s for s in left if left[s] * level > 2 * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            of[s] = 2 * sizes[s]
            total -= of[s]
            del left[s]
    of |= {s: w * level for s, w in left.items()}
    for s in names:
        assert targets[s] == pytest.approx(of[s])
        assert abs(taken[s] - of[s]) <= 8
    again = mixing.mix_sources(docs.repartition(7), block_words=4)
    assert counted(again, "doc_id", "size", "taken") == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_sainte_lague_by_highest_quotients():
    rng = random.Random(4)
    for _ in range(30):
        targets = [rng.choice([0, 1, 3.5, 10, 99]) for _ in range(5)]
        most = [rng.randint(0, 30) for _ in range(5)]
        seats = rng.randint(0, 40)
        want = [0] * 5
        for _ in range(min(seats, sum(m for m, t in zip(most, targets, strict=True) if t))):
            best = max((t / (2 * w + 1) if w < m else -1, -i) for i, (t, w, m) in enumerate(zip(targets, want, most, strict=True)))
            want[-best[1]] += 1
        got = mixing.sainte_lague(targets, seats, most)
        assert sum(got) == sum(want)
        quotients = lambda seats: sorted(t / (2 * k + 1) for t, n in zip(targets, seats, strict=True) for k in range(n))
        assert quotients(got) == pytest.approx(quotients(want))


def test_mixed_documents(docs, rows):
    out = mixing.mixed_documents(docs, block_words=4)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(WORDS.findall(r["text"]))
    want = Counter()
    for r in mixing.mix_sources(docs.dropDuplicates(["doc_id", "text"]), block_words=4).collect():
        want[r["source"]] += r["taken"]
    for source in want:
        assert words[source] == pytest.approx(want[source], rel=0.5)


# --- classifiers


def test_language(spark, docs, rows):
    rng = random.Random(9)
    alphabets = {"en": "abcdef", "de": "ghijkl", "fr": "àéèmno"}
    texts = [(i, sentence(rng, 25, alphabets[lang]), lang, "s", 1) for i, lang in enumerate(list(alphabets) * 60)]
    held = {i for i, *_ in texts if zlib.crc32(str(i).encode()) % 4 == 2}
    table = spark.createDataFrame([(i, t, None if i in held else lang, s, n) for i, t, lang, s, n in texts], DOCS)
    odd = spark.createDataFrame([(900, None, "en", "s", 1), (901, "", None, "s", 1), (902, "12 34!", "en", "s", 1), (None, "abc", "en", None, 1)], DOCS)
    got = {r["doc_id"]: r for r in language_id.identify_languages(table.unionByName(odd)).collect()}
    assert all(got[i]["held_out"] == (i in held) for i, *_ in texts)
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, *_ in texts if i in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(texts) + 4


def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["blorkish", "snarfing", "vilethug"]
    texts = []
    for i in range(300):
        words = sentence(rng, 60).split()
        if i % 3 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append((i, " ".join(words), "en", "s", 1))
    table = spark.createDataFrame([*texts, (900, None, None, None, None), (901, "", "en", "s", 0), (None, "w" * 5000, "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge_toxicity(table, labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(300)) and len(got) == 303
    assert sum(got[i]["predicted"] == int(i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[900]["predicted"] == got[901]["predicted"] == 0
    model = toxicity.fit_toxicity(table, labels)
    clean = toxicity.clean_documents(table, model)
    assert clean.columns == table.columns and 180 <= clean.count() <= 215
    none = toxicity.fit_toxicity(table, labels.where("toxic = 0"))
    assert toxicity.score_toxicity(table, none).where("predicted = 1").count() == 0


# --- empty tables


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        exact_dedup.exact_groups(empty),
        jaccard_join.near_duplicates(empty),
        suffix_repeats.repeated_strings(empty),
        packing.pack_documents(empty),
        token_shards.write_shards(empty),
        mixing.mix_sources(empty),
        mixing.mixed_documents(empty),
        language_id.identify_languages(empty),
        toxicity.judge_toxicity(empty, labels),
    ):
        assert out.count() == 0


def test_shards_of_another_key_replace_those_there(docs, tmp_path):
    """Full shards all have one size: what stands there is told by its bytes."""
    held = {}
    for name, keys in (("both", (3, 4)), ("one", (4,))):
        for key in keys:
            token_shards.write_shards(docs, folder=f"file://{tmp_path}/{name}", sequence=16, shard=8, key=key).collect()
        held[name] = [x.tolist() for x in token_shards.read_slots(f"file://{tmp_path}/{name}")]
    assert held["both"] == held["one"]
