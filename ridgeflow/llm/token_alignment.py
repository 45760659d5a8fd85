"""Alignment of two tokenizers: token spans as coarse cuts, refined by the bytes of the tokens."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeflow.llm.hashing import ragged
from ridgeflow.llm.tokens import public_path
from ridgeflow.session import cut_lineage

#: Vocabulary files of the two tokenizers.
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Most frequent id pairs, whose counts every task holds: 13 bytes each, a fixed bound.
FREQUENT_PAIRS = 100_000
#: Words that a task remembers, and code points of text that it works on at a time.
KNOWN_WORDS, SLICE_CHARS = 900_000, 1 << 20
_LEARN = 5000
#: Words that go to the tokenizers as one text: a call and a result for each cost more than its ids.
JOINED_WORDS = 200
#: Bits of a pair of ids as one number.
_PAIR_BITS = 40
#: A blank between two other characters: both tokenizers always cut before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_level_bytes() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself,
    the other bytes, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def token_ends(coarse: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Byte ends of tokens of many words, from the start of the first word.

    ``coarse`` are the byte ends of the tokens' spans, ``lengths`` their decoded bytes, ``first``
    marks the first token of each word. Spans count whole characters: where the span of a
    token, from the end before it, does not hold as many bytes as the token, a character is
    split between tokens or spelt in bytes, and the decoded bytes say where it ends."""
    decoded = np.cumsum(lengths)
    plain = np.diff(coarse, prepend=0) == lengths
    # A split character also moves the start of what follows: only whole words are trusted.
    word = np.cumsum(first) - 1
    trusted = np.bincount(word, weights=~plain, minlength=1)[word] == 0 if len(word) else plain
    return np.where(trusted, coarse, decoded)


class Aligner:
    """Tokens of both tokenizers over a blank and a text, and the groups that they share.

    Words between single blanks are aligned once, many as one text, and remembered, as neither
    tokenizer joins over such a blank; where the second one has a piece that does, texts are taken whole."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = byte_level_bytes()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters.get(c, 63) for c in t) for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces
        ]
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64)
        self.base = len(pieces)
        self.by_word = not any("▁" in p.lstrip("▁") or re.match("▁{2,}[^▁]", p) for p in pieces)
        #: Ids as they stand in the string of a group, by what follows them.
        marks = ((len(names), ","), (len(names), "|"), (self.base, ","), (self.base, ";"))
        self.shown = [f"{i}{mark}".encode() for n, mark in marks for i in range(n)]
        self.shown_from = np.cumsum([0, *(n for n, _ in marks)])
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.strings: list[bytes] = []
        #: Per word: tokens of either side, groups, links, and the number of its id pairs.
        self.counts = np.zeros((0, 5), np.int64)
        self.bad = np.zeros(0, bool)
        self.at = np.zeros(0, np.int64)
        self.codes, self.mults = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _spans(self, side: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts by one tokenizer, how many each has, and the character ends of their
        spans, counted over a blank before each text."""
        if side == 0:
            found = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
            ids, spans = [e.ids for e in found], (e.offsets for e in found)
        else:
            found = self.b.encode(texts, return_type="offset_mapping", num_threads=1)
            ids, spans = [e["ids"] for e in found], (e["offsets"] for e in found)
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(many.sum())
        flat = np.fromiter(chain.from_iterable(ids), np.int64, total)
        ends = np.fromiter(map(itemgetter(1), chain.from_iterable(spans)), np.int64, total)
        return flat, many, ends + side

    def _side(self, side: int, words: list[str], spelt: list[bytes], sizes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of words after a blank each, by one tokenizer: ids, character ends over all of them,
        numbers of the words, and whether it spells each word; others have any tokens."""
        size, own = ((self.size_a, self.bytes_a), (self.size_b, self.bytes_b))[side]

        def spells(ids: np.ndarray, wanted: list[bytes]) -> bool:
            return b"".join(map(own.__getitem__, ids.tolist())) == b"".join(wanted)

        good = np.ones(len(words), bool)
        if self.by_word:  # neither tokenizer joins over the blanks: many words are one text
            firsts = np.arange(0, len(words), JOINED_WORDS)
            flat, many, ends = self._spans(side, [" ".join(words[n : n + JOINED_WORDS]) for n in firsts.tolist()])
            upto = np.cumsum(sizes)
            decoded = np.cumsum(size[flat])
            # Where all is spelt, decoded bytes say whose a token is; each word must end with one.
            if len(flat) and decoded[-1] == upto[-1] and spells(flat, spelt):
                word = np.searchsorted(upto, decoded)
                if np.count_nonzero(decoded == upto[word]) == len(words):
                    return flat, np.repeat(chars[firsts], many) + ends, word, good
        flat, many, ends = self._spans(side, words)
        word = np.repeat(np.arange(len(words)), many)
        # All words at once where all are spelt, else word by word.
        held = np.bincount(word, weights=size[flat], minlength=len(words)) == sizes
        if not held.all() or not spells(flat, spelt):
            at = np.cumsum(many) - many
            for n in range(len(words)):
                good[n] = held[n] and spells(flat[at[n] : at[n] + many[n]], [spelt[n]])
        return flat, chars[word] + ends, word, good

    def tokens(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Of words after a blank each: start bytes, whether both tokenizers spell the word, and
        for either side the ids, byte ends and numbers of the words; words that are not spelt
        have no tokens."""
        given = [" " + w for w in words]
        spelt = [w.encode() for w in given]
        sizes = np.fromiter(map(len, spelt), np.int64, len(words))
        start = np.cumsum(sizes) - sizes
        upto = None
        if int(sizes.sum()) != sum(map(len, given)):  # characters of several bytes
            points = np.frombuffer("".join(given).encode("utf-32-le"), np.uint32)
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            upto = np.concatenate([[0], np.cumsum(width)])
        chars = np.fromiter(map(len, given), np.int64, len(given))
        chars = np.cumsum(chars) - chars
        sides = [self._side(side, words, spelt, sizes, chars) for side in (0, 1)]
        good = sides[0][3] & sides[1][3]
        out = []
        skipped = np.concatenate([[0], np.cumsum(sizes * ~good)])
        for (flat, ends, word, _), size in zip(sides, (self.size_a, self.size_b), strict=True):
            held = good[word]
            flat, ends, word = flat[held], ends[held], word[held]
            coarse = ends if upto is None else upto[ends]
            # Words that are not spelt have no tokens here: their bytes are skipped.
            first = np.diff(word, prepend=-1) > 0
            gone = skipped[word]
            out += [flat, token_ends(coarse - gone, size[flat], first) + gone, word]
        return start, good, *out

    def groups(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Groups of many words: whether each is spelt; ids, words and groups of the tokens of
        either side; start, end and word of every group, in order."""
        start, good, ids_a, ends_a, word_a, ids_b, ends_b, word_b = self.tokens(words)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # ends differ from word to word
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        word = word_a[np.searchsorted(ends_a, cuts)]
        before = np.concatenate([[0], cuts[:-1]])
        before = np.where(np.diff(word, prepend=-1) > 0, start[word], before) if len(word) else before[:0]
        return good, ids_a, word_a, group_a, ids_b, word_b, group_b, before, cuts, word

    def _learn(self, words: list[str]) -> None:
        good, ids_a, word_a, group_a, ids_b, word_b, group_b, _, cuts, word = self.groups(words)
        n, groups = len(words), len(cuts)
        many_a, many_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        # Id pairs with the number of their links; long groups by different ids only.
        links = many_a * many_b
        short = links <= 64
        owner = np.repeat(np.flatnonzero(short), links[short])
        place = ragged(np.zeros(int(short.sum()), np.int64), links[short])
        pair = ids_a[first_a[owner] + place // many_b[owner]] * self.base + ids_b[first_b[owner] + place % many_b[owner]]
        held, times = [np.stack([word[owner], pair], axis=1)], [np.ones(len(pair), np.int64)]
        for g in np.flatnonzero(~short).tolist():
            a, x = np.unique(ids_a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
            b, y = np.unique(ids_b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
            codes = (a[:, None] * self.base + b[None, :]).ravel()
            held.append(np.stack([np.full(len(codes), word[g]), codes], axis=1))
            times.append((x[:, None] * y[None, :]).ravel())
        held, times = np.concatenate(held), np.concatenate(times)
        order = np.argsort(held[:, 0] << _PAIR_BITS | held[:, 1])
        held, times = held[order], times[order]
        new = np.ones(len(held), bool)
        new[1:] = (held[1:] != held[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        self.codes = np.concatenate([self.codes, held[at, 1]])
        self.mults = np.concatenate([self.mults, np.add.reduceat(times, at) if len(at) else times])
        # Strings: the ids of a group, first one side, then the other, each with what follows it.
        # Both sides stand in the order of the groups: a token comes after what the other has before it.
        shown = np.zeros(len(ids_a) + len(ids_b), np.int64)
        for ids, group, other, side in ((ids_a, group_a, first_b, 0), (ids_b, group_b, first_a + many_a, 2)):
            last = np.append(group[1:] != group[:-1], True)[: len(group)]
            shown[np.arange(len(ids)) + other[group]] = self.shown_from[side + last] + ids
        parts = list(map(self.shown.__getitem__, shown.tolist()))
        counts = [np.bincount(v, minlength=n) for v in (word_a, word_b, word)]
        begin = 0
        for w, end in zip(words, np.cumsum(counts[0] + counts[1]).tolist(), strict=True):
            self.known[w] = len(self.strings)
            self.strings.append(b"".join(parts[begin:end])[:-1])
            begin = end
        sums = np.bincount(word, weights=links, minlength=n).astype(np.int64)
        self.counts = np.concatenate([self.counts, np.stack([*counts, sums, np.bincount(held[at, 0], minlength=n)], axis=1)])
        self.bad = np.concatenate([self.bad, ~good])
        self.at = np.cumsum(self.counts[:, 4]) - self.counts[:, 4]

    def words(self, text: str) -> list[str]:
        return _CUT.split(text) if self.by_word else [text]

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > KNOWN_WORDS:
            self._clear()
        new = list({w for words in texts for w in words} - self.known.keys())
        for first in range(0, len(new), _LEARN):
            self._learn(new[first : first + _LEARN])

    def document(self, words: list[str]) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """Of a text whose words are learnt: counts of tokens, groups and links, the digest of
        its groups, and its id pairs with the number of their links."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.bad[at].any():
            return [0] * 4, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        digest = hashlib.sha256(b";".join([self.strings[i] for i in at.tolist()])).hexdigest()
        totals = self.counts[at, :4].sum(axis=0).tolist()
        at, times = np.unique(at, return_counts=True)
        many = self.counts[at, 4]
        places = ragged(self.at[at], many)
        codes, links = self.codes[places], self.mults[places] * np.repeat(times, many)
        order = np.argsort(codes)
        codes = codes[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
        return totals, digest, codes[first], np.add.reduceat(links[order], first)


_NOTHING = (np.ones(1, bool), *[np.zeros(0, np.int64)] * 9)
_loaded: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_path: str, piece_path: str) -> Aligner:
    """The aligner of two files; a worker keeps it between batches and tasks."""
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _loaded[byte_path, piece_path]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows in slices of about SLICE_CHARS characters with their texts; null is empty."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, first = np.cumsum(sizes), 0
        while first < len(batch):
            last = int(np.searchsorted(upto, (upto[first - 1] if first else 0) + SLICE_CHARS, side="right"))
            part = batch.slice(first, max(last, first + 1) - first)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            first += len(part)


def aligned_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    byte_tokenizer: str | None = None,
    piece_tokenizer: str | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id`` and ``groups``, an array of (start, end, a, b).

    A group is the bytes [start, end) of a blank and the text between two places where tokens
    of both tokenizers end, with the ids of both there. Null and empty texts, and texts whose
    tokens do not spell these bytes, have no groups. Repeated rows and null ids stay; other
    columns are ignored."""
    paths = (byte_tokenizer or public_path(BYTE_TOKENIZER), piece_tokenizer or public_path(PIECE_TOKENIZER))
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(*paths)
        for part, texts in _slices(batches, 1):
            rows = []
            for t in texts:
                good, ids_a, _, group_a, ids_b, _, group_b, starts, ends, _ = own.groups(own.words(t)) if t else _NOTHING
                a = np.split(ids_a, np.searchsorted(group_a, np.arange(1, len(ends))))
                b = np.split(ids_b, np.searchsorted(group_b, np.arange(1, len(ends))))
                spans = zip(starts.tolist(), ends.tolist(), a, b, strict=True) if good.all() and len(ends) else ()
                rows.append([{"start": s, "end": e, "a": x.tolist(), "b": y.tolist()} for s, e, x, y in spans])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "groups"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


def align_tokens(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    byte_tokenizer: str | None = None,
    piece_tokenizer: str | None = None,
    frequent: int = FREQUENT_PAIRS,
) -> DataFrame:
    """How two tokenizers align on every document, and how common their id pairs are.

    Both tokenise a blank and the text. Byte places where tokens of both end cut the tokens
    into groups; every pair of occurrences in a group is a link. The count of an id pair is
    the number of rows that hold it linked. Returns one row per input row: ``doc_id``,
    ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest of
    their first id), ``count_sum`` (over the links) and ``groups_sha256``.

    Character offsets of the first tokenizer and spans of the second are the coarse cuts;
    tokens that hold part of a character, and byte fall-backs, are refined by decoded bytes.
    Each row's id pairs are written once. Pairs are counted by a partial aggregation per task;
    the counts of the ``frequent`` most common ones, a fixed number, go to every task, so that
    pairs which many rows hold never move again; only the links of rarer pairs are joined with
    their counts, and no such pair is held by more than all links / ``frequent`` rows.

    Null and empty texts, and texts whose tokens do not spell their bytes (special characters
    that a tokenizer changes, runs of blanks that it drops), have zeros and an empty digest.
    Rows that repeat are rows of their own and count; null ids stay null; an empty table gives
    an empty result; other columns are ignored."""
    paths = (byte_tokenizer or public_path(BYTE_TOKENIZER), piece_tokenizer or public_path(PIECE_TOKENIZER))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(*paths)
        for part, texts in _slices(batches, 2):
            words = [own.words(t) if t else [] for t in texts]
            own.learn(words)
            found = [own.document(w) if w else ([0] * 4, "", *[np.zeros(0, np.int64)] * 2) for w in words]
            sizes = np.cumsum([0, *(len(f[2]) for f in found)]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([f[k] for f in found]), pa.int64())) for k in (2, 3)
            ]
            totals = [pa.array([f[0][k] for f in found], pa.int64()) for k in range(4)]
            digest = pa.array([f[1] for f in found], pa.string())
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "links"]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *totals, digest, *lists], names)

    given = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")
    )
    own = cut_lineage(
        given.mapInArrow(
            tokenised,
            "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, links array<long>",
        )
    )
    # The base of the codes is the size of the second vocabulary.
    base = Aligner(*paths).base
    counts = own.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("rows"))
    counts = cut_lineage(counts.withColumn("a", F.expr(f"code div {base}")))
    highest = counts.groupBy("a").agg(F.max("rows").alias("highest"))
    counts = cut_lineage(counts.join(highest, "a").select("code", "rows", (F.col("rows") == F.col("highest")).alias("best")))
    top = sorted((r["code"], r["rows"], r["best"]) for r in counts.orderBy(F.desc("rows"), "code").limit(frequent).collect())
    top_code = np.array([t[0] for t in top], np.int64)
    top_rows = np.array([t[1] for t in top], np.int64)
    top_best = np.array([t[2] for t in top], bool)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, links = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))])
            ends = ends.astype(np.int64)
            at = np.minimum(np.searchsorted(top_code, codes), max(len(top_code) - 1, 0))
            held = top_code[at] == codes if len(top_code) else np.zeros(len(codes), bool)

            def per_row(values: np.ndarray, ends=ends) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])

            some = links * held
            total = per_row(some * top_rows[at]) if len(top_code) else np.zeros(len(batch), np.int64)
            best = per_row(some * top_best[at]) if len(top_code) else np.zeros(len(batch), np.int64)
            left = np.concatenate([[0], np.cumsum(~held)])[ends].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(v[~held], pa.int64())) for v in (codes, links)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(best, pa.int64()), *rest],
                ["row", "top_sum", "top_best", "rest_codes", "rest_links"],
            )

    schema = "row long, top_sum long, top_best long, rest_codes array<long>, rest_links array<long>"
    part = cut_lineage(own.select("row", "codes", "links").mapInArrow(counted, schema))
    zipped = F.explode(F.arrays_zip("rest_codes", "rest_links")).alias("pair")
    rare = part.where("size(rest_codes) > 0").select("row", zipped).select("row", "pair.*")
    rare = rare.join(counts, F.col("rest_codes") == F.col("code")).groupBy("row").agg(
        F.sum(F.col("rest_links") * F.col("rows")).alias("rare_sum"),
        F.sum(F.when(F.col("best"), F.col("rest_links")).otherwise(0)).alias("rare_best"),
    )
    zero = F.lit(0).cast("long")
    return (
        own.drop("codes", "links")
        .join(part.select("row", "top_sum", "top_best"), "row")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "n_a",
            "n_b",
            "n_groups",
            "n_links",
            (F.col("top_best") + F.coalesce("rare_best", zero)).alias("n_best"),
            (F.col("top_sum") + F.coalesce("rare_sum", zero)).alias("count_sum"),
            "groups_sha256",
        )
    )
