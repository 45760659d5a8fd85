"""Token ids of whole text columns: each different word of a batch is tokenised once."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from ridgeflow.llm.hashing import ragged, running_hash, slices, span_hash, text_buffer

#: Bytes of text worked on at a time, and the words that a task remembers.
SLICE_BYTES, KNOWN_WORDS = 1 << 20, 1_200_000
#: Words that go to the tokenizer as one text: a call and a result for each cost more than its ids.
JOINED_WORDS = 200
# Byte classes: blank, letter, digit, mark, anything else (never split next to it).
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _BLANK
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[list(b".,;:!?()[]{}\"-/*=+&%$#@")] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def public_path(name: str) -> str:
    """Place of a public vocabulary file, on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids of a tokenizer that lower-cases text and never joins words over blanks.

    Texts are cut at blanks, and between ASCII letters, digits and marks, where this kind of
    tokenizer cuts too; each different piece goes to the tokenizer once and its ids are
    gathered for all its places. Pieces of one class are one word to the tokenizer and are
    tokenised many at a time, between blanks, where it marks the last token of a word. Texts
    that hold the opening of a special token are tokenised whole. Equal to tokenising each
    text on its own (tests compare)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids that end a word; none where the tokenizer does not mark them.
        self.ending = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if mark := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.ending[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.uint32)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of one class, joined; one by one where their ends cannot be told."""
        flat, _ = self._ids([" ".join(words[n : n + JOINED_WORDS]) for n in range(0, len(words), JOINED_WORDS)])
        ends = np.flatnonzero(self.ending[flat]) + 1
        if len(ends) != len(words) or len(ends) and ends[-1] != len(flat):
            return self._ids(words)
        return flat, np.diff(ends, prepend=0)

    def _learn(self, keys: np.ndarray, words: list[str], plain: np.ndarray) -> None:
        """Ids of new words; ``plain`` are those whose bytes are of one class."""
        size, parts = np.zeros(len(words), np.int64), []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        at = int(plain.sum())
        for own, encode in ((order[:at], self._word_ids), (order[at:], self._ids)):
            ids, size[own] = encode([words[i] for i in own.tolist()])
            parts.append(ids)
        flat = np.concatenate(parts)
        keys, size = keys[order], size[order]
        up = np.argsort(keys)
        at = len(self.flat) + np.cumsum(size) - size
        keys, at, size = keys[up], at[up], size[up]
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at = np.insert(self.keys, place, keys), np.insert(self.at, place, at)
        self.size = np.insert(self.size, place, size)
        self.flat = np.concatenate([self.flat, flat])

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = _LOWER[data]
        kind = _CLASS[low]
        word = kind != _BLANK
        cut = np.ones(len(low) + 1, bool)
        before, after = kind[:-1], kind[1:]
        cut[1:-1] = (before != after) | (before == _DIGIT)
        cut[1:-1] &= (before != _OTHER) & (after != _OTHER) | (before == _BLANK) | (after == _BLANK)
        cut[offsets] = True
        start = np.flatnonzero(word & cut[:-1])
        end = np.flatnonzero(word & cut[1:]) + 1
        hashes = span_hash(running_hash(low), start, end)
        keys, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw, first = low.tobytes(), first[new]
            words = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            # Pieces are cut where the class changes but next to other bytes: without any they are of one.
            mixed = np.concatenate([[0], np.cumsum(kind == _OTHER)])
            plain = mixed[end[first]] == mixed[start[first]]
            self._learn(keys[new], words, plain)
            at = np.searchsorted(self.keys, keys)
        size = self.size[at][where].astype(np.int64)
        ids = self.flat[ragged(self.at[at][where].astype(np.int64), size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, upto[np.searchsorted(start, offsets)]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other, and the offsets of the texts."""
        data, offsets = text_buffer(column)
        parts, ends = [], [np.zeros(1, np.int64)]
        total = 0
        for first, last in slices(offsets, SLICE_BYTES):
            here = offsets[first : last + 1] - offsets[first]
            piece = data[offsets[first] : offsets[last]]
            special = b"<|" in piece.tobytes()
            ids, upto = self._whole(piece, here) if special else self._slice(piece, here)
            parts.append(ids)
            ends.append(total + upto[1:])
            total += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate(ends)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            raw = data[a:b].tobytes()
            if b"<|" in raw:
                parts.append(np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(self._slice(data[a:b], np.array([0, b - a]))[0])
        size = np.array([len(p) for p in parts], np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(size)])


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most: what is made of them stays small too."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows)


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of a file; a worker keeps it between batches and tasks."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]
