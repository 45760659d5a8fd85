"""Spelling variants: a minimised vocabulary acceptor composed with a one-edit transducer and itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.session import cut_lineage

#: Words have so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form has so many times the occurrences of the word.
CONTRAST = 5
#: Words of one initial state that a task composes at once; larger states are split.
STATE_WORDS = 20_000
#: Characters of a run, as ranges of a regular expression.
LETTERS = r"A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """Minimal deterministic acceptor of sorted words: states with equal futures are one.

    ``arcs[q]`` maps a character to the next state, ``final`` holds the accepting states."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.register: dict[tuple, int] = {}
        path: list[dict[str, int | None]] = [{}]
        ends = [False]
        before = ""
        for word in words:
            same = 0
            while same < min(len(word), len(before)) and word[same] == before[same]:
                same += 1
            self._fold(path, ends, before, same)
            for c in word[same:]:
                path[-1][c] = None
                path.append({})
                ends.append(False)
            ends[-1] = True
            before = word
        self._fold(path, ends, before, 0)
        self.start = self._state(path[0], ends[0])

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in self.register:
            self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self.register[key]

    def _fold(self, path: list, ends: list[bool], word: str, down: int) -> None:
        """States below depth ``down`` of the last word are complete: each becomes a known one."""
        for depth in range(len(path) - 1, down, -1):
            path[depth - 1][word[depth - 1]] = self._state(path.pop(), ends.pop())


def one_edit_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of words that differ by exactly one code point replaced, or inserted into the first.

    States of the composition are (state of the acceptor, edits so far, state of the
    acceptor). Before the edit both acceptors read the same word; behind it both must accept
    one common rest. A pair comes once: its edit is where the two first differ."""
    machine = Acceptor(words)
    arcs, final = machine.arcs, machine.final
    known: dict[tuple[int, int], list[str]] = {}

    def rests(p: int, q: int) -> list[str]:
        """Words that both states accept, behind the edit."""
        key = (p, q) if p < q else (q, p)
        if key not in known:
            read = []
            while len(both := [c for c in arcs[p] if c in arcs[q]]) == 1 and not (final[p] and final[q]):
                read += both
                p, q = arcs[p][both[0]], arcs[q][both[0]]
            out = [""] if final[p] and final[q] else []
            for c in both:
                out += [c + rest for rest in rests(arcs[p][c], arcs[q][c])]
            known[key] = ["".join(read) + rest for rest in out]
        return known[key]

    def inserted(q: int, c: str) -> list[str]:
        """Rests behind an inserted ``c`` that do not begin with it: those differ further on."""
        to = arcs[q][c]
        out = [""] if final[q] and final[to] else []
        for d in arcs[q]:
            if d != c and d in arcs[to]:
                out += [d + rest for rest in rests(arcs[q][d], arcs[to][d])]
        return out

    waiting = [(machine.start, "")]
    while waiting:
        q, read = waiting.pop()
        own = list(arcs[q].items())
        for n, (c, to) in enumerate(own):
            waiting.append((to, read + c))
            for d, other in own[:n]:
                for rest in rests(to, other):
                    yield read + d + rest, read + c + rest
            for rest in inserted(q, c):
                yield read + rest, read + c + rest


def lowered(run: Column) -> Column:
    """A to Z in lower case, other letters as they are; one pass over ASCII words."""
    ascii_only = F.octet_length(run) == F.char_length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def word_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    misspelt: int | None = None,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``word`` and ``n`` of every run of letters with enough code points and occurrences.

    ``misspelt`` plants errors: where it divides the crc32 of ``<doc_id>:<word>``, the code
    point at crc32 modulo the word's length is deleted. Null texts have no words; a null id
    counts as an empty one there. Occurrences are summed per task before they move."""
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.split(text, f"[^{LETTERS}]+")).alias("run")
    )
    words = runs.where(F.char_length("run") >= least_length).select("id", lowered(F.col("run")).alias("word"))
    if misspelt:
        words = words.select("word", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")).alias("h"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        words = words.select(F.when(F.col("h") % misspelt == 0, shorter).otherwise(F.col("word")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def _composed(rows: DataFrame) -> DataFrame:
    """Pairs within every initial state: rows (side, m, state, word) sorted by state, read as a
    stream; memory holds one state's words."""

    def pairs(side: str, m: int, state: str, words: list[str]) -> Iterator[tuple[str, str]]:
        turn = slice(None, None, -1) if side == "r" else slice(None)
        skip, half = len(state), m // 2
        for u, v in one_edit_pairs(sorted({w[turn][skip:] for w in words})):
            if len(u) == m - skip:
                u, v = (state + u)[turn], (state + v)[turn]
                if side == "f" or u[:half] != v[:half]:
                    yield u, v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, []
        out: list[tuple[str, str]] = []
        for batch in batches:
            for *key, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if len(words) > 1:
                        out += pairs(*now, words)
                    now, words = key, []
                words.append(word)
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        if len(words) > 1:
            out += pairs(*now, words)
        yield _pairs(out)

    return rows.mapInArrow(run, "u string, v string")


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["u", "v"])


def near_words(vocabulary: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """Pairs (u, v) of different words of ``word`` that are one edit apart, each once, u not longer.

    Let m be the length of the shorter one. Two such words agree on their first m // 2 code
    points, or else on as many of their last: every word is a row under the state that the
    acceptor reaches on the one, and the acceptor of reversed words on the other, for each m
    that it may have a part in. Each such initial state is composed on its own. A state with
    more than ``state_words`` words is split: words go on to the states one code point deeper,
    and pairs whose edit is that code point are joined on all that is before and behind it,
    at most one word per letter there."""
    word, size = F.col("word"), F.char_length("word")
    rows = vocabulary.select("word", F.explode(F.array(size, size - 1)).alias("m")).where("m > 1")
    rows = rows.select("word", "m", F.explode(F.array(F.lit("f"), F.lit("r"))).alias("side"))
    half = (F.col("m") / 2).cast("int")
    turned = F.when(F.col("side") == "f", word).otherwise(F.reverse(word))
    rows = rows.select("side", "m", F.substring(turned, F.lit(1), half).alias("state"), "word")
    key = ["side", "m", "state"]
    parts: list[DataFrame] = []
    while True:
        rows = cut_lineage(rows)
        states = rows.groupBy(key).agg(F.count("*").alias("words"), F.min(F.char_length("word") - F.col("m")).alias("extra"))
        states = cut_lineage(states.where("words > 1 AND extra = 0"))
        large = states.where(F.col("words") > state_words).select(key)
        small = states.where(F.col("words") <= state_words).select(key)
        own = rows.join(small, key, "left_semi")
        parts.append(_composed(own.repartition(*key).sortWithinPartitions(*key).select(*key, "word")))
        if large.isEmpty():
            break
        deep = rows.join(large, key, "left_semi")
        done = F.char_length("state")
        turned = F.when(F.col("side") == "f", F.col("word")).otherwise(F.reverse("word"))
        deep = deep.select(*key, "word", turned.alias("turned"), done.alias("done"))
        far = F.substring(F.col("turned"), F.col("done") + 2, F.char_length("turned"))
        near = F.substring(F.col("turned"), F.col("done") + 1, F.char_length("turned"))
        short = F.char_length("word") == F.col("m")
        one = deep.where(short).select(*key, "word", "turned", "done", near.alias("near"), far.alias("rest"))
        same = one.select(*key, "rest", F.col("word").alias("v"))
        replaced = one.join(same, [*key, "rest"]).where("word < v").select(*key, F.col("word").alias("u"), "v")
        longer = deep.where(~short).select(*key, far.alias("near"), F.col("word").alias("v"), F.col("turned").alias("longer"))
        inserted = one.join(longer, [*key, "near"]).where(
            F.substring(F.col("turned"), F.col("done") + 1, F.lit(1)) != F.substring(F.col("longer"), F.col("done") + 1, F.lit(1))
        )
        both = replaced.unionByName(inserted.select(*key, F.col("word").alias("u"), "v"))
        first = F.substring(F.col("u"), F.lit(1), half) != F.substring(F.col("v"), F.lit(1), half)
        parts.append(both.where((F.col("side") == "f") | first).select("u", "v"))
        rows = deep.where(F.char_length("turned") > F.col("done")).select(
            "side", "m", F.substring(F.col("turned"), F.lit(1), F.col("done") + 1).alias("state"), "word"
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def spelling_variants(counts: DataFrame, contrast: int = CONTRAST, state_words: int = STATE_WORDS) -> DataFrame:
    """Words (``word``, ``n``) with their near words, forms and roots.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point.
    A word's ``form`` is its near word with most occurrences (ties: the smallest in code-point
    order) if it has ``contrast`` times the word's, else null; ``root`` follows forms to the
    last; ``n_near`` counts near words; ``form_n`` is the form's ``n``. One row per word.

    Occurrences rise by ``contrast`` along forms, so a chain is short; roots are found by
    doubling the steps. An empty table gives an empty result."""
    counts = cut_lineage(counts.select("word", F.col("n").cast("long").alias("n")))
    pairs = near_words(counts, state_words)
    pairs = cut_lineage(pairs)
    both = pairs.union(pairs.select("v", "u"))
    near = both.join(counts.select(F.col("word").alias("v"), "n"), "v")
    best = near.groupBy("u").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "v")).alias("best"))
    enough = -F.col("best.less") >= contrast * F.col("n")
    words = cut_lineage(
        counts.join(best, counts["word"] == best["u"], "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.v")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    steps = words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        # A word's root so far is followed by the root so far of that word.
        then = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut_lineage(steps.join(then, "root", "left"))
        if joined.where("next IS NOT NULL").isEmpty():
            break
        steps = joined.select("word", F.coalesce("next", "root").alias("root"))
    return words.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
