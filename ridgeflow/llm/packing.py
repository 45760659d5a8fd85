"""Best-fit packing: length patterns by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeflow.llm.prefix import running_before, spread
from ridgeflow.llm.tokens import public_path, small_batches, word_tokens
from ridgeflow.session import cut_lineage

TOKENIZER = "word_bpe_49k.json"
LENGTH = 4096
END_ID = 1
#: Tokens of a step of the coarse lengths, documents of a pattern, and rounds of the fit.
STEP, DEPTH, ROUNDS = 64, 4, 3000
#: Coarse lengths under this share of a sequence keep room in their pattern only.
SHORT = 1 / 3

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    length: int = LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Token pieces of every text: whole documents, cut only where longer than a sequence.

    A null or empty text has the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(public_path(tokenizer))
        for batch in small_batches(batches):
            ids, ends = words(batch.column(1))
            keys = batch.column(0).cast(pa.int64()).to_pylist()
            rows: list[tuple] = []
            for key, a, b in zip(keys, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for n, at in enumerate(range(0, len(own), length)):
                    part = own[at : at + length]
                    rows.append((key, n, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, _PIECES)


def length_patterns(units: int, depth: int) -> np.ndarray:
    """Multisets of at most ``depth`` coarse lengths that fill a sequence: a row per pattern."""
    found: list[list[int]] = []

    def grow(parts: list[int], left: int) -> None:
        if not left:
            found.append(parts)
        elif len(parts) < depth:
            for size in range(min(parts[-1] if parts else left, left), 0, -1):
                if size * (depth - len(parts)) < left:
                    break
                grow([*parts, size], left - size)

    grow([], units)
    table = np.zeros((len(found), units), np.int64)
    for row, parts in enumerate(found):
        np.add.at(table[row], np.array(parts) - 1, 1)
    return table


def non_negative_fit(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 with the least squares of patterns' x - histogram.

    Accelerated projected gradients; long lengths weigh more, since nothing can fill the
    rest of a sequence that lacks one."""
    weight = np.arange(1, patterns.shape[1] + 1, dtype=float)
    a = patterns.T * weight[:, None]
    b = histogram * weight
    scale = float(np.linalg.norm(a, 2) ** 2) if a.size else 1.0
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - a.T @ (a @ y - b) / scale, 0.0)
        turn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / turn * (new - x), new, turn
    return x


def plan_packing(
    histogram: dict[int, int], length: int = LENGTH, step: int = STEP, depth: int = DEPTH
) -> np.ndarray:
    """Where the pieces of each length go: rows (length, rank, count, sequence, offset).

    The ``count`` pieces of this length from ``rank`` on go to as many sequences from
    ``sequence`` on, at ``offset``. The work depends on the number of lengths, not of pieces:
    sequences with the same lengths are one entry with a count.

    Coarse patterns take floor(repeats) of the fit; a place of coarse length k takes the
    longest pieces left in that class. Places of short lengths stay open: a coarse length is
    rounded up, and short pieces use the odd room best when they go by exact lengths. What is
    left is packed by best fit, longest first, into the gaps of the patterns and then into
    new sequences."""
    units = -(-length // step)
    left = np.zeros(length + 1, np.int64)
    for size, count in histogram.items():
        left[size] += count
    rank = np.zeros(length + 1, np.int64)
    coarse = np.zeros(units, np.int64)
    np.add.at(coarse, (np.arange(1, length + 1) - 1) // step, left[1:])
    patterns = length_patterns(units, depth)
    repeats = non_negative_fit(patterns, coarse.astype(float))
    rows: list[tuple[int, int, int, int, int]] = []
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # by gap: (sequence, count)
    sequences = 0

    def longest(k: int, most: int) -> tuple[int, int]:
        low, high = k * step + 1, min((k + 1) * step, length)
        for size in range(high, low - 1, -1):
            if left[size]:
                return size, min(most, int(left[size]))
        return 0, 0

    for row in np.argsort(-repeats, kind="stable"):
        parts = np.flatnonzero(patterns[row])
        many = patterns[row][parts]
        times = int(min(np.floor(repeats[row] + 1e-6), *(coarse[parts] // many)))
        if times <= 0:
            continue
        coarse[parts] -= times * many
        slots = [int(k) for k, m in zip(parts, many, strict=True) for _ in range(m) if k >= units * SHORT]
        if not slots:
            continue
        while times:
            # As many sequences at once as take the same lengths.
            for now in (times, 1):
                taken, fits = [], now
                trial = {}
                for k in slots:
                    size, n = 0, 0
                    for size in range(min((k + 1) * step, length), k * step, -1):
                        n = int(left[size]) - trial.get(size, 0) * now
                        if n >= now or (n > 0 and now > 1):
                            break
                    taken.append(size)
                    trial[size] = trial.get(size, 0) + 1
                    fits = min(fits, int(left[size]) // trial[size])
                if fits:
                    break
            offset = 0
            for size in taken:
                rows.append((size, int(rank[size]), fits, sequences, offset))
                rank[size] += fits
                left[size] -= fits
                offset += size
            open_at[length - offset].append((sequences, fits))
            sequences += fits
            times -= fits
    gaps = np.array([len(o) for o in open_at])
    for size in range(length, 0, -1):
        while left[size]:
            fit = size + int(np.argmax(gaps[size:] > 0))
            if not gaps[fit]:
                at, count, used = sequences, int(left[size]), 0
                # New sequences, filled with as many of this length as fit.
                each = length // size
                full, rest = divmod(count, each)
                for first, number, per in ((at, full, each), (at + full, 1 if rest else 0, rest)):
                    for n in range(per if number else 0):
                        rows.append((size, int(rank[size]), number, first, n * size))
                        rank[size] += number
                    if number:
                        open_at[length - per * size].append((first, number))
                        gaps[length - per * size] += 1
                sequences += full + (1 if rest else 0)
                left[size] = 0
            else:
                at, count = open_at[fit].pop()
                used = min(count, int(left[size]))
                if used < count:
                    open_at[fit].append((at + used, count - used))
                rows.append((size, int(rank[size]), used, at, length - fit))
                rank[size] += used
                left[size] -= used
                open_at[fit - size].append((at, used))
                gaps[fit - size] += 1
                gaps[fit] = len(open_at[fit])
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    length: int = LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Packs all documents into few sequences of at most ``length`` tokens.

    Returns one row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``. Only documents longer than a sequence are cut. The
    histogram of lengths (``length`` rows at most) is planned as a whole; every piece then
    finds its place by its rank among pieces of its length, ranked by sub-buckets so that no
    length, however frequent, is sorted as a whole.

    Null and empty texts are one token, the end id. Repeated rows and ids are packed as
    often as they stand there; null ids stay null; other columns are ignored."""
    pieces = cut_lineage(cut_pieces(docs, doc_id, text, tokenizer, length, end_id))
    counts = pieces.groupBy("length").count().collect()  # at most ``length`` rows
    plan = plan_packing({r["length"]: r["count"] for r in counts}, length)
    total = sum(r["count"] for r in counts)
    placed = pieces.withColumns({"_place": F.xxhash64("doc_id", "piece"), "_one": F.lit(1)})
    ranked = running_before(placed, ["length"], "_place", ["doc_id", "piece", "ids_crc32"], "_one", "_rank", spread(total))
    ranked = ranked.drop("_place", "_one")
    lengths = np.searchsorted(plan[:, 0], np.arange(length + 2))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size, rank = batch["length"].to_numpy(np.int64), batch.pop("_rank").to_numpy(np.int64)
            order = np.lexsort((rank, size))
            row = np.zeros(len(batch), np.int64)
            for s in np.unique(size):
                own = order[np.searchsorted(size[order], s) : np.searchsorted(size[order], s, side="right")]
                ranks = plan[lengths[s] : lengths[s + 1], 1]
                row[own] = lengths[s] + np.searchsorted(ranks, rank[own], side="right") - 1
            at = plan[row]
            yield batch.assign(sequence_id=at[:, 3] + rank - at[:, 1], offset=at[:, 4])

    return ranked.mapInPandas(place, f"{_PIECES}, sequence_id long, offset long")
