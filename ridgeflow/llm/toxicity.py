"""Toxicity by compression distance: one zstandard dictionary per class, window by window."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeflow.llm.language_id import fold

#: Labelled documents that are fitted on, of each class at most.
FIT_TOXIC, FIT_ORDINARY = 1200, 3000
#: Words of a window, and bytes at most (a longer run of bytes is cut).
WINDOW_WORDS, WINDOW_BYTES = 8, 1024
#: Ordinary windows that the trainer of the dictionary reads at most, evenly over the texts.
ORDINARY_WINDOWS = 200_000
#: Below so many toxic texts calibration takes ten folds, from there on two.
FEW_TOXIC = 100
#: Bytes of the two dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 32768, 8192
#: A letter 5-gram is toxic if it is so many times as frequent, by documents, as in ordinary
#: text, and in so many toxic documents at least; a segment needs two such.
CONTRAST, LEAST_DOCUMENTS, GRAM = 40.0, 3, 5
SEED = 5
_BATCH_BYTES = 1 << 18
#: Texts that a task turns into strings at a time.
_ROWS = 200


def window_segments(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Windows of the texts: a buffer, (offset, length) rows into it, and the text of each.

    A window is WINDOW_WORDS words in lower case with a blank before and after."""
    parts, at, spans, owner = [], 0, [], []
    for n, text in enumerate(texts):
        plain = b" " + " ".join((text or "").lower().split()).encode("utf-8", "replace") + b" "
        parts.append(plain)
        blanks = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        if len(plain) > 2:
            start = blanks[:-1:WINDOW_WORDS]
            end = np.append(blanks[WINDOW_WORDS::WINDOW_WORDS], blanks[-1])[: len(start)] + 1
            if (end - start > WINDOW_BYTES).any():
                cuts = [np.arange(a, b, WINDOW_BYTES) for a, b in zip(start, end, strict=True)]
                end = np.concatenate([np.append(c[1:], b) for c, b in zip(cuts, end, strict=True)])
                start = np.concatenate(cuts)
            spans.append(np.stack([start + at, end - start], axis=1))
            owner.append(np.full(len(start), n))
        at += len(plain)
    table = np.concatenate(spans).astype(np.uint64) if spans else np.zeros((0, 2), np.uint64)
    return b"".join(parts), table, np.concatenate(owner) if owner else np.zeros(0, np.int64)


class Lengths:
    """Compressed length of windows under a raw dictionary.

    Windows are short, so the header is bare and the match finder keeps every place of the
    dictionary: two dictionaries then differ by what they hold, not by collisions."""

    def __init__(self, content: bytes):
        parameters = zs.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=17, search_log=7, min_match=4, target_length=64,
            strategy=zs.STRATEGY_BTLAZY2, format=zs.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        words = zs.ZstdCompressionDict(content or b" " * 8, dict_type=zs.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=parameters)
        self.compressor = zs.ZstdCompressor(dict_data=words, compression_params=parameters)

    def __call__(self, data: bytes, spans: np.ndarray) -> np.ndarray:
        if not len(spans):
            return np.zeros(0, np.int64)
        got = self.compressor.multi_compress_to_buffer(zs.BufferWithSegments(data, np.ascontiguousarray(spans).tobytes()))
        return np.fromiter(map(len, (got[i] for i in range(len(got)))), np.int64, len(got))


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on samples; too few to train are content themselves."""
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _letters(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split() if len(w) > 2]


def _grams(word: str) -> list[str]:
    word = f" {word} "
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def toxic_samples(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Segments of the toxic texts that ordinary text lacks: what the toxic dictionary learns."""
    seen, common = Counter(), Counter()
    for text in toxic:
        seen.update({g for w in set(_letters(text)) for g in _grams(w)})
    for text in ordinary:
        common.update({g for w in set(_letters(text)) for g in _grams(w)} & seen.keys())
    rate = CONTRAST * max(len(toxic), 1) / max(len(ordinary), 1)
    unseen = 0.5 if len(toxic) >= FEW_TOXIC else 0.25  # what not seeing a gram counts for
    marked = {g for g, n in seen.items() if n >= LEAST_DOCUMENTS and n >= rate * (common[g] + unseen)}
    segments: dict[str, bool] = {}
    out = []
    for text in toxic:
        words = _letters(text)
        for w in set(words) - segments.keys():
            segments[w] = sum(g in marked for g in _grams(w)) > 1
        own = [w for w in words if segments[w]]
        if own:
            out.append(f" {'  '.join(own)} ".encode())
    return out


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients of a logistic regression (the last one is the constant), by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


@dataclass(frozen=True)
class ToxicityModel:
    """Contents of the two dictionaries and the calibration of window differences to scores."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None
    #: Score of every text where there are no weights.
    share: float = 0.0

    def features(self, texts: list[str | None], lengths: tuple[Lengths, Lengths]) -> np.ndarray:
        """Per text: largest difference of the two lengths, sum of the three largest, and the mean."""
        out = np.zeros((len(texts), 3))
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size < _BATCH_BYTES):
                size += len(texts[last] or "")
                last += 1
            data, spans, owner = window_segments(texts[first:last])
            gain = (lengths[0](data, spans) - lengths[1](data, spans)).astype(float)
            order = np.lexsort((-gain, owner))
            own, sorted_gain = owner[order], gain[order]
            start = np.searchsorted(own, np.arange(last - first))
            count = np.searchsorted(own, np.arange(last - first), side="right") - start
            for k in range(3):
                has = count > k
                value = sorted_gain[start[has] + k]
                if k == 0:
                    out[first:last, 0][has] = value
                out[first:last, 1][has] += np.maximum(value, 0)
            total = np.bincount(owner, weights=gain, minlength=last - first)
            out[first:last, 2] = total / np.maximum(count, 1)
            first = last
        return np.clip(out, -4, [16, 32, 4]) * [0.5, 0.25, 2.0]

    def score(self, texts: list[str | None], lengths: tuple[Lengths, Lengths]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = self.features(texts, lengths)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))

    def lengths(self) -> tuple[Lengths, Lengths]:
        """Ordinary content is in both, so that ordinary text is as long under either."""
        return Lengths(self.ordinary), Lengths(self.toxic + self.ordinary)


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """The two dictionaries, without a calibration.

    The ordinary one is trained on ORDINARY_WINDOWS windows at most, the toxic one on all."""
    data, spans, _ = window_segments(ordinary)
    windows = [data[int(a) : int(a + b)] for a, b in spans[:: max(1, len(spans) // ORDINARY_WINDOWS)]]
    return ToxicityModel(trained(windows, ORDINARY_BYTES), trained(toxic_samples(toxic, ordinary), TOXIC_BYTES), None)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_ordinary: int = FIT_ORDINARY
) -> ToxicityModel:
    """Dictionaries and calibration from labelled documents (``doc_id``, ``toxic``).

    A bounded number of documents of each class is read, those with the smallest hashes of
    their ids, so that the fit costs the same on any corpus (``fitted``). A document labelled twice is toxic if either label
    says so, and of an id that repeats the smallest text teaches; null labels and ids teach
    nothing. Without two labels of each class nothing is toxic: every score is 0. Without a
    signal in the labelled texts nothing is toxic either (see ``fitted``)."""
    spark = docs.sparkSession
    said = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("doc_id", F.lit(SEED))
    picked = []
    for toxic, wanted in ((1, fit_toxic), (0, fit_ordinary)):
        rows = said.where(F.col("toxic") == toxic).orderBy(place, "doc_id").limit(wanted)
        picked += [(r["doc_id"], toxic, n) for n, r in enumerate(rows.collect())]  # ``wanted`` rows
    if not picked:
        return ToxicityModel(b"", b"", None)
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int, place int"))  # bounded above
    # One text of each id, the smallest, where an id repeats: as many rows as were chosen at most.
    found = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic", "place")
    rows = found.agg(F.min("text").alias("text")).select("text", "toxic", "place").collect()
    rows.sort(key=lambda r: (r["toxic"], r["place"], r["text"] or ""))
    texts = {t: [r["text"] or "" for r in rows if r["toxic"] == t] for t in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return ToxicityModel(b"", b"", None)
    return fitted(texts[1], texts[0])


def fitted(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Dictionaries of all the texts, calibrated on texts that they were not trained on.

    Every fold is measured by dictionaries trained on the others: two folds where texts are
    many, ten where they are few, so that few labels still train on nine tenths of them. A
    logistic regression is fitted on these measures and its constant moved so that the score
    is one half where F1 is best. Where no threshold does better than calling every text
    toxic, the texts hold no signal: every score is then the share of toxic texts, under one
    half, and nothing is toxic."""
    few = len(toxic) < FEW_TOXIC
    folds = min(10, len(toxic), len(ordinary)) if few else 2
    x, y = [], []
    for fold_no in range(folds):
        model = train_dictionaries(*([t for n, t in enumerate(texts) if n % folds != fold_no] for texts in (toxic, ordinary)))
        lengths = model.lengths()
        for t, texts in ((0, ordinary), (1, toxic)):
            held = texts[fold_no::folds]
            x.append(model.features(held, lengths))
            y += [float(t)] * len(held)
    x, y = np.concatenate(x), np.array(y)
    model = train_dictionaries(toxic, ordinary)
    weights = logistic_fit(x, y)
    threshold = best_threshold(x @ weights[:-1] + weights[-1], y)
    if threshold is None:
        share = min(len(toxic) / (len(toxic) + len(ordinary)), 0.49)
        return ToxicityModel(model.ordinary, model.toxic, None, share)
    weights[-1] -= threshold
    return ToxicityModel(model.ordinary, model.toxic, weights)


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float | None:
    """Threshold with the best F1, half way between the two logits around it.

    None where no threshold that has a logit on either side is better than calling all toxic."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.flatnonzero(np.diff(logits[order]) < 0)
    if not len(ends) or f1[ends].max() <= f1[-1]:
        return None
    best = int(ends[f1[ends].argmax()])
    return float((logits[order[best]] + logits[order[best + 1]]) / 2)


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every whole text.

    Every window of the text is compressed under both dictionaries. Null and empty texts have
    no window and get the score of no difference. Repeated rows score alike; null ids stay
    null; other columns are ignored."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = model.lengths() if model.weights is not None else None
        for batch in batches:
            parts = (batch.column(1).slice(first, _ROWS) for first in range(0, len(batch), _ROWS))
            scores = np.concatenate([model.score(part.to_pylist(), lengths) for part in parts] or [np.zeros(0)])
            said = pa.array((scores >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), said], ["doc_id", "score", "predicted"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(score, "doc_id long, score double, predicted int")


def clean_documents(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Rows, with all their columns, whose text the model does not judge toxic."""
    names = docs.columns
    at = names.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = model.lengths() if model.weights is not None else None
        for batch in batches:
            for first in range(0, len(batch), _ROWS):
                part = batch.slice(first, _ROWS)
                yield part.filter(pa.array(model.score(part.column(at).to_pylist(), lengths) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def judge_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """Toxicity of every document, learnt from labels outside the held-out fold."""
    model = fit_toxicity(docs, labels.where(fold("doc_id", folds) != held_out))
    out = score_toxicity(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
