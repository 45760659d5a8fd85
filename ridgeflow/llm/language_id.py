"""Language identification: sparse multinomial regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.llm.hashing import mixed
from ridgeflow.session import cut_lineage

#: Longest n-gram, and the slots that n-grams are hashed to.
ORDER, SLOTS = 3, 1 << 15
#: Documents the regression is fitted on, about; parts trained side by side; rounds.
FIT_ROWS, PARTS, ROUNDS = 6000, 8, 3
#: Per-coordinate rate and its offset, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
SEED = 10
UNKNOWN = "und"
#: Code points worked on at a time.
_PIECE = 1 << 21

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the character n-grams of a whole text; none without letters.

    Texts are lower-cased; what is no letter counts as a blank, and an n-gram of blanks
    alone is none."""
    total = np.zeros(SLOTS, np.int64)
    if text:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letter_table()[codes]
        if letter.any():
            for first in range(0, len(codes), _PIECE):  # long texts in pieces that overlap
                end = min(first + _PIECE + ORDER - 1, len(codes))
                own = min(first + _PIECE, len(codes)) - first
                plain = np.where(letter[first:end], codes[first:end], 32).astype(np.uint64)
                some = letter[first:end]
                gram, any_letter = plain, some
                for n in range(1, ORDER + 1):
                    if n > 1:
                        gram = (gram[:-1] << np.uint64(21)) | plain[n - 1 :]
                        any_letter = any_letter[:-1] | some[n - 1 :]
                    picked = mixed(gram[:own][any_letter[:own]], n) & np.uint64(SLOTS - 1)
                    total += np.bincount(picked.astype(np.int64), minlength=SLOTS)
    slots = np.flatnonzero(total)
    return slots, total[slots]


def tf_idf(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF weights of unit length, with a constant at the slot after the last."""
    weights = (1 + np.log(np.maximum(counts, 1))) * idf[slots]
    size = float(np.sqrt((weights**2).sum())) or 1.0
    return np.append(slots, SLOTS), np.append(weights / size, 0.1)


class Ftrl:
    """Follow-the-regularised-leader for a multinomial regression with an elastic net."""

    def __init__(self, classes: int, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros((classes, SLOTS + 1)) if z is None else z.copy()
        self.n = np.zeros((classes, SLOTS + 1)) if n is None else n.copy()

    def weights(self, slots: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[:, slots], self.n[:, slots]
        rest = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -rest / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        chance = softmax(w @ values)
        chance[label] -= 1.0
        gradient = np.outer(chance, values)
        grown = self.n[:, slots] + gradient**2
        rate = (np.sqrt(grown) - np.sqrt(self.n[:, slots])) / ALPHA
        self.z[:, slots] += gradient - rate * w
        self.n[:, slots] = grown


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the least log loss on rows that were not fitted, by golden section."""
    if not len(labels):
        return 1.0
    at = np.arange(len(labels))

    def loss(log_t: float) -> float:
        return -float(np.log(np.maximum(softmax(logits / np.exp(log_t))[at, labels], 1e-12)).mean())

    low, high, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class LanguageModel:
    """Languages, IDF by slot, weights by language and slot, and the temperature."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        slots, counts = gram_counts(text)
        if not len(slots) or not self.languages:
            return UNKNOWN, 0.0
        at, values = tf_idf(slots, counts, self.idf)
        chance = softmax(self.weights[:, at] @ values / self.temperature)
        best = int(chance.argmax())
        return self.languages[best], float(chance[best])


def gram_idf(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequency of each slot over all given documents.

    A task counts what it reads; one row per slot and task meets in a sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                slots, _ = gram_counts(text.as_py())
                seen[slots] += 1
                seen[SLOTS] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["slot", "docs"])

    rows = docs.select(text).mapInArrow(count, "slot int, docs long").groupBy("slot").agg(F.sum("docs").alias("docs"))
    held = np.zeros(SLOTS + 1)
    for r in rows.collect():  # SLOTS + 1 rows at most
        held[r["slot"]] = r["docs"]
    return np.log((1 + held[SLOTS]) / (1 + held[:SLOTS])) + 1.0


def fit_language_model(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    fit_rows: int = FIT_ROWS,
    parts: int = PARTS,
    rounds: int = ROUNDS,
) -> LanguageModel:
    """Fits on labelled documents: rows whose language is null teach nothing.

    IDF comes from all of them. The regression is fitted on about ``fit_rows`` documents,
    equally many of each language, picked by a hash of the id, so that its cost does not grow
    with the corpus. ``parts`` learners work side by side in each round and are averaged; a
    fifth of the picked documents is kept back for the temperature."""
    known = docs.where(F.col(lang).isNotNull())
    sizes = {r[lang]: r["count"] for r in known.groupBy(lang).count().collect()}  # one row per language
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.ones(SLOTS), np.zeros((0, SLOTS + 1)), 1.0)
    idf = gram_idf(known, text)
    chance = {name: min(1.0, fit_rows / len(languages) / n) for name, n in sizes.items()}
    wanted = F.create_map(*(F.lit(x) for pair in chance.items() for x in pair))[F.col(lang)]
    place = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(SEED)), F.lit(1 << 30))
    code = {name: n for n, name in enumerate(languages)}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for place, label, own in zip(batch["place"], batch["lang"], batch["text"], strict=True):
                slots, counts = gram_counts(own)
                if len(slots):
                    at, values = tf_idf(slots, counts, idf)
                    rows.append((place, code[label], at.astype(np.int32).tobytes(), values.tobytes()))
            yield pd.DataFrame(rows, columns=["place", "label", "slots", "values"])

    picked = known.select(place.alias("place"), F.col(lang).alias("lang"), F.col(text).alias("text"), wanted.alias("w"))
    picked = picked.where(F.col("place") < F.col("w") * F.lit(1 << 30)).drop("w")
    ready = cut_lineage(picked.mapInPandas(features, "place long, label int, slots binary, values binary"))
    kept = ready.where("place % 5 = 0")
    fitted = ready.where("place % 5 <> 0").withColumn("part", F.pmod(F.col("place"), F.lit(parts * 7)) % parts)
    state = Ftrl(len(languages))

    def trainer(z: np.ndarray, n: np.ndarray, turn: int):
        def train(rows: pd.DataFrame) -> pd.DataFrame:
            learner = Ftrl(len(languages), z, n)
            order = mixed(rows["place"].to_numpy(np.int64).view(np.uint64), turn).argsort(kind="stable")
            for i in order:
                at = np.frombuffer(rows["slots"].iloc[i], np.int32)
                learner.learn(at, np.frombuffer(rows["values"].iloc[i]), int(rows["label"].iloc[i]))
            return pd.DataFrame({"z": [learner.z.tobytes()], "n": [learner.n.tobytes()]})

        return train

    for turn in range(rounds):
        train = trainer(state.z, state.n, turn)
        got = fitted.groupBy("part").applyInPandas(train, "z binary, n binary").collect()  # ``parts`` rows
        if got:
            shape = state.z.shape
            state.z = np.mean([np.frombuffer(r["z"]).reshape(shape) for r in got], axis=0)
            state.n = np.mean([np.frombuffer(r["n"]).reshape(shape) for r in got], axis=0)
    weights = state.weights(slice(None))

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (weights[:, np.frombuffer(s, np.int32)] @ np.frombuffer(v)).tolist()
                for s, v in zip(batch["slots"], batch["values"], strict=True)
            ]
            yield pd.DataFrame({"label": batch["label"], "logits": out})

    rows = kept.mapInPandas(logits, "label int, logits array<double>").collect()  # a fifth of fit_rows
    t = temperature(np.array([r["logits"] for r in rows]), np.array([r["label"] for r in rows], int)) if rows else 1.0
    return LanguageModel(languages, idf, weights, t)


def predict_languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language and calibrated chance of every whole text.

    Null texts and texts without a letter are ``und`` with a score of 0. Repeated rows are
    predicted alike; null ids stay null; other columns are ignored."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s[0] for s in said], pa.string()),
                    pa.array([s[1] for s in said], pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def fold(doc_id: str, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def identify_languages(docs: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """Language of every document, learnt from the folds other than ``held_out``.

    A null id belongs to no held-out fold but teaches nothing either."""
    given = docs.withColumn("_fold", fold("doc_id", folds))
    model = fit_language_model(given.where(F.col("_fold") != held_out))
    out = predict_languages(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
