"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeflow.llm.feistel import permuted
from ridgeflow.llm.hashing import ragged
from ridgeflow.llm.prefix import running_before, spread
from ridgeflow.llm.rows import numbered
from ridgeflow.session import cut_lineage

#: Relative weights of the sources in the order of their names, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: The mix holds this multiple of all words; no source is taken more often than LIMIT times.
SHARE, LIMIT = 1.5, 2.0
#: Words of a block: a source comes this near to its target.
BLOCK_WORDS = 16
SHARDS = 16
SEED = 20_17
#: Texts that a task turns into strings at a time.
_ROWS = 500
_WORD = re.compile("[^\\x20\\x09-\\x0d]+")


def word_count(text: str):
    """Runs of characters other than blanks (space, tab to carriage return); null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """Target words of each source: shares by weight, capped at ``limit`` times its size.

    The excess over the caps is shared again by weight until no source is above its cap: the
    targets are min(limit * size, weight * level) for one level. Sources are sorted by the
    level at which they reach their cap; running sums of caps and weights then give the
    level at once. Works on one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    choices = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sources.withColumn("weight", F.element_at(choices, (place + 1).cast("int")))
    full = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy("_at", F.col("source").isNull(), "source")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(limit)
    ranked = ranked.withColumn("_cap", cap).withColumn("_at", F.col("_cap") / F.col("weight"))
    levels = ranked.withColumn(
        "_level",
        (F.sum("source_size").over(full) * F.lit(share) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        / (F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))),
    )
    # The first source, in this order, whose cap lies above the level that is left.
    level = F.min(F.when(F.col("_at") >= F.col("_level"), F.struct("_at", "_level"))).over(full)["_level"]
    return levels.withColumn("_l", level).select(
        "source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("weight") * F.col("_l"), F.col("_cap"))).alias("target")
    )


def sainte_lague(targets: list[float], blocks: int, most: list[int]) -> list[int]:
    """Blocks of each source by highest quotients target / (2k + 1), ``most`` at most.

    The highest ``blocks`` quotients are found by their cut value instead of one by one: a
    source holds round(target / (2 * cut)) of the quotients above a cut."""
    t, most = np.asarray(targets, float), np.asarray(most, np.int64)
    blocks = int(min(blocks, most[t > 0].sum())) if len(t) else 0
    if blocks <= 0:
        return [0] * len(t)

    def above(cut: float) -> np.ndarray:
        return np.minimum(np.floor(t / (2 * cut) + 0.5), most).astype(np.int64)

    low, high = 0.0, float(t.max()) * 2 + 1
    for _ in range(200):
        middle = (low + high) / 2 if low else high / 2
        if above(middle).sum() > blocks:
            low = middle
        else:
            high = middle
        if low and high - low <= low * 1e-15:
            break
    got = above(high)
    while got.sum() < blocks:  # ties at the cut: one more by quotient, then by place
        quotient = np.where(got < most, t / (2 * got + 1), -1.0)
        got[int(quotient.argmax())] += 1
    return got.tolist()


def block_quotas(sources: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """Adds to each source its blocks and its quota of blocks in each shard of the mix.

    Row work on one row per source (``source``, ``source_size``, ``target``): the number of
    sources, not the corpus, bounds it. The blocks of all shards up to the k-th are
    apportioned together, so that quotas of shards add up to the quotas of the mix."""

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("source", na_position="last", kind="stable").reset_index(drop=True)
        blocks = -(-group["source_size"].to_numpy(np.int64) // block_words)
        # Blocks are equal but for the last one; a source of one short block counts its words.
        words = group["source_size"].to_numpy() / np.maximum(blocks, 1)
        wanted = np.where(blocks > 0, group["target"].to_numpy() / np.maximum(words, 1e-9), 0.0)
        total = int(round(wanted.sum()))
        so_far = [
            sainte_lague(wanted.tolist(), total * (k + 1) // shards, (2 * blocks).tolist()) for k in range(shards)
        ]
        quotas = np.diff(np.vstack([np.zeros(len(group), np.int64), np.array(so_far)]), axis=0)
        return group.assign(blocks=blocks, quotas=list(quotas.T))

    return sources.groupBy(F.lit("all")).applyInPandas(
        split, "source string, source_size long, target double, blocks long, quotas array<long>"
    )


def _times(block: np.ndarray, blocks: np.ndarray, quota: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each block is taken: all blocks equally often, the rest by seeded order."""
    whole, rest = quota // np.maximum(blocks, 1), quota % np.maximum(blocks, 1)
    return whole + (permuted(block, np.maximum(blocks, 1), key) < rest)


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
    row: str | None = None,
) -> DataFrame:
    """How much of each document a mix of the sources to their target weights takes.

    Returns one row per input row: ``doc_id``, ``source``, ``size`` (words),
    ``source_size``, ``target``, ``taken`` (words, repeats counted), ``start`` (words of its
    source before it), ``blocks`` and ``quota`` of its source, ``quotas`` by shard, and the
    ``key`` and ``block_words`` that pick the blocks; with ``row``, a column that numbers the
    rows, also that column. Rows of one id and size are then ordered by text and number.

    The words of a source, its documents in seeded order, are cut into equal blocks (the last
    may be shorter). Highest quotients give every source an
    integer quota of blocks in each shard; a keyed permutation of the blocks then picks which
    blocks make up the quota, at most twice each. A document takes what the picked blocks
    hold of it, so never more than twice its size.

    Null texts have no words, a null source is a source of its own (the last), repeated rows
    count as often as they stand there, and rows without words take nothing. Reruns agree on
    any partitioning. A source is never sorted as a whole, however large."""
    sized = cut_lineage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(text).alias("size"),
            F.xxhash64(F.col(doc_id), F.lit(seed)).alias("_place"),
            *([] if row is None else [F.xxhash64(F.col(text)).alias("_text"), F.col(row)]),
        )
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    quotas = cut_lineage(block_quotas(source_targets(totals), block_words, shards))
    tie = ["doc_id", "size", *([] if row is None else ["_text", row])]
    placed = running_before(sized, ["source"], "_place", tie, "size", "start", spread(sized.count()))
    # Sources may be many: no hint, the planner sees the size of the written table.
    named = quotas.withColumnRenamed("source", "_source")
    joined = placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_place", "_text")
    quota = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
    joined = joined.withColumn("quota", quota).withColumn("block_words", F.lit(block_words))
    joined = joined.withColumn("key", F.xxhash64(F.col("source"), F.lit(seed + 1)))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(taken=_taken(batch))

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema]
    return joined.mapInPandas(take, ", ".join([*fields, "taken long"]))


def block_spans(batch: pd.DataFrame) -> pd.DataFrame:
    """Blocks that each row of ``mix_sources`` meets: row, first and last word, times taken."""
    size = batch["size"].to_numpy(np.int64)
    start = batch["start"].to_numpy(np.int64)
    blocks = batch["blocks"].to_numpy(np.int64)
    words = int(batch["block_words"].iloc[0]) if len(batch) else 1
    first = start // words
    count = np.where(size > 0, (start + size - 1) // words - first + 1, 0)
    row = np.repeat(np.arange(len(batch)), count)
    block = ragged(first, count)
    low = np.maximum(block * words, start[row])
    high = np.minimum((block + 1) * words, start[row] + size[row])
    times = _times(block, blocks[row], batch["quota"].to_numpy(np.int64)[row], batch["key"].to_numpy(np.int64).view(np.uint64)[row])
    return pd.DataFrame({"row": row, "low": low - start[row], "high": high - start[row], "times": times})


def _taken(batch: pd.DataFrame) -> np.ndarray:
    spans = block_spans(batch)
    words = ((spans["high"] - spans["low"]) * spans["times"]).to_numpy()
    out = np.zeros(len(batch), np.int64)
    np.add.at(out, spans["row"].to_numpy(), words)
    return out


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: rows like those of ``docs`` with the words that are taken.

    A document whose words are all taken in a pass stays as it is in that pass; of one that is
    taken in part, the taken runs of words are joined by blanks. Documents taken twice are two
    rows. Every row has its own words taken, also where an id repeats. ``n_chars``, if there, follows the text. Documents without words are not taken."""
    given = numbered(docs, "__mix_row")
    mix = mix_sources(given, text=text, row="__mix_row", **options)
    spans = ["start", "size", "source_size", "blocks", "quota", "block_words", "key"]
    picked = mix.where("taken > 0").select("__mix_row", *(F.col(c).alias(f"__mix_{c}") for c in spans))
    joined = given.join(picked, "__mix_row")
    names, has_chars = docs.columns, "n_chars" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(first, _ROWS) for b in batches for first in range(0, len(b), _ROWS))
        for given in parts:
            shape, batch = given.select(names).schema, given.to_pandas()
            named = pd.DataFrame({c: batch[f"__mix_{c}"] for c in spans})
            blocks = block_spans(named)
            for turn in (1, 2):
                taken = blocks[blocks["times"] >= turn]
                words = (taken["high"] - taken["low"]).groupby(taken["row"]).sum()
                rows = words.index.to_numpy()
                out = batch.iloc[rows][names].copy()
                part = np.flatnonzero(words.to_numpy() < batch["__mix_size"].to_numpy()[rows])
                if len(part):
                    texts = out[text].tolist()
                    by_row = dict(tuple(taken.groupby("row")))
                    for i in part:
                        own = by_row[rows[i]]
                        found = _WORD.findall(texts[i])
                        texts[i] = " ".join(w for a, b in zip(own["low"], own["high"], strict=True) for w in found[a:b])
                    out[text] = texts
                    if has_chars:
                        out["n_chars"] = [len(t) for t in texts]
                yield pa.RecordBatch.from_pandas(out, shape, preserve_index=False)

    return joined.mapInArrow(cut, docs.schema)
