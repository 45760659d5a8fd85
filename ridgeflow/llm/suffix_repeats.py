"""Removal of long repeated byte strings: suffixes sorted bucket by bucket, ranks of a difference cover first."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeflow.llm.hashing import ragged, running_hash, slices, span_hash, text_buffer
from ridgeflow.session import cut_lineage

LENGTH = 400
#: Size parameter of the difference cover: 6r + 4 residues cover a period of 24r^2 + 36r + 13.
COVER = 2
#: Suffixes of a bucket, about, and buckets at least.
BUCKET_SUFFIXES, BUCKETS = 3_000_000, 24
#: Keys that may be broadcast to pick documents, 8 bytes each.
BROADCAST_KEYS = 1_000_000
#: Rows of a batch that a task holds: texts, and packed suffixes of some texts.
TEXT_ROWS, PACKED_ROWS = 1000, 256
_SLICE = 1 << 20

_SENT = "bucket int, keys binary, counts binary, tags binary"
_SAID = "key long, bucket int, mask binary"


def difference_cover(r: int = COVER) -> tuple[int, np.ndarray]:
    """Period v and residues such that any two places share a distance below v to residues.

    The residues are running sums of a published sequence of steps (Colbourn and Ling)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *steps])


class Cover:
    """The cover for strings of one length: sampled places and the length ranked at them.

    Strings of ``length`` bytes at p and q are equal only if the ``rank_length`` bytes are at
    p + d and q + d, for the distance d below the period at which both are sampled."""

    def __init__(self, length: int, r: int = COVER):
        while r > 0 and difference_cover(r)[0] > length // 2:
            r -= 1
        self.length = length
        self.period, self.residues = difference_cover(r) if r > 0 else (1, np.zeros(1, np.int64))
        self.rank_length = length - self.period + 1

    def places(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places of texts of given sizes: the text and the place of each."""
        most = int(sizes.max(initial=0))
        turns = np.arange(0, most + self.period, self.period)
        every = (turns[:, None] + self.residues[None, :]).ravel()
        counts = np.searchsorted(every, sizes - self.rank_length, side="right")
        return np.repeat(np.arange(len(sizes)), counts), every[ragged(np.zeros(len(sizes), np.int64), counts)]


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)).astype(np.int64) * buckets) >> 24


def _packed(keys: np.ndarray, owner: np.ndarray, hashes: np.ndarray, buckets: int, kind: str) -> pa.RecordBatch:
    """One row per bucket: the texts that send, how many suffixes each, and their tags in order."""
    bucket = _bucket_of(hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    tags = (hashes[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32) if kind == "uint32" else hashes[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(bucket))
    rows = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        runs = np.flatnonzero(np.append(True, owner[a + 1 : b] != owner[a : b - 1]))
        counts = np.diff(np.append(runs, b - a)).astype(np.uint32)
        rows.append((int(bucket[a]), keys[owner[a + runs]].tobytes(), counts.tobytes(), tags[a:b].tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ["bucket", "keys", "counts", "tags"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


class _Seen:
    """Different tags so far and which of them came more than once: all that a bucket keeps."""

    def __init__(self, kind: str):
        self.tags, self.twice = np.zeros(0, kind), np.zeros(0, bool)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, tags: np.ndarray) -> None:
        self.waiting.append(tags)
        self.size += len(tags)
        if self.size > max(500_000, len(self.tags) // 2):
            self.settle()

    def settle(self) -> None:
        tags = np.concatenate([self.tags, *self.waiting])
        twice = np.concatenate([self.twice, np.zeros(self.size, bool)])
        order = np.argsort(tags, kind="stable")
        tags, twice = tags[order], twice[order]
        first = np.append(True, tags[1:] != tags[:-1]) if len(tags) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(tags)))
        self.tags, self.twice = tags[at], (count > 1) | (np.logical_or.reduceat(twice, at) if len(at) else twice)
        self.waiting, self.size = [], 0

    def repeated(self, tags: np.ndarray) -> np.ndarray:
        return self.twice[np.searchsorted(self.tags, tags)]


def _sort_buckets(kind: str):
    """Sorts one bucket at a time and tells every text which of its suffixes have an equal.

    A bucket is read as a stream. Its rows wait in a file of the task, so that memory holds
    different tags only, however often one of them comes."""

    def answers(spool, seen: _Seen, bucket: int) -> Iterator[pa.RecordBatch]:
        seen.settle()
        spool.seek(0)
        while head := spool.read(24):
            sizes = np.frombuffer(head, np.int64)
            keys = np.frombuffer(spool.read(int(sizes[0])), np.int64)
            counts = np.frombuffer(spool.read(int(sizes[1])), np.uint32).astype(np.int64)
            found = seen.repeated(np.frombuffer(spool.read(int(sizes[2])), kind))
            starts = np.cumsum(counts) - counts
            some = np.flatnonzero(np.add.reduceat(found, starts) > 0) if len(starts) else starts
            masks = [np.packbits(found[starts[i] : starts[i] + counts[i]]).tobytes() for i in some.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[some], pa.int64()), pa.array(np.full(len(some), bucket), pa.int32()), pa.array(masks, pa.binary())],
                ["key", "bucket", "mask"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, spool = None, None, None
        for batch in batches:
            for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if spool is not None:
                        yield from answers(spool, seen, now)
                        spool.close()
                    now, seen, spool = bucket, _Seen(kind), tempfile.TemporaryFile()  # noqa: SIM115
                seen.add(np.frombuffer(parts[2], kind))
                spool.write(np.array([len(p) for p in parts], np.int64).tobytes())
                for p in parts:
                    spool.write(p)
        if spool is not None:
            yield from answers(spool, seen, now)
            spool.close()

    return run


def _written(rows: DataFrame, batch: int) -> DataFrame:
    """A table cut from its lineage, made with batches of so many rows."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = rows.sparkSession.conf
    before = conf.get(setting)
    conf.set(setting, str(batch))
    try:
        return cut_lineage(rows)
    finally:
        conf.set(setting, before)


def _answered(sent: DataFrame, buckets: int, kind: str) -> DataFrame:
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return _written(dealt.mapInArrow(_sort_buckets(kind), _SAID), PACKED_ROWS)


def _marked(owner: np.ndarray, hashes: np.ndarray, buckets: int, answers: list[list[dict]]) -> np.ndarray:
    """Reads the answers to each text back onto its suffixes, in the order they were sent."""
    bucket = _bucket_of(hashes, buckets)
    order = np.lexsort((bucket, owner))
    groups = owner[order] * buckets + bucket[order]
    out = np.zeros(len(owner), bool)
    for n, own in enumerate(answers):
        for said in own:
            a, b = np.searchsorted(groups, [n * buckets + said["bucket"], n * buckets + said["bucket"] + 1])
            out[order[a:b]] |= np.unpackbits(np.frombuffer(said["mask"], np.uint8), count=b - a).astype(bool)
    return out


class _Slice:
    """Some whole texts side by side, with the hashes of their sampled places."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cover: Cover):
        self.sums, self.offsets, self.cover = running_hash(data), offsets, cover
        self.sizes = np.diff(offsets)
        self.owner, self.place = cover.places(self.sizes)
        start = offsets[self.owner] + self.place
        self.ranks = span_hash(self.sums, start, start + cover.rank_length)

    def candidates(self, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that may have an equal: those with a repeated rank below the period."""
        owner, place = self.owner[ranked], self.place[ranked]
        edge = np.zeros(int(self.offsets[-1]) + 1, np.int64)
        first = self.offsets[owner] + np.maximum(place - self.cover.period + 1, 0)
        last = self.offsets[owner] + np.minimum(place, self.sizes[owner] - self.cover.length)
        some = last >= first
        np.add.at(edge, first[some], 1)
        np.add.at(edge, last[some] + 1, -1)
        start = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        hashes = span_hash(self.sums, start, start + self.cover.length)
        return np.searchsorted(self.offsets, start, side="right") - 1, start, hashes


def _texts(batch: pa.RecordBatch, column: int, cover: Cover) -> Iterator[tuple[int, int, np.ndarray, _Slice]]:
    data, offsets = text_buffer(batch.column(column))
    for first, last in slices(offsets, _SLICE):
        piece = data[offsets[first] : offsets[last]]
        yield first, last, piece, _Slice(piece, offsets[first : last + 1] - offsets[first], cover)


def repeated_strings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, bucket_suffixes: int = BUCKET_SUFFIXES
) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts elsewhere.

    Returns one row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept_sha256``, the digest of the bytes that stay.

    Suffixes are compared to a depth of ``length`` bytes, blockwise. First the places of a
    difference cover are ranked: the suffixes there, to the length that any two equal strings
    must share at a common distance, are sorted bucket by bucket, and each text learns which
    of its ranks repeat. Only suffixes with a repeated rank within a period can tie with
    another to the full depth; these, and no others, are sorted in a second pass, again one
    bucket (a range of keys) at a time. Equal strings are equal keys: 64-bit hashes of the
    whole depth stand for the bytes, so nothing is ever compared byte by byte for long ties.
    Memory per task is the different keys of one bucket; buckets grow in number with the
    text. Text moves only for documents that hold a repeat.

    Rows with the same text are copies: all of it repeats, if it is long enough, and one of
    them stands for all in the second pass. Null and empty texts have no bytes. Matches never
    cross documents; overlapping matches inside one document count. Repeated ids are told
    apart by their texts; other columns are ignored."""
    plain = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(
        F.col(doc_id).alias("doc_id"), plain.alias("text"), F.xxhash64(F.col(doc_id), plain).alias("key")
    )
    info = cut_lineage(
        given.select(
            "doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")
        )
    )
    cover = Cover(length)
    total = info.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, int(total * len(cover.residues) / cover.period / bucket_suffixes))
    groups = info.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("copies"), F.min("key").alias("stands"))
    groups = cut_lineage(groups.where("copies > 1"))

    def send_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, last, _, own in _texts(batch, 1, cover):
                yield _packed(keys[first:last], own.owner, own.ranks, buckets, "uint32")

    # One of each group of copies stands for all. The others stay out of the first pass too
    # where they are few enough to say so to every task; the result is the same.
    copied = cut_lineage(info.select("key", "sha").join(groups, "sha").where("key <> stands").select("key").distinct())
    single = given.select("key", "text")
    if copied.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        single = single.join(F.broadcast(copied), "key", "left_anti")
    ranks = _answered(single.mapInArrow(send_ranks, _SENT), buckets, "uint32")
    by_key = cut_lineage(
        ranks.groupBy("key").agg(F.collect_list(F.struct("bucket", "mask")).alias("ranks")).join(copied, "key", "left_anti")
    )

    def texts_with(answers: DataFrame) -> DataFrame:
        """Texts of given keys; the keys are broadcast only where they are few."""
        keys = answers.select("key")
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        own = given.select("key", "text")
        own = own.join(F.broadcast(keys), "key", "left_semi") if few else own
        return own.join(answers, "key")

    def send_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, said = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for first, last, _, own in _texts(batch, 1, cover):
                ranked = _marked(own.owner, own.ranks, buckets, said[first:last])
                owner, _, hashes = own.candidates(ranked)
                yield _packed(keys[first:last], owner, hashes, buckets, "uint64")

    sent = texts_with(by_key).select("key", "text", "ranks").mapInArrow(send_suffixes, _SENT)
    suffixes = _answered(sent, buckets, "uint64")
    both = cut_lineage(
        by_key.join(suffixes.groupBy("key").agg(F.collect_list(F.struct("bucket", "mask")).alias("suffixes")), "key")
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ranks, said = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for first, last, data, own in _texts(batch, 1, cover):
                owner, start, hashes = own.candidates(_marked(own.owner, own.ranks, buckets, ranks[first:last]))
                start = start[_marked(owner, hashes, buckets, said[first:last])]
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                for a, b in zip(own.offsets[:-1].tolist(), own.offsets[1:].tolist(), strict=True):
                    out = gone[a:b]
                    spans = int(np.count_nonzero(out[1:] & ~out[:-1])) + int(out[:1].sum())
                    rows.append((int(out.sum()), spans, hashlib.sha256(data[a:b][~out].tobytes()).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([keys, *arrays], ["key", "removed", "spans", "kept"])

    removed = texts_with(both).select("key", "text", "ranks", "suffixes")
    removed = removed.mapInArrow(remove, "key long, removed long, spans long, kept string").dropDuplicates(["key"])
    whole = F.col("copies").isNotNull()
    return (
        info.join(groups.select("sha", "copies"), "sha", "left")
        .join(_written(removed, TEXT_ROWS), "key", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )
    )
