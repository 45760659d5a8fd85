"""Training-order shards: a keyed permutation deals fixed-stride sequences to global slots."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeflow.llm.feistel import permuted
from ridgeflow.llm.prefix import running_before, spread
from ridgeflow.llm.tokens import public_path, small_batches, word_tokens
from ridgeflow.session import cut_lineage, shared_folder

TOKENIZER = "word_bpe_49k.json"
END_ID, PAD_ID = 49407, 49407
#: Ids of a sequence (its stride is twice as many bytes) and sequences of a shard.
SEQUENCE, SHARD = 512, 4096
KEY = 0x5EED

#: Documents whose first slot may be broadcast, 32 bytes each.
BROADCAST_DOCUMENTS = 1_000_000

_CUT = "doc_id long, part int, tokens int, ids binary, ids_crc32 long, index long"
_PLACED = "doc_id long, part int, tokens int, slot long, shard long, place int, ids_crc32 long"


def _token_counts(given: DataFrame, tokenizer: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(public_path(tokenizer))
        for batch in small_batches(batches):
            _, ends = words(batch.column(2))
            sizes = pa.array(np.diff(ends) + 1, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], ["k1", "k2", "tokens"])

    return given.select("k1", "k2", "text").mapInArrow(count, "k1 long, k2 long, tokens long")


def _cut_sequences(placed: DataFrame, tokenizer: str, sequence: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(public_path(tokenizer))
        for batch in small_batches(batches):
            ids, ends = words(batch.column(1))
            keys, firsts, copies = (batch.column(c).to_pylist() for c in (0, 2, 3))
            rows: list[tuple] = []
            for key, first, times, a, b in zip(keys, firsts, copies, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u2")
                for copy in range(times):
                    for n, at in enumerate(range(0, len(own), sequence)):
                        raw = own[at : at + sequence].tobytes()
                        rows.append((key, n, len(raw) // 2, raw, zlib.crc32(raw), first))
                        first += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            names = ["doc_id", "part", "tokens", "ids", "ids_crc32", "index"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return placed.select("doc_id", "text", "first", "copies").mapInArrow(cut, _CUT)


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def shard_name(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def write_shards(
    docs: DataFrame,
    folder: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    sequence: int = SEQUENCE,
    shard: int = SHARD,
    key: int = KEY,
) -> DataFrame:
    """Writes all texts as token ids in training order; returns where every sequence went.

    Each text, tokenised and closed by the end id, is cut into sequences of ``sequence`` ids,
    the last one padded. Sequences are numbered 0..N-1 in the order of a hash of their
    documents; a keyed Feistel permutation of [0, N), walked along its cycles, gives each its
    global slot. A range of ``shard`` slots is one file: little-endian 16-bit ids, every
    sequence ``2 * sequence`` bytes, so that slot s lies at a known byte of a known file and a
    reader can resume anywhere. ``manifest.json`` holds the sizes and the key.

    Returns ``doc_id``, ``part``, ``tokens`` (without padding), ``slot``, ``shard``, ``place``
    (in the shard) and ``ids_crc32`` of the ids. A file is written under another name and
    moved when whole: a task that runs twice, or a job started again into the same folder
    for the same rows, however partitioned, leaves the same bytes. A file that stands there with
    other bytes, of another corpus, key or tokenizer, is written again. The folder defaults to a
    new one in the shared folder of the cluster.

    Null and empty texts are one sequence with the end id alone. Repeated rows are written as
    often as they stand there; null ids stay null; an empty table writes a manifest only."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = given.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id", F.lit(key))})
    # A first pass counts: the permutation needs the number of all sequences.
    counted = _token_counts(given, tokenizer).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.max("tokens").alias("tokens"))
    parts = F.ceil(F.col("tokens") / F.lit(sequence)).cast("long")
    counted = cut_lineage(counted.withColumn("slots", parts * F.col("copies")))
    sums = counted.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0)), F.max("copies")).first()
    total = sums[1]
    firsts = running_before(counted.withColumn("all", F.lit(0)), ["all"], "k1", ["k2"], "slots", "first", spread(sums[0]))
    firsts = cut_lineage(firsts.select("k1", "k2", "first", "copies"))
    few = F.broadcast if sums[0] <= BROADCAST_DOCUMENTS else (lambda rows: rows)
    placed = given.join(few(firsts.where("copies = 1")), ["k1", "k2"])
    if (sums[2] or 1) > 1:  # rows that repeat: one of them writes all their copies
        again = firsts.where("copies > 1")
        placed = placed.unionByName(given.join(few(again), ["k1", "k2"]).dropDuplicates(["k1", "k2"]))
    files, base = _opened(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"sequences": total, "sequence": sequence, "shard": shard, "key": key, "pad": PAD_ID}).encode())

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(np.int64), max(total, 1), key))

    slotted = (
        _cut_sequences(placed, tokenizer, sequence)
        .withColumn("slot", slot_of(F.col("index")))
        .withColumn("shard", F.floor(F.col("slot") / F.lit(shard)).cast("long"))
        .drop("index")
    )

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["shard"].iloc[0])
        rows = rows.sort_values("slot", kind="stable")
        rows["place"] = (rows["slot"] - number * shard).astype("int32")
        files, base = _opened(folder)
        name = f"{base}/{shard_name(number)}"
        body = np.full((len(rows), sequence), PAD_ID, "<u2")
        for n, raw in enumerate(rows["ids"]):
            body[n, : len(raw) // 2] = np.frombuffer(raw, "<u2")
        known = files.get_file_info(name)
        same = known.type == fs.FileType.File and known.size == body.nbytes
        if same:  # a task that runs again, or another corpus, key or tokenizer: its bytes tell
            with files.open_input_stream(name) as there:
                same = there.read() == body.tobytes()
        if not same:
            part = f"{name}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(part) as out:
                out.write(body.data)
            files.move(part, name)
        return rows[["doc_id", "part", "tokens", "slot", "shard", "place", "ids_crc32"]]

    return slotted.groupBy("shard").applyInPandas(write, _PLACED)


def read_slots(folder: str, first: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Sequences of consecutive slots, in order, from any slot on."""
    files, base = _opened(folder)
    with files.open_input_stream(f"{base}/manifest.json") as given:
        sizes = json.loads(given.read())
    last = sizes["sequences"] if count is None else min(first + count, sizes["sequences"])
    stride = 2 * sizes["sequence"]
    while first < last:
        number, place = divmod(first, sizes["shard"])
        upto = min(last, (number + 1) * sizes["shard"])
        with files.open_input_file(f"{base}/{shard_name(number)}") as given:
            given.seek(place * stride)
            body = np.frombuffer(given.read((upto - first) * stride), "<u2")
        yield from body.reshape(-1, sizes["sequence"])
        first = upto

