"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.session import cut_lineage

#: Entries of different texts that one bucket of the index holds at most.
BUCKET_ENTRIES = 50_000
#: Keys of repeated texts that may be broadcast: 16 bytes each.
BROADCAST_KEYS = 1_000_000
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: str) -> Column:
    """A text without blanks; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), _BLANKS, "")


def index_entries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One entry per row: key, digest, id, code points and the number of the entry (``row``).

    Written to the shared folder: these files are the index that later steps read, so that
    the numbers of the entries stay when an executor is lost."""
    plain = normalised(text)
    return cut_lineage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.xxhash64(plain).alias("key"),
            F.sha2(plain.cast("binary"), 256).alias("text_sha256"),
            F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long").alias("chars"),
            (F.monotonically_increasing_id() if row is None else F.col(row)).alias("entry"),
        )
    )


def directory_depth(keys: DataFrame, capacity: int = BUCKET_ENTRIES) -> int:
    """Doubles the directory until no bucket of different keys is overfull.

    A slot of the directory is a prefix of the key. Equal keys are one entry here: a
    chain, which no doubling can split. Only the size of the fullest slot reaches the
    driver, once per doubling."""
    keys = keys.select("key")
    total = keys.count()
    depth = max(0, (max(total, 1) // capacity).bit_length())
    while depth < 30:
        slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
        fullest = keys.groupBy(slot.alias("slot")).count().agg(F.max("count")).first()[0] or 0
        if fullest <= capacity:
            break
        depth += 1
    return depth


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = BUCKET_ENTRIES,
    broadcast_keys: int = BROADCAST_KEYS,
    row: str | None = None,
) -> DataFrame:
    """Groups of texts that are equal once blanks (space, tab to carriage return) are gone.

    Returns one row per input row: ``doc_id``, ``keep_id`` (the row with most code points in
    its original text, then the smallest id), ``group_size``, ``kept`` and ``text_sha256``;
    with ``row``, a column that numbers the rows, also that column.

    Steps: entries (key, digest, id) go to shared files; the directory of the extendible
    hash is doubled until no bucket is overfull; a bucket is the key range one owner task
    works on. Keys that repeat are chains: the texts behind them are read again and compared
    byte by byte, by grouping on key and whole text; equal texts meet as one row per task,
    so a group of any size is pre-aggregated before the shuffle. The entries of a hot key
    meet their group in a join whose skewed partitions are split at run time.

    Null texts are equal to empty ones. Null ids sort after all others and are kept only in
    a group without ids. Of rows that repeat an id and a text, one is kept. An empty table
    gives an empty result; other columns are ignored. Rows that are not grouped never move
    with their text."""
    entries = index_entries(docs, doc_id, text, row)
    # A chain: one key, its rows and whether another row has it.
    chains = cut_lineage(entries.groupBy("key").agg(F.count("*").alias("rows")))
    depth = directory_depth(chains, capacity)
    bucket = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    repeated = chains.where("rows > 1").select("key")
    # Broadcast behind a check of its size; beyond it the join shuffles.
    few = repeated.limit(broadcast_keys + 1).count() <= broadcast_keys
    plain = docs.select(
        F.xxhash64(normalised(text)).alias("key"), normalised(text).alias("plain")
    )
    texts = (
        plain.join(F.broadcast(repeated) if few else repeated, "key", "left_semi")
        .groupBy(bucket.alias("bucket"), "key", "plain")
        .agg(F.count("*").alias("copies"))
        .select("bucket", "key", "copies", F.sha2(F.col("plain").cast("binary"), 256).alias("text_sha256"))
    )
    # Best entry of each text: most code points, smallest id, first entry.
    best = (
        entries.join(repeated, "key", "left_semi")
        .groupBy("key", "text_sha256")
        .agg(
            F.min(
                F.struct(
                    (-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "entry"
                )
            ).alias("best"),
        )
    )
    groups = texts.where("copies > 1").join(best, ["key", "text_sha256"]).select(
        F.col("key").alias("_key"),
        F.col("text_sha256").alias("_sha"),
        F.col("best.doc_id").alias("_keep"),
        F.col("best.entry").alias("_entry"),
        F.col("copies").alias("_copies"),
    )
    joined = entries.join(groups, (F.col("key") == F.col("_key")) & (F.col("text_sha256") == F.col("_sha")), "left")
    alone = F.col("_copies").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_copies", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_entry") == F.col("entry"))).alias("kept"),
        "text_sha256",
        *([] if row is None else [F.col("entry").alias(row)]),
    )
