"""N-gram Jaccard join by chosen paths: split on sampled shared tokens, brute-force what is small."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeflow.llm.components import components
from ridgeflow.llm.hashing import mixed, running_hash, slices, span_hash, text_buffer
from ridgeflow.session import cut_lineage

WORDS, THRESHOLD = 5, 0.8
#: Sampled tokens that a pair at the threshold shares in a run, on average; the share of such
#: pairs to find; and the tokens shared by a step further down.
SHARED, RECALL, DEEPER = 2.0, 0.99999, 1.5
#: Members of a bucket that are compared with each other, and steps before larger ones are cut.
BUCKET, DEPTH = 4096, 3
#: Minima of a sketch, and the estimate from which a pair is verified.
BINS, ESTIMATE = 64, 0.5
#: Members and tokens of a block in the verification.
BLOCK, BLOCK_TOKENS = 1024, 2_000_000
#: Ids that may be broadcast to pick documents, 16 bytes each.
BROADCAST_IDS = 1_000_000

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_PLACES = mixed(np.arange(16, dtype=np.uint64), 77) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted hashes of the different word n-grams of each text, in lower case.

    A text with fewer words has one n-gram of all of them; without words it has none."""
    lowered = pc.utf8_lower(column.cast(pa.large_string()))
    data, offsets = text_buffer(lowered)
    for first, last in slices(offsets, 1 << 19):
        here = offsets[first : last + 1] - offsets[first]
        piece = data[offsets[first] : offsets[last]]
        inside = ~_BLANK[piece]
        edge = np.ones(len(piece) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[here] = True
        start = np.flatnonzero(inside & edge[:-1])
        end = np.flatnonzero(inside & edge[1:]) + 1
        hashes = span_hash(running_hash(piece), start, end)
        upto = np.searchsorted(start, here)
        with np.errstate(over="ignore"):
            total = max(len(hashes) - words + 1, 0)
            grams = np.zeros(total, np.uint64)
            for k in range(words):
                grams += hashes[k : k + total] * _PLACES[k]
            grams = mixed(grams, 5)
            for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                if b - a >= words:
                    yield np.unique(grams[a : b - words + 1])
                elif b > a:
                    yield mixed((hashes[a:b] * _PLACES[: b - a]).sum(keepdims=True), b - a)
                else:
                    yield np.zeros(0, np.uint64)


def _below(rate: float) -> np.uint64:
    return np.uint64(min(int(rate * 2.0**64), 2**64 - 1))


def lost_in_splits(depth: int = DEPTH) -> float:
    """Chance that a shared path is lost where every bucket on its way is split, ``depth`` times.

    A path has a Poisson number of shared paths after it, DEEPER on average; it is lost if all
    of them are."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(-DEEPER * (1 - lost))
    return lost


def run_count(shared: float = SHARED, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is missed with a chance of 1 - recall at most.

    This holds wherever its tokens lie, also if all its buckets are split ``depth`` times."""
    return max(1, math.ceil(-math.log(max(1 - recall, 1e-12)) / (shared * (1 - lost_in_splits(depth)))))


def first_paths(tokens: np.ndarray, runs: int, shared: float, threshold: float) -> np.ndarray:
    """Paths of one step: in each run, the tokens whose hash falls under a rate of 1 / size."""
    out = []
    for run in range(runs):
        chosen = tokens[mixed(tokens, 100 + run) <= _below(shared / (threshold * max(len(tokens), 1)))]
        out.append(mixed(chosen, 200 + run))
    return np.concatenate(out).view(np.int64)


def next_paths(tokens: np.ndarray, path: int, shared: float, threshold: float) -> np.ndarray:
    """Paths one step longer: by the token and the path so far, so that sharers agree."""
    salted = mixed(tokens ^ mixed(np.array([path], np.int64).view(np.uint64), 7), 8)
    chosen = salted[salted <= _below(shared / (threshold * max(len(tokens), 1)))]
    return mixed(chosen, 9).view(np.int64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin, in 16 bits; an empty bin holds zero."""
    out = np.zeros(BINS, np.uint16)
    spread = np.sort(mixed(tokens, 50))
    bins = (spread >> np.uint64(58)).astype(np.int64)
    held, first = np.unique(bins, return_index=True)
    out[held] = (mixed(spread[first], 51) & np.uint64(0xFFFE)).astype(np.uint16) + 1
    return out


def _alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, least: float) -> np.ndarray:
    """Pairs, row by row or by broadcasting, whose sizes and sketches allow the threshold."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    sizes = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
    return sizes & (same >= least * used)


def _forest(pairs_of: Callable[[int], np.ndarray], size: int) -> np.ndarray:
    """Root of each of ``size`` nodes, given the neighbours of each among the later ones."""
    root = np.arange(size)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(size):
        for j in pairs_of(i):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(size)], np.int64)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, from batches sorted by the keys; a group spans few batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(batch) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
        elif held and (held[-1][keys].iloc[-1] != batch[keys].iloc[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def _group_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    values = frame[keys].to_numpy()
    return np.append(np.flatnonzero(np.append(True, (values[1:] != values[:-1]).any(axis=1))), len(frame))


def _bucket_edges(threshold: float, least: float):
    keys = ["path", "low", "high"]

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, keys):
            starts = _group_starts(frame, keys)
            rep, size = frame["rep"].to_numpy(np.int64), frame["size"].to_numpy(np.int64)
            marks = np.frombuffer(b"".join(frame["sketch"]), np.uint16).reshape(-1, BINS)
            count = np.diff(starts)
            two = starts[:-1][count == 2]
            fine = two[_alike(marks[two], marks[two + 1], size[two], size[two + 1], threshold, least)]
            a, b = [rep[fine]], [rep[fine + 1]]
            for s, n in zip(starts[:-1][count > 2].tolist(), count[count > 2].tolist(), strict=True):
                m, z = marks[s : s + n], size[s : s + n]
                root = _forest(
                    lambda i, m=m, z=z: i + 1 + np.flatnonzero(_alike(m[i], m[i + 1 :], z[i], z[i + 1 :], threshold, least)), n
                )
                moved = np.flatnonzero(root != np.arange(n))
                a.append(rep[s + moved])
                b.append(rep[s + root[moved]])
            out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
            yield out[out["a"] != out["b"]].drop_duplicates()

    return edges


def _verify(threshold: float):
    """Exact links between the members of a block pair: counts, and the root of each member."""

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep").sort_values("rep", kind="stable").reset_index(drop=True)
        rep, part = rows["rep"].to_numpy(np.int64), rows["part"].to_numpy(np.int64)
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        size = np.array([len(s) for s in sets])
        n = len(sets)
        shared = np.zeros((n, n), np.float32)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.append(True, flat[1:] != flat[:-1])
        token = np.cumsum(new) - 1
        common = np.bincount(token)[token] > 1
        token, owner = token[common], owner[common]
        columns = max(1, (2 << 20) // max(n, 1))
        if len(token):
            token = np.cumsum(np.append(True, token[1:] != token[:-1])) - 1
            for first in range(0, int(token[-1]) + 1, columns):
                a, b = np.searchsorted(token, [first, first + columns])
                block = np.zeros((n, min(columns, int(token[-1]) + 1 - first)), np.float32)
                block[owner[a:b], token[a:b] - first] = 1
                shared += block @ block.T
        both = size[:, None] + size[None, :] - shared
        linked = shared >= threshold * both - 1e-6
        if low != high:  # only pairs across the two blocks: those within are counted elsewhere
            linked &= part[:, None] != part[None, :]
        np.fill_diagonal(linked, False)
        root = _forest(lambda i: i + 1 + np.flatnonzero(linked[i, i + 1 :]), n)
        copies = rows["copies"].to_numpy(np.int64)
        return pd.DataFrame(
            {"rep": rep, "links": linked.sum(axis=1).astype(np.int64), "copies": (linked @ copies).astype(np.int64), "root": rep[root]}
        )

    return verify


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    shared: float = SHARED,
    recall: float = RECALL,
    bucket: int = BUCKET,
    depth: int = DEPTH,
    block: int = BLOCK,
    row: str | None = None,
) -> DataFrame:
    """Documents whose sets of word n-grams have a Jaccard similarity of ``threshold`` or more.

    Returns one row per input row: ``doc_id``; ``class_id``, the smallest id of its class
    (texts joined by links, directly or through others); ``text_id``, the smallest id with the
    same set of n-grams; ``n_links``, the number of other sets linked to its own; and
    ``n_linked_docs``, the documents behind them, copies counted. With ``row``, a column that
    numbers the rows, also that column and ``kept``: one row of each class, the one with the
    smallest id and then the smallest number.

    Documents with equal sets are one member from the start, with a count of copies. A member
    is named by a hash of its set, never by an id: an id may stand on several texts. In each
    run a member chooses, by a hash, about ``shared / threshold`` of its tokens; members that
    share a chosen token meet in a bucket. Runs repeat until a pair at the threshold is missed
    with a chance of ``1 - recall`` only, losses in split buckets counted. A bucket of more than ``bucket`` members is split
    again on further sampled tokens, up to ``depth`` steps, and dealt out in pairs of blocks
    where members stay together because they are alike. Small buckets are compared member by
    member on sketches; what may be alike joins candidate groups, and every pair of a group is
    verified on whole sets, in pairs of blocks where a group is large. So links and their
    numbers are exact inside a group, no group is gathered as a whole, and copies are never
    paired.

    Texts without words have no links and are classes of their own, like rows without an id
    (class null). Rows that repeat an id count as one member per different text."""
    given = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(text)).alias("mark"),
        (F.lit(0) if row is None else F.col(row)).cast("long").alias("row"),
    )
    runs = run_count(shared, recall, depth)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tokens in shingle_sets(batch.column(1), words):
                with np.errstate(over="ignore"):
                    digest = [int(np.int64(mixed(tokens, s).sum().view(np.int64))) if len(tokens) else 0 for s in (1, 2)]
                rows.append((len(tokens), *digest, sketch(tokens).tobytes(), first_paths(tokens, runs, shared, threshold)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            named = ["doc_id", "mark", "row", "size", "h1", "h2", "sketch", "paths"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *arrays], named)

    schema = "doc_id long, mark long, row long, size long, h1 long, h2 long, sketch binary, paths array<long>"
    described = cut_lineage(given.mapInArrow(describe, schema))
    usable = described.where("size > 0 AND doc_id IS NOT NULL")
    members = cut_lineage(
        usable.groupBy("h1", "h2", "size").agg(
            F.min(F.struct("doc_id", "row", "mark")).alias("first"),
            F.count("*").alias("copies"),
            F.min_by("sketch", "doc_id").alias("sketch"),
            F.min_by("paths", "doc_id").alias("paths"),
        ).withColumn("rep", F.xxhash64("h1", "h2", "size"))
    )
    places = members.select("rep", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """A text of each given member, found by id and text hash; broadcast only where few."""
        ids = wanted.join(places, "rep")
        few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        found = (given["doc_id"] == ids["_id"]) & (given["mark"] == ids["_mark"])
        return given.select("doc_id", "text", "mark").join(F.broadcast(ids) if few else ids, found).drop("doc_id", "mark", "_id", "_mark")

    # Buckets: split what is large, keep what is small.
    paths = members.select("rep", F.explode("paths").alias("path"))
    leaves: DataFrame | None = None
    for step in range(depth + 1):
        sizes = paths.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
        met = cut_lineage(paths.join(sizes, "path"))
        last = step == depth
        small = met if last else met.where(F.col("members") <= bucket)
        leaves = small if leaves is None else leaves.unionByName(small)
        large = met.where(F.col("members") > bucket)
        if last or large.isEmpty():
            break
        wanted = large.groupBy("rep").agg(F.collect_set("path").alias("paths"))  # a member's own paths

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reps, out = [], []
                owned = batch.column(2).to_pylist()
                for rep, tokens, own in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(0), words), owned, strict=True):
                    for path in own:
                        found = next_paths(tokens, path, DEEPER, threshold)
                        reps += [rep] * len(found)
                        out += found.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(out, pa.int64())], ["rep", "path"])

        paths = texts_of(wanted).select("text", "rep", "paths").mapInArrow(split, "rep long, path long").distinct()

    # Members of one bucket, or of two blocks of a large one, side by side.
    blocks = F.ceil(F.col("members") / F.lit(bucket)).cast("int")
    own = F.pmod(F.xxhash64("rep", "path"), blocks.cast("long")).cast("int")
    placed = leaves.withColumn("blocks", blocks).withColumn("part", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "rep", "path", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    )
    seen = placed.join(members.select("rep", "size", "sketch"), "rep")
    keys = ["path", "low", "high"]
    sorted_rows = seen.repartition(*keys).sortWithinPartitions(*keys)
    edges = sorted_rows.mapInPandas(_bucket_edges(threshold, ESTIMATE), "a long, b long")
    candidates = components(edges)

    # Candidate groups, in pairs of blocks where they are large.
    grouped = cut_lineage(candidates.join(members.select(F.col("rep").alias("node"), "size", "copies"), "node"))
    sizes = grouped.groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("members") / F.lit(block)), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS))).cast("int")
    dealt = grouped.join(sizes.select("root", parts.alias("parts")), "root").withColumnRenamed("node", "rep")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int"))
    dealt = cut_lineage(dealt.select("rep", "root", "parts", "part", "copies"))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([t.tobytes() for t in shingle_sets(batch.column(0), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sets], ["rep", "root", "parts", "part", "copies", "tokens"])

    named = "rep long, root long, parts int, part int, copies long, tokens binary"
    sets = texts_of(dealt).select("text", "rep", "root", "parts", "part", "copies").mapInArrow(tokens_of, named)
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "rep", "root", "part", "copies", "tokens", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    )
    verified = cut_lineage(
        pairs.groupBy("root", "low", "high").applyInPandas(_verify(threshold), "rep long, links long, copies long, root long")
    )
    counts = verified.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("copies").alias("linked"))
    roots = components(verified.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # The first row of each class of several members.
    joint = roots.join(members.select(F.col("rep").alias("node"), "first"), "node")
    heads = joint.groupBy("root").agg(F.min("first").alias("head"))
    heads = roots.join(heads, "root").select(F.col("node").alias("rep"), "head")

    classes = (
        members.select("h1", "h2", "size", "rep", "first")
        .join(counts, "rep", "left")
        .join(heads, "rep", "left")
        .select(
            F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("size").alias("_n"), F.col("first.doc_id").alias("least"),
            F.coalesce("head", "first").alias("head"), F.coalesce("links", F.lit(0)).alias("links"),
            F.coalesce("linked", F.lit(0)).alias("linked"),
        )
    )
    on = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("size") == F.col("_n"))
    joined = described.select("doc_id", "row", "h1", "h2", "size").join(cut_lineage(classes), on, "left")
    none = F.col("doc_id").isNull() | (F.col("size") == 0)
    said = [] if row is None else [F.col("row").alias(row), (none | (F.col("row") == F.col("head.row"))).alias("kept")]
    return joined.select(
        "doc_id",
        F.when(none, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(none, F.col("doc_id")).otherwise(F.col("least")).alias("text_id"),
        F.when(none, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        F.when(none, F.lit(0)).otherwise(F.col("linked")).cast("long").alias("n_linked_docs"),
        *said,
    )
