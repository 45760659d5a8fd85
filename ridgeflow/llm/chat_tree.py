"""Chat formatting as a prefix tree: shared turns once, depth first, with positions and attention."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeflow.llm.token_alignment import BYTE_TOKENIZER, byte_level_bytes
from ridgeflow.llm.tokens import public_path, small_batches
from ridgeflow.session import cut_lineage

#: Role whose texts are under the loss mask.
LEARNT = "assistant"
#: Conversations that one range of the depth-first order holds, about.
RANGE_CONVERSATIONS = 50_000
#: Conversations that read one copy of a node when texts are read back.
READERS = 5_000
#: Rows that a task turns into tokens at a time.
_ROWS = 200
#: A turn is ``<turn ROLE>TEXT</turn>``; a backslash stands before every ``<``, ``>`` and
#: backslash of role and text, so that no text holds an opening or a closing mark.
_OPEN, _MIDDLE, _CLOSE = "<turn ", ">", "</turn>"
_ESCAPED = re.compile(r"[\\<>]")
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:[^\\<>]++|\\.)*+)>((?:[^\\<>]++|\\.)*+)</turn>", re.DOTALL)


def escaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _UNESCAPED.sub(lambda m: m[1], text)


class ChatTokens:
    """Tokens of turns and back, by a byte-level tokenizer that loses no byte."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_level_bytes()
        size = self.tokenizer.get_vocab_size()
        self.held = [bytes(letters.get(c, 63) for c in self.tokenizer.id_to_token(i) or "") for i in range(size)]

    def turns(self, roles: list[str], texts: list[str]) -> list[tuple[list[int], int, int]]:
        """Ids of each turn, and the range of them that holds its text: marks and text are
        tokenised apart, so that a token belongs to one of them."""
        parts = [p for r, t in zip(roles, texts, strict=True) for p in (_OPEN + escaped(r) + _MIDDLE, escaped(t), _CLOSE)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        out = []
        for k in range(0, len(ids), 3):
            head, body, tail = ids[k : k + 3]
            out.append((head + body + tail, len(head), len(head) + len(body)))
        return out

    def text(self, ids: list[int]) -> str:
        return b"".join([self.held[i] for i in ids]).decode()


_loaded: dict[str, ChatTokens] = {}


def chat_tokens(path: str) -> ChatTokens:
    """The tokens of a file; a worker keeps it between batches and tasks."""
    if path not in _loaded:
        _loaded[path] = ChatTokens(path)
    return _loaded[path]


_TURNS = "key string, conv_id long, turn int, digest binary, tokens array<int>, text_from int, text_to int, learnt boolean"


def _tokenised(turns: DataFrame, path: str, names: tuple[str, str, str, str]) -> DataFrame:
    """Turns numbered from 0 in each conversation, with their digests and tokens.

    Turns stand in the order of (turn, role, text); a row without a conversation id is a
    conversation of its own."""
    conv, turn, role, text = names
    given = cut_lineage(
        turns.select(
            F.col(conv).cast("long").alias("conv_id"),
            F.when(F.col(conv).isNull(), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
            .otherwise(F.col(conv).cast("string"))
            .alias("key"),
            F.col(turn).cast("long").alias("place"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
    )
    order = Window.partitionBy("key").orderBy(F.col("place").asc_nulls_first(), "role", "text")
    given = given.select("key", "conv_id", (F.row_number().over(order) - 1).alias("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chat_tokens(path)
        for batch in small_batches(batches, _ROWS):
            roles, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            found = own.turns(roles, texts)
            digests = [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16] for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(digests, pa.binary()),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.int32()),
                    pa.array([f[2] for f in found], pa.int32()),
                    pa.array([r == LEARNT for r in roles], pa.bool_()),
                ],
                ["key", "conv_id", "turn", "digest", "tokens", "text_from", "text_to", "learnt"],
            )

    return cut_lineage(given.mapInArrow(run, _TURNS))


_VISITS = (
    "key string, turn int, node binary, part int, copy int, first boolean, head boolean, "
    "size int, at long, position long, above int, spans array<struct<start: long, end: long>>"
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks conversations in the order of their paths: the depth-first order of the tree.

    A conversation shares with the one before it the turns that both begin with; the others
    are new nodes and follow one another in the stream. The stack holds the nodes of the last
    path: memory is one conversation. What came before the range is not known here: the nodes
    of its first conversation (``head``) may be known from earlier ranges."""
    stack: list[list] = []  # node, at, size, copies read, in head
    at, first_path = 0, None
    out: list[tuple] = []
    for batch in batches:
        for key, digests, sizes, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shared = 0
            while shared < min(len(stack), len(digests)) and stack[shared][5] == digests[shared]:
                shared += 1
            del stack[shared:]
            head = first_path is None
            first_path = digests if head else first_path
            node = stack[-1][0] if stack else b""
            position = sum(s[2] for s in stack)
            above = sum(s[4] for s in stack)
            spans: list[list[int]] = []
            for s in stack[above:]:
                if spans and spans[-1][1] == s[1]:
                    spans[-1][1] = s[1] + s[2]
                else:
                    spans.append([s[1], s[1] + s[2]])
            for n, (digest, size) in enumerate(zip(digests, sizes, strict=True)):
                new = n >= shared
                if new:
                    node = hashlib.sha256(node + digest).digest()[:16]
                    stack.append([node, at, size, 0, head, digest])
                own = stack[n]
                item = [{"start": a, "end": b} for a, b in spans] if new else None
                out.append((key, n, own[0], part, own[3] // READERS, new, own[4], size, own[1], position, above, item))
                own[3] += 1
                if new:
                    if head:
                        above += 1
                    elif spans and spans[-1][1] == at:
                        spans[-1][1] = at + size
                    else:
                        spans.append([at, at + size])
                    at += size
                    position += size
            if len(out) > 2000:
                yield _visits(out)
                out = []
    yield _visits(out)


def _visits(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), span]
    names = ["key", "turn", "node", "part", "copy", "first", "head", "size", "at", "position", "above", "spans"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def chat_tree(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    tokenizer: str | None = None,
    range_conversations: int = RANGE_CONVERSATIONS,
) -> tuple[DataFrame, DataFrame]:
    """Conversations as one stream of tokens in which shared initial turns stand once.

    Returns two tables. ``nodes`` has a row per node of the prefix tree (a turn after all the
    turns before it): ``node``, ``start`` (its place in the stream; nodes are gapless and
    depth first), ``tokens``, ``position_ids`` (tokens of its ancestors, and on from there),
    ``loss_mask`` (text of the assistant) and ``attends``, the stretches of the stream that
    hold its ancestors: a token sees these and its own node up to itself. ``visits`` has a row
    per conversation and turn: ``key``, ``conv_id``, ``turn``, ``node`` and ``copy``.

    Conversations are sorted by the digests of their turns (equal paths by their keys, so that
    copies and shared beginnings are dealt over ranges), each range is walked as a stream, and
    nodes that a range meets only in its first conversation are taken from the first range
    that has them; places are then sums over ranges. No tree, node or group of copies is ever
    brought together, only the turns of one conversation are.

    Null texts and roles are empty, turns with equal numbers stand in the order of role and
    text and repeated rows are turns of their own; a row without a conversation id is a
    conversation of one turn. An empty table gives empty tables; other columns are ignored."""
    path = tokenizer or public_path(BYTE_TOKENIZER)
    rows = _tokenised(turns, path, (conv_id, turn, role, text))
    inner = F.sort_array(F.collect_list(F.struct("turn", "digest", F.size("tokens").alias("size"))))
    convs = rows.groupBy("key").agg(inner.alias("turns"))
    convs = cut_lineage(convs.select("key", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes")))
    ranges = max(1, -(-convs.count() // range_conversations))
    dealt = convs.repartitionByRange(ranges, "digests", "key").sortWithinPartitions("digests", "key")
    visits = cut_lineage(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_walk, _VISITS))

    new = visits.where("first").select("key", "turn", "node", "part", "head", "size", "at", "position", "above", "spans")
    heads = new.where("head").select("node").distinct()
    owners = new.join(heads, "node").groupBy("node").agg(F.min("part").alias("owner"))
    new = new.join(owners, "node", "left")
    new = cut_lineage(new.withColumn("own", F.coalesce(F.col("owner") == F.col("part"), F.lit(True))).drop("owner"))
    # Nodes of a range's first conversation that an earlier range has: they come first there.
    lost = F.sum(F.when(F.col("own"), 0).otherwise(F.col("size")))
    parts = new.groupBy("part").agg(F.sum("size").alias("all"), lost.alias("lost"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = parts.select("part", "lost", (F.coalesce(F.sum(F.col("all") - F.col("lost")).over(upto), F.lit(0)) - F.col("lost")).alias("shift"))
    placed = new.join(parts, "part").withColumn("start", F.col("at") + F.col("shift"))
    # Places of the first path of every range, wherever its nodes stand.
    owned = placed.where("own").select("node", F.col("start").alias("true_start"))
    first_path = (
        new.where("head")
        .select("part", "turn", "node", "size")
        .join(owned, "node")
        .groupBy("part")
        .agg(F.sort_array(F.collect_list(F.struct("turn", F.col("true_start").alias("start"), (F.col("true_start") + F.col("size")).alias("end")))).alias("path"))
    )
    nodes = placed.where("own").join(first_path, "part")
    inherited = F.transform(F.slice("path", F.lit(1), F.col("above")), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("shift")).alias("start"), (s["end"] + F.col("shift")).alias("end")))
    nodes = nodes.select("key", "turn", "node", "start", "position", F.concat(inherited, moved).alias("attends"))
    tokens = rows.select("key", "turn", "tokens", "text_from", "text_to", "learnt")
    count = F.size("tokens")
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    nodes = nodes.join(tokens, ["key", "turn"]).select(
        "node",
        "start",
        "tokens",
        F.transform(steps, lambda k: F.col("position") + k).alias("position_ids"),
        F.transform(steps, lambda k: F.col("learnt") & (k >= F.col("text_from")) & (k < F.col("text_to"))).alias("loss_mask"),
        "attends",
    )
    names = rows.select("key", "turn", "conv_id")
    return cut_lineage(nodes), visits.select("key", "turn", "node", "part", "copy").join(names, ["key", "turn"])


def read_back(nodes: DataFrame, visits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Turns of every conversation, read from the tokens of the tree.

    One row per conversation and turn: ``key``, ``conv_id``, ``turn``, ``role``, ``text``,
    ``learnt`` (the text under the loss mask, null if there is none) and ``chars`` (of the
    formatted turn). A node that many conversations share is read from copies of it, one for
    a bounded number of readers."""
    path = tokenizer or public_path(BYTE_TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chat_tokens(path)
        for batch in small_batches(batches, _ROWS):
            tokens, masks = batch.column(1), batch.column(2)
            roles, texts, learnt, chars = [], [], [], []
            for ids, mask in zip(tokens.to_pylist(), masks.to_pylist(), strict=True):
                whole = own.text(ids)
                said = _TURN.fullmatch(whole)
                if said is None:
                    raise ValueError("tokens of a node are not one turn")
                roles.append(unescaped(said[1]))
                texts.append(unescaped(said[2]))
                masked = [i for i, m in zip(ids, mask, strict=True) if m]
                learnt.append(unescaped(own.text(masked)) if roles[-1] == LEARNT else None)
                chars.append(len(whole))
            strings = [pa.array(v, pa.string()) for v in (roles, texts, learnt)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *strings, pa.array(chars, pa.int64())], ["node", "role", "text", "learnt", "chars"]
            )

    read = nodes.select("node", "tokens", "loss_mask").mapInArrow(run, "node binary, role string, text string, learnt string, chars long")
    copies = visits.select("node", "part", "copy").distinct().join(read, "node")
    return visits.join(copies, ["node", "part", "copy"]).select("key", "conv_id", "turn", "role", "text", "learnt", "chars")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``read_back``: ``conv_id``, ``n_turns``, ``turns_sha256`` (role,
    newline, text, newline per turn), ``loss_chars``, ``loss_sha256`` (all text under the loss
    mask) and ``formatted_chars``. Turns are read as a stream in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for key, conv_id, role, text, learnt, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != now[0]:
                    if now is not None:
                        done.append(now)
                    now = [key, conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[2] += 1
                now[3].update(f"{role}\n{text}\n".encode())
                now[4] += len(learnt or "")
                now[5].update((learnt or "").encode())
                now[6] += chars
            if len(done) > 1000:
                yield _digests(done)
                done = []
        yield _digests([*done, now] if now is not None else done)

    ordered = turns.repartition("key").sortWithinPartitions("key", "turn").select("key", "conv_id", "role", "text", "learnt", "chars")
    return ordered.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digests(rows: list[list]) -> pa.RecordBatch:
    shown = [(conv_id, n, turns.hexdigest(), size, loss.hexdigest(), chars) for _, conv_id, n, turns, size, loss, chars in rows]
    columns = list(zip(*shown, strict=True)) if shown else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def format_conversations(
    turns: DataFrame, tokenizer: str | None = None, range_conversations: int = RANGE_CONVERSATIONS
) -> DataFrame:
    """Digests of all conversations, read back from the prefix tree they are formatted as."""
    nodes, visits = chat_tree(turns, tokenizer=tokenizer, range_conversations=range_conversations)
    return conversation_digests(read_back(nodes, visits, tokenizer))
