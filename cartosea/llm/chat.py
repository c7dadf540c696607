"""Chat formatting as a prefix tree of token segments.

Conversations that share their initial turns share those turns' nodes: a node is keyed by the hash of all turns up to
it, and its tokens are written once, depth first. Each node has the position id of its first token (the tokens of its
ancestors), its own interval in the stream and its ancestors' intervals, which are all that its tokens may attend to.
The order is a range sort by path (the keys' prefixes from the root, so a subtree is contiguous and a parent comes
first); a subtree of any size is cut anywhere between shards, and what one shard must know of the shards before it is
one stack of open ancestors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.llm.bpe import _CUT, VOCABULARY, coder, ranks
from cartosea.llm.common import stage

#: Strings that a template may treat as control; inside texts a backslash parts them.
_CONTROL = re.compile(r"<(?=/?s>|\||</?SYS>>)|\|(?=>)|\[(?=/?INST\])|<(?=/?SYS>>)")
_PART = re.compile(r"\\(.)", re.S)
_HEAD, _NEXT, _TAIL = "<|", "|>\n", "</s>\n"


def escape(text: str) -> str:
    """Double backslashes, then put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undo escape()."""
    return _PART.sub(r"\1", text)


_NODE = "key binary, path binary, depth int, n_head int, n_body int, position long, lengths array<int>, tokens array<int>, formatted_chars long, role string"
_TURNS = "conv_id long, depth int, key binary"


def _segments(role: str, text: str) -> tuple[str, str, str]:
    return _HEAD + escape(role) + _NEXT, escape(text), _TAIL


def _nodes(path: str, tree: bool):
    """For each conversation's turns: its nodes (tree) or the keys that it passes (not tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = coder(path)._core_bpe.encode_single_piece
        # the library's own pattern overflows its stack on long white space

        def encode(text: str) -> list[int]:
            return [i for x in _CUT.findall(text) for i in one(x.encode())]

        known: dict[bytes, tuple] = {}
        for b in batches:
            rows: list[tuple] = []
            for conv, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist()):
                key, where, position, lengths = b"", b"", 0, []
                for depth, t in enumerate(turns):
                    role, text = t["role"] or "", t["text"] or ""
                    key = hashlib.sha256(key + len(role.encode()).to_bytes(8, "big") + role.encode() + text.encode()).digest()[:16]
                    if not tree:
                        rows.append((conv, depth, key))
                        continue
                    where += key[:8]
                    if key not in known:
                        if len(known) > 5000:
                            known.clear()
                        parts = _segments(role, text)
                        ids = [encode(x) for x in parts]
                        known[key] = [len(ids[0]), len(ids[1])], [x for y in ids for x in y], sum(map(len, parts))
                        rows.append((key, where, depth, *known[key][0], position, list(lengths), known[key][1], known[key][2], role))
                    n = len(known[key][1])
                    position += n
                    lengths.append(n)
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.string()) if tree else (pa.int64(), pa.int32(), pa.binary())
            names = [x.split()[0] for x in (_NODE if tree else _TURNS).split(", ")]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


_LAID = "shard int, key binary, path binary, depth int, role string, n_head int, n_body int, position long, start long, open_at array<long>, lengths array<int>, tokens array<int>, formatted_chars long"


def _lay(batches):
    """Offsets within a shard; an ancestor from an earlier shard stays null. `last` rows end the shard."""
    from pyspark import TaskContext

    shard, at, stack = TaskContext.get().partitionId(), 0, []
    for b in batches:
        starts, opened = [], []
        for path, depth, tokens in zip(b.column("path").to_pylist(), b.column("depth").to_pylist(), pa.compute.list_value_length(b.column("tokens")).to_pylist()):
            while stack and not path.startswith(stack[-1][0]):
                stack.pop()
            have = {len(p) // 8 - 1: s for p, s in stack}
            opened.append([have.get(d) for d in range(depth)])
            starts.append(at)
            stack.append((path, at))
            at += tokens
        cols = {"shard": pa.array([shard] * b.num_rows, pa.int32()), "start": pa.array(starts, pa.int64()), "open_at": pa.array(opened, pa.list_(pa.int64()))}
        names = [x.split()[0] for x in _LAID.split(", ")]
        yield pa.record_batch([cols.get(n) if n in cols else b.column(n) for n in names], names=names)


def format_tree(turns: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, passes): the tree's segments and, for each conversation, the keys of the nodes that it passes.

    turns has conv_id, turn, role and text; a null role or text is empty, equal turn numbers follow role and text, a
    null conv_id is a conversation of its own, equal rows are turns of their own, other columns are ignored. A
    conversation is put together in one task, and a node carries its ancestors' intervals, so what a task holds grows
    with the square of one conversation's turns (never with the number of conversations that share them). nodes has for each node key, role, depth, start and stop (its interval in
    the stream), loss_start and loss_stop (the text of assistants, else equal), position (id of its first token),
    attends (the ancestors' intervals, root first), tokens and formatted_chars. An empty table gives none.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    passes = convs.mapInArrow(_nodes(path, False), _TURNS)
    made = convs.mapInArrow(_nodes(path, True), _NODE)
    # equal nodes meet after a map-side step, so a first turn that most conversations share is a row for each task
    nodes = stage(made.groupBy("key").agg(*[F.first(c).alias(c) for c in (x.split()[0] for x in _NODE.split(", ")) if c != "key"]), "chat-nodes")
    laid = stage(nodes.repartitionByRange(F.col("path")).sortWithinPartitions("path").mapInArrow(_lay, _LAID), "chat-laid")
    # one row for each shard: its length and the ancestors left open at its end
    tail = laid.groupBy("shard").agg(F.sum(F.size("tokens")).alias("n"), F.max(F.struct("path", "start", "open_at")).alias("last"), F.min("path").alias("first")).orderBy("shard").collect()
    base, carry, at, stack = {}, {}, 0, []
    for r in tail:
        base[r["shard"]] = at
        carry[r["shard"]] = [s for s in stack]
        local = [*r["last"]["open_at"], r["last"]["start"]]
        stack = [at + s if s is not None else (stack[d] if d < len(stack) else None) for d, s in enumerate(local)]
        at += r["n"]
    spark = turns.sparkSession
    shards = spark.createDataFrame([(k, base[k], carry[k]) for k in base], "shard int, base long, carry array<long>")
    full = laid.join(F.broadcast(shards), "shard") if base else laid.crossJoin(shards.drop("shard").limit(0))
    starts = F.transform("open_at", lambda s, i: F.coalesce(s + F.col("base"), F.try_element_at("carry", i + 1)))
    attends = F.transform(F.arrays_zip(starts.alias("s"), F.col("lengths").alias("n")), lambda x: F.struct(x["s"].alias("start"), (x["s"] + x["n"]).alias("stop")))
    begin = F.col("base") + F.col("start")
    body = begin + F.col("n_head")
    out = full.select(
        "key", "role", "depth", begin.alias("start"), (begin + F.size("tokens")).alias("stop"), body.alias("loss_start"),
        F.when(F.col("role") == "assistant", body + F.col("n_body")).otherwise(body).alias("loss_stop"), "position", attends.alias("attends"), "tokens", "formatted_chars",
    )
    return stage(out, "chat-tree"), passes


def _read(path: str):
    def run(batches):
        table = {i: t for t, i in ranks(path).items()}
        get = table.__getitem__
        text_of = lambda ids: b"".join(map(get, ids)).decode()
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "start", "loss_start", "loss_stop", "tokens", "formatted_chars", "depth")]
            rows = []
            for key, a, x, y, tokens, chars, depth in zip(*cols):
                whole = text_of(tokens)
                if not (whole.startswith(_HEAD) and whole.endswith(_TAIL) and len(whole) == chars):
                    raise ValueError("a node's tokens don't decode to a formatted turn")
                role, _, rest = whole[len(_HEAD) :].partition(_NEXT)
                rows.append((key, unescape(role), unescape(rest[: -len(_TAIL)]), unescape(text_of(tokens[x - a : y - a])), chars, depth))
            kinds = (pa.binary(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["key", "role", "text", "loss", "chars", "node_depth"])

    return run


def _digest(batches):
    for b in batches:
        rows = []
        for conv, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist()):
            turns = sorted(turns, key=lambda t: t["depth"])
            loss = "".join(t["loss"] for t in turns)
            whole = "".join(f"{t['role']}\n{t['text']}\n" for t in turns)
            rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(t["chars"] for t in turns)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(nodes: DataFrame, passes: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Decode the tree's tokens, cut the loss spans and digest each conversation along its path."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    parsed = stage(nodes.mapInArrow(_read(path), "key binary, role string, text string, loss string, chars long, node_depth int"), "chat-read")
    joined = stage(passes, "chat-passes").join(parsed, "key")
    turns = joined.groupBy("conv_id").agg(F.collect_list(F.struct("depth", "role", "text", "loss", "chars")).alias("turns"))
    return turns.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
