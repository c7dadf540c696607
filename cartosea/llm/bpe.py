"""Byte-level BPE encoding and decoding through one global shuffle of distinct pre-tokens.

Texts are cut into pre-tokens and exploded by slice of texts (about 3 MB): the slice's positions, as one packed
sequence of word numbers, and its distinct pre-tokens, packed into a row for each of many buckets by hash. The rows of
a bucket meet, where each distinct pre-token of all texts is encoded once; its ids go back to every slice that asked,
and the slice is put together again by position. A very common pre-token is one entry of each slice, so no key is hot;
what a task holds is one bucket's vocabulary or one slice. Decoding joins ids with the token-byte table, whose size is
the vocabulary's.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartosea.llm.common import LONG_WORD, sliced

VOCABULARY = "byte_bpe_50k.tiktoken"
SLICE = 3 << 20
#: Distinct words of a bucket that a worker keeps encoded; beyond them it begins anew.
KNOWN = 1_000_000
_NULL = -(2**63)
_TABLES: dict[str, list[bytes | None]] = {}
# tiktoken's \s is Unicode's White_Space; Python's also holds 0x1C-0x1F.
_CUT = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}"))


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _vpath(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def pack(numbers: np.ndarray) -> bytes:
    """LEB128 of numbers below 2**35, then zstandard."""
    numbers = np.asarray(numbers, np.int64)
    size = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21) + (numbers >= 1 << 28)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for i in range(5):
        has = size > i
        out[(end - size)[has] + i] = ((numbers[has] >> (7 * i)) & 127) | np.where(size[has] > i + 1, 128, 0)
    return zstandard.ZstdCompressor(level=3).compress(out.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    """The numbers of pack()."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size = last - first + 1
    out = np.zeros(len(last), np.int64)
    for i in range(5):
        has = size > i
        out[has] |= (data[first[has] + i].astype(np.int64) & 127) << (7 * i)
    return out


_ROWS = "slice long, bucket int, sizes binary, body binary"
_ROWS_ARROW = (pa.int64(), pa.int32(), pa.binary(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _ROWS_ARROW)], names=["slice", "bucket", "sizes", "body"])


def _explode(buckets: int):
    """Rows of a slice: its words by bucket; bucket -1 has the positions, -2 the row ids and lengths in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for b in sliced(batches, "_text", SLICE):
            index: dict[str, int] = {}
            put, which, lengths = index.setdefault, [], []
            for t in b.column("_text").to_pylist():
                toks = _CUT.findall(t) if t else []
                lengths.append(len(toks))
                which += [put(x, len(index)) for x in toks]
            key = (part << 32) | seq
            seq += 1
            words = [w.encode() for w in index]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            # positions hold ranks by frequency, so that most need a byte; a bucket has its words in order of rank
            which = np.asarray(which, np.int64)
            often = np.argsort(-np.bincount(which, minlength=len(words)), kind="stable") if len(words) else np.zeros(0, np.int64)
            rank = np.empty(len(words), np.int64)
            rank[often] = np.arange(len(words))
            order = often[np.argsort(bucket[often], kind="stable")]
            rows = [(key, -2, pack(lengths), b.column("_row").to_numpy().tobytes()), (key, -1, pack(rank[which]), pack(bucket[often]))]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            order = order.tolist()
            for i in range(buckets):
                if edges[i] < edges[i + 1]:
                    own = [words[j] for j in order[edges[i] : edges[i + 1]]]
                    rows.append((key, i, pack(np.fromiter(map(len, own), np.int64, len(own))), zip_(b"".join(own))))
            yield _batch(rows)

    return run


_CODERS: dict[str, tiktoken.Encoding] = {}


def coder(path: str) -> tiktoken.Encoding:
    """A worker's encoder for a rank file."""
    if path not in _CODERS:
        _CODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return _CODERS[path]


def _encode_words(path: str):
    """Rows of words, in order of their bucket, become rows of ids; a word is encoded once for its bucket, one of more than
    LONG_WORD bytes once for each slice that has it."""

    def run(batches):
        one = coder(path)._core_bpe.encode_single_piece
        unzip, now, known = zstandard.ZstdDecompressor().decompress, None, {}
        for b in batches:
            rows = []
            for key, bucket, sizes, body in zip(*[b.column(c).to_pylist() for c in ("slice", "bucket", "sizes", "body")]):
                if bucket != now or len(known) > KNOWN:
                    now, known = bucket, {}
                ends = np.cumsum(unpack(sizes)).tolist()
                body, ids = unzip(body), []
                for a, z in zip([0, *ends], ends):
                    w = body[a:z]
                    got = known.get(w)
                    if got is None:
                        got = one(w)
                        if len(w) <= LONG_WORD:
                            known[w] = got
                    ids.append(got)
                rows.append((key, bucket, pack(np.fromiter(map(len, ids), np.int64, len(ids))), pack(np.fromiter((x for y in ids for x in y), np.int64))))
            if rows:
                yield _batch(rows)

    return run


def _words_only(batches):
    for b in batches:
        yield b.filter(pa.compute.greater_equal(b.column("bucket"), 0))


def _assemble(pieces: pa.Table, ids: pa.Table) -> pa.Table:
    """One slice's documents from its positions (pieces also has its words) and its words' ids."""
    pieces = pieces.filter(pa.compute.less(pieces.column("bucket"), 0)).sort_by("bucket")
    (lengths, row), (ranks_, buckets) = zip(pieces.column("sizes").to_pylist(), pieces.column("body").to_pylist())
    words = sorted(zip(*[ids.column(c).to_pylist() for c in ("bucket", "sizes", "body")]))
    row, lengths = np.frombuffer(row, np.int64), unpack(lengths)
    size = np.concatenate([unpack(w[1]) for w in words]) if words else np.zeros(0, np.int64)
    flat = np.concatenate([unpack(w[2]) for w in words]) if words else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    place = np.empty(len(size), np.int64)
    place[np.argsort(unpack(buckets), kind="stable")] = np.arange(len(size))
    source = place[unpack(ranks_)]
    n = size[source]
    stop = np.cumsum(n)
    total = int(stop[-1]) if len(stop) else 0
    out = flat[np.repeat(begin[source] - (stop - n), n) + np.arange(total)].astype(np.int32)
    word_end = np.concatenate([[0], np.cumsum(lengths)])
    offsets = np.concatenate([[0], stop])[word_end].astype(np.int32)
    return pa.table({"_row": pa.array(row), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))})


def _encoded(docs: DataFrame, row: str, text: str, path: str, finish, schema: str) -> DataFrame:
    """finish(slice's rows as a table of _row and ids) for every slice."""
    buckets = max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slim = docs.select(F.coalesce(F.col(row).cast("long"), F.lit(_NULL)).alias("_row"), F.col(text).alias("_text"))
    # both sides start from one exchange by slice: positions wait there while the words go round
    pieces = slim.mapInArrow(_explode(buckets), _ROWS).repartition("slice")
    words = pieces.mapInArrow(_words_only, _ROWS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(path), _ROWS)
    return pieces.groupBy("slice").cogroup(words.groupBy("slice")).applyInArrow(lambda a, b: finish(_assemble(a, b)), schema)


def encode(docs: DataFrame, row: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(row, ids array<int>) for each row of docs: the ids of its whole text, each pattern match encoded separately.

    A null or empty text has no ids. row must be an integer column; repeated values stay repeated rows; null ones
    come back null. Other columns are ignored. docs is read once, but may be read again if an executor is lost, so it
    should be a table rather than a random draw.
    """
    done = _encoded(docs, row, text, _vpath(vocabulary), lambda t: t, "_row long, ids array<int>")
    return done.select(F.when(F.col("_row") != _NULL, F.col("_row")).alias(row), "ids")


def _decode(table: list[bytes | None], fields: list[str]):
    def run(batches):
        for b in batches:
            get = table.__getitem__
            ids = _each(b.column("ids"))
            if any(len(x) and int(x.min()) < 0 for x in ids):
                raise ValueError("an id below 0")
            try:
                text = [b"".join(map(get, x.tolist())) if len(x) else b"" for x in ids]
            except (IndexError, TypeError) as e:
                raise ValueError("an id that isn't in the vocabulary") from e
            yield pa.record_batch([*[b.column(f) for f in fields], pa.array(text, pa.binary())], names=[*fields, "bytes"])

    return run


def _each(col: pa.Array):
    flat = col.flatten().to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(np.asarray([v or 0 for v in pa.compute.list_value_length(col).to_pylist()], np.int64))])
    return [flat[a:z] for a, z in zip(edges[:-1], edges[1:])]


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """encoded with a column bytes: its ids joined with the token-byte table (as large as the vocabulary, so every
    worker holds it). No ids: no bytes; an id that the table hasn't is an error."""
    path = _vpath(vocabulary)
    return encoded.mapInArrow(_decode_lazy(path, encoded.columns), T.StructType([*encoded.schema.fields, T.StructField("bytes", T.BinaryType())]))


def _decode_lazy(path: str, fields: list[str]):
    def run(batches):
        if path not in _TABLES:
            table = {i: t for t, i in ranks(path).items()}
            _TABLES[path] = [table.get(i) for i in range(max(table) + 1)]
        yield from _decode(_TABLES[path], fields)(batches)

    return run


def _digest(batches):
    import hashlib

    text = None
    for b in batches:
        ids, sums = _each(b.column("ids")), []
        top = max((int(x.max()) for x in ids if len(x)), default=0)
        if text is None or len(text) <= top:
            text = [str(i) for i in range(max(top + 1, 1 << 16))]
        get = text.__getitem__
        for x in ids:
            sums.append(hashlib.sha256(" ".join(map(get, x.tolist())).encode()).hexdigest())
        back = [hashlib.sha256(x).hexdigest() for x in b.column("bytes").to_pylist()]
        yield pa.record_batch([b.column("_row"), pa.array([len(x) for x in ids], pa.int64()), pa.array(sums), pa.array(back)], names=["_row", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: docs encoded, then decoded by the token-byte table, in the worker
    that puts a slice together."""
    path = _vpath(vocabulary)
    decoder = _decode_lazy(path, ["_row", "ids"])

    def finish(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_digest(decoder(table.combine_chunks().to_batches())), pa.schema([("_row", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    out = _encoded(docs, "doc_id", "text", path, finish, "_row long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(F.when(F.col("_row") != _NULL, F.col("_row")).alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
