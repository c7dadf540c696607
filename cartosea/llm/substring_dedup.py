"""Substring dedup by level-wise doubling over word windows.

Level 0 compares every window of half the asked length (18 words for 35). From then on a window is a candidate only where
both of its halves were repeated one level before: two overlapping windows of 18 words give 35, two of 35 give 70, then
140, and so on, until no candidate is repeated. A window's hash is made of its halves' hashes, so texts are read once
for level 0 and once more at the end, to take out the words that repeated windows of the asked length cover.

A level is one round trip of packed arrays (`_survivors`): a piece of the table (some two million windows) sends each
of its distinct hashes once, dealt by value to buckets of bounded size; a bucket counts in how many places each hash
stands, and its verdicts go back to the pieces that asked. Hashes that stand twice within a piece are known there, so a
window that millions of documents share is one entry of each piece and no bucket grows with it. Copies of a text are
one row from level 1 on, which counts as two places.

Level 0's hashes have 40 bits and the number of their bucket (64 buckets or more, more with the table); they only choose
candidates. Later ones have 64 bits. Two different windows of 35 words would be taken as equal if one half were the same
and the other's level 0 hashes collided (1 in 2**46 or less for each such pair), or both did.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cartosea.llm.common import column, discard, sliced, stage, text_key, utf8
from cartosea.llm.wordhash import Words, covered, mix

WINDOW = 35
#: Windows of a piece and of a bucket, about.
PIECE, BUCKET, BUCKETS = 2_000_000, 2_000_000, 64
#: Bytes of a hash that level 0 sends, and later levels.
NARROW, WIDE = 5, 8
KEY = 12
_HALVES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ROWS = "piece long, bucket int, body binary, more binary"
_KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
_FOUND = "k binary, copies long, at binary, h binary"
OUT = ("_n_words", "_n_removed", "_kept_sha256", "_longest")


def _table(rows: list[tuple], spec: str, kinds) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in kinds]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in spec.split(", ")])


def _of_texts(size: int):
    """Keys, copies and number of windows of each row; place and hash of all windows, of rows of texts."""

    def run(batches):
        for b in sliced(batches):
            w = Words(utf8(b.column("text")))
            at = np.flatnonzero(w.inside(size))
            doc = w.doc[at]
            yield b.column("k").to_pylist(), np.ones(b.num_rows, np.int64), np.bincount(doc, minlength=b.num_rows), (at - w.first[doc]).astype(np.int32), w.windows(size)[at]

    return run


def _of_halves(gap: int):
    """The same of a level's rows: windows whose second half starts gap words after the first, where both survived."""

    def run(batches):
        for b in sliced(batches, "h"):
            at = np.frombuffer(b"".join(b.column("at").to_pylist()), np.int32)
            h = np.frombuffer(b"".join(b.column("h").to_pylist()), np.uint64)
            doc = np.repeat(np.arange(b.num_rows), pc.binary_length(b.column("at")).to_numpy() // 4)
            place = (doc << 32) + at
            other = np.searchsorted(place, place + gap)
            one = np.flatnonzero(place[np.minimum(other, len(place) - 1)] == place + gap) if len(place) else other
            both = mix(h[one] * _HALVES[0] + h[other[one]] * _HALVES[1] + np.uint64(1))
            yield b.column("k").to_pylist(), b.column("copies").to_numpy(), np.bincount(doc[one], minlength=b.num_rows), at[one], both

    return run


def _scatter(windows, buckets: int, width: int):
    """Rows of a piece: its distinct hashes by bucket; bucket -1 has its keys, places and the hashes it has twice."""

    def piece(key: int, held: list[tuple]) -> pa.RecordBatch:
        keys = [k for x in held for k in x[0]]
        copies, count, at, h = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4))
        some = np.flatnonzero(count)
        if not len(some):
            return _table([], _ROWS, _KINDS)
        many = np.repeat(copies > 1, count)
        order = np.argsort(h)
        sorted_ = h[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]]
        heads = np.flatnonzero(new)
        first = order[heads].astype(np.uint32)
        twice = (np.diff(np.r_[heads, len(h)]) > 1) | np.logical_or.reduceat(many[order], heads)
        again = order[~new].astype(np.uint32)
        of = first[np.cumsum(new)[~new] - 1]
        value = sorted_[heads]
        bucket = (value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edges = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
        low = value.view(np.uint8).reshape(-1, 8)[:, :width]
        own = pickle.dumps((copies[some], count[some].astype(np.int32), np.diff(at, prepend=np.int32(0)), again, of))
        rows = [(key, -1, b"".join(keys[i] for i in some.tolist()), zstandard.ZstdCompressor(level=3).compress(own))]
        short = first.view(np.uint8).reshape(-1, 4)[:, : 3 if len(h) < 1 << 24 else 4]
        for i in range(buckets):
            a, z = edges[i], edges[i + 1]
            if a < z:
                rows.append((key, i, low[a:z].tobytes(), np.packbits(twice[a:z]).tobytes() + short[a:z].tobytes()))
        return _table(rows, _ROWS, _KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = TaskContext.get().partitionId() << 32, [], 0
        for x in windows(batches):
            held.append(x)
            n += len(x[3])
            if n >= PIECE:
                yield piece(key, held)
                key, held, n = key + 1, [], 0
        if held:
            yield piece(key, held)

    return run


def _wider(raw: bytes, width: int, kind) -> np.ndarray:
    """Little-endian numbers of width bytes."""
    size = np.dtype(kind).itemsize
    out = np.zeros((len(raw) // width, size), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(kind).ravel()


def _decide(width: int):
    """Rows in order of bucket become the places and hashes that are repeated; rows of bucket -1 pass."""

    def verdicts(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        low = [_wider(r[2], width, np.uint64) for r in rows]
        n = [len(x) for x in low]
        twice = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=m).astype(bool) for r, m in zip(rows, n)])
        value = np.concatenate(low)
        order = np.argsort(value)
        sorted_ = value[order]
        heads = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        size = np.diff(np.r_[heads, len(value)])
        hit = np.empty(len(value), bool)
        hit[order] = np.repeat((size > 1) | np.logical_or.reduceat(twice[order], heads), size)
        out, start = [], 0
        top = np.uint64(bucket % (1 << 16)) << np.uint64(8 * NARROW) if width == NARROW else np.uint64(0)
        for r, m in zip(rows, n):
            mine = hit[start : start + m]
            if mine.any():
                flags = -(-m // 8)
                place = _wider(r[3][flags:], (len(r[3]) - flags) // m, np.uint32)
                out.append((r[0], bucket, place[mine].tobytes(), (value[start : start + m][mine] | top).tobytes()))
            start += m
        return _table(out, _ROWS, _KINDS)

    def run(batches):
        held = []
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("piece", "bucket", "body", "more")]):
                if r[1] < 0:
                    yield _table([r], _ROWS, _KINDS)
                    continue
                if held and held[0][1] != r[1]:
                    yield verdicts(held[0][1], held)
                    held = []
                held.append(r)
        if held:
            yield verdicts(held[0][1], held)

    return run


def _assemble(piece: pa.Table) -> pa.Table:
    """A piece's rows with repeated windows: key, copies, places and hashes."""
    own, told = [], []
    for r in zip(*[piece.column(c).to_pylist() for c in ("bucket", "body", "more")]):
        (own if r[0] < 0 else told).append(r)
    if len(own) != 1:
        raise ValueError("a piece's windows and its keys don't belong together: the input changed between two reads")
    keys = own[0][1]
    copies, count, step, again, of = pickle.loads(zstandard.ZstdDecompressor().decompress(own[0][2]))
    place = np.frombuffer(b"".join(r[1] for r in told), np.uint32)
    value = np.frombuffer(b"".join(r[2] for r in told), np.uint64)
    order = np.argsort(place)
    place, value = place[order], value[order]
    if len(again):
        value = np.concatenate([value, value[np.searchsorted(place, of)]])
        place = np.concatenate([place, again])
        order = np.argsort(place)
        place, value = place[order], value[order]
    doc = np.searchsorted(np.cumsum(count), place, "right")
    at = np.cumsum(step, dtype=np.int32)[place].tobytes()
    value = value.tobytes()
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    edges = [*heads.tolist(), len(doc)]
    rows = [(keys[KEY * d : KEY * d + KEY], int(copies[d]), at[4 * a : 4 * z], value[8 * a : 8 * z]) for d, a, z in zip(doc[heads].tolist(), edges, edges[1:])]
    return pa.Table.from_batches([_table(rows, _FOUND, (pa.binary(), pa.int64(), pa.binary(), pa.binary()))])


def _survivors(rows: DataFrame, windows, n: int, width: int) -> DataFrame:
    """(k, copies, at, h) of the texts with repeated windows among some n; rows of texts (NARROW) may be copies."""
    buckets = max(BUCKETS, -(-n // BUCKET))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(_scatter(windows, buckets, width), _ROWS)
    dealt = sent.repartitionById(parts, F.pmod(F.when(F.col("bucket") < 0, F.hash("piece")).otherwise(F.col("bucket")), F.lit(parts)).cast("int"))
    # written here, so that the large exchange is gone before what comes back is dealt by piece
    told = stage(dealt.sortWithinPartitions("bucket").mapInArrow(_decide(width), _ROWS), "dedup-told")
    found = told.groupBy("piece").applyInArrow(_assemble, _FOUND)
    found = found.groupBy("k").agg(F.sum("copies").alias("copies"), F.first("at").alias("at"), F.first("h").alias("h")) if width == NARROW else found
    alive = stage(found, "dedup-level")
    discard(told)
    return alive


def repeated_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of rows (k, text): each distinct text with a repeated window as (k, at, longest): the places of all its repeated
    windows as packed 32-bit integers, and the largest doubled length at which it has one."""
    half = max(1, window - window // 2)
    n = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    alive = _survivors(texts, _of_texts(half), n // 6, NARROW)
    levels, gap = [(half, alive)], window - half or window
    while n := alive.agg(F.sum(F.length("h") / WIDE).cast("long")).first()[0] or 0:
        alive = _survivors(alive, _of_halves(gap), n, WIDE)
        gap += levels[-1][0]
        levels.append((gap, alive))
    asked = [x for x in levels if x[0] >= window] or levels[-1:]
    longest = asked[0][1].select("k", F.lit(asked[0][0]).alias("size"))
    for size, level in asked[1:]:
        longest = longest.unionByName(level.select("k", F.lit(size).alias("size")))
    longest = longest.groupBy("k").agg(F.max("size").cast("long").alias("longest"))
    marks = stage(asked[0][1].select("k", "at").join(longest, "k"), "dedup-marks")
    discard(*[level for _, level in levels])
    return marks


def _finish(window: int, fields: list[str], schema: pa.Schema):
    """Take out the words that repeated windows cover."""

    def run(batches):
        for b in sliced(batches):
            texts = utf8(b.column("text"))
            w = Words(texts)
            marks = utf8(b.column("at"))
            doc = np.repeat(np.arange(len(texts)), [len(x) // 4 for x in marks])
            gone = covered(len(w.hash), np.frombuffer(b"".join(marks), np.int32) + w.first[doc], window)
            raw, kept, digest = w.raw, [], []
            null = b.column("text").is_null().to_pylist()
            for i in range(b.num_rows):
                a, z = w.first[i], w.first[i + 1]
                if gone[a:z].any():
                    stay = np.flatnonzero(~gone[a:z]) + a
                    text = b" ".join([raw[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist())])
                    kept.append(text)
                else:
                    text = b" ".join(texts[i].split())
                    kept.append(None if null[i] else texts[i])
                digest.append(hashlib.sha256(text).hexdigest())
            dropped = np.bincount(w.doc, gone, len(texts)).astype(np.int64)
            longest = pc.fill_null(b.column("longest"), 0)
            out = {f: b.column(f) for f in fields} | dict(zip(("_text", *OUT), (pa.array(kept, pa.binary()).cast(pa.string()), pa.array(w.n.astype(np.int64)), pa.array(dropped), pa.array(digest), longest)))
            yield pa.record_batch([out[n].cast(t) if out[n].type != t else out[n] for n, t in zip(schema.names, schema.types)], names=schema.names)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with repeated windows' words removed from the text column.

    Adds _n_words, _n_removed, _kept_sha256 (kept words joined by one space) and _longest, the largest doubled length
    with a repeated window (window itself if only that; 0 if none). Untouched texts stay as they are; others become
    their kept words joined by a space. Null and empty texts, and texts under `window` words, lose nothing. Equal rows
    count as copies and lose every window. An empty table stays empty. Other columns pass through under any name; those
    named like the four added ones are replaced. docs is read twice, and again if an executor is lost, so it should be a
    table rather than a random draw.
    """
    body = column(docs, text)
    marks = repeated_windows(docs.select(text_key(body).alias("k"), body.alias("text")), window)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in OUT}
    keep = [f for c, f in names.items() if c != text]
    wide = docs.select(*[column(docs, c).alias(f) for c, f in names.items()], text_key(body).alias("k"), body.alias("text"))
    # the hint keeps one plan at all sizes; a text with very many copies is split by AQE's skew join
    whole = wide.join(marks.hint("merge"), "k", "left").select(*keep, "text", "at", "longest")
    done_type = whole.select(*keep).schema
    for name, kind in zip(("_text", *OUT), (T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.LongType())):
        done_type = done_type.add(name, kind)
    done = whole.mapInArrow(_finish(window, keep, to_arrow_schema(done_type)), done_type)
    return done.select(*[(F.col("_text") if c == text else F.col(f)).alias(c) for c, f in names.items()], *OUT)
