"""Document fingerprints from prefix polynomial hashes.

A slice of texts has one array of prefix sums of (code point + 1) * base**place modulo a prime, for two bases. Two
entries give the hash of any span, whatever its place, so spans of any two texts compare at once, and the longest common
extension of two places is found by binary search. A text's fingerprint is a sample of its prefix array: at multiples of
the least power of two that gives at most GRID of them, and behind windows of 16 code points whose hash has so many
trailing zeros that at most ANCHORS have them. Both samples nest, so that fingerprints of texts of any two lengths meet
at the coarser one's places, and any two places of a fingerprint give the hash of the span between them: likeness()
finds the common prefix and then, from anchor to anchor, the longest common extensions, by binary search.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartosea.llm.common import column, sliced
from cartosea.llm.shards import cuts, dealt, shard_of

P = (1 << 31) - 1
#: Fixed bases, drawn at random below P.
BASES = (1_450_723_913, 938_114_567)
GRID, ANCHORS, WINDOW = 32, 32, 16
#: Zeros of every anchor's window hash at least: some 16 places between anchors, so that few spans agree by chance.
SPARSE = 4
#: Bytes of text of a shard, and code points that a worker hashes at a time (one long text may exceed it).
SHARD, BATCH = 32 << 20, 1 << 20
_POWERS: list[list[np.ndarray]] = []


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo P for x below 2**62; P is 2**31 - 1."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x == P, 0, x)


def powers(n: int) -> list[list[np.ndarray]]:
    """For each base, its powers and its inverse's, from 0 to n at least; kept by the worker."""
    if not _POWERS:
        _POWERS.extend([np.ones(1, np.int64), np.ones(1, np.int64)] for _ in BASES)
    for b, both in zip(BASES, _POWERS):
        for k, base in enumerate((b, pow(b, P - 2, P))):
            while len(both[k]) <= n:
                both[k] = np.concatenate([both[k], _mod(both[k] * pow(base, len(both[k]), P))])
    return _POWERS


class Prefixes:
    """Prefix arrays of one or several texts, one after another; text i has the places from edges[i] to edges[i + 1]."""

    def __init__(self, texts: list[str]):
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.edges = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
        c = (np.concatenate(points) if points else np.zeros(0, np.uint32)).astype(np.int64) + 1
        self.sums = [np.concatenate([[0], _mod(np.cumsum(_mod(c * up[: len(c)])))]) for up, _ in powers(len(c))]

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """62-bit hash of each span: equal spans have equal ones wherever they stand."""
        one, two = (_mod(_mod(s[stop] - s[start] + P) * down[start]) for s, (_, down) in zip(self.sums, powers(len(self.sums[0]))))
        return one << 31 | two

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n code points from a and from b are the same."""
        return self.spans(a, a + n) == self.spans(b, b + n)

    def extensions(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The longest common extension of each two places, limit at most, by binary search."""
        low, high = np.zeros_like(limit), limit.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a, b, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def fingerprints(self) -> list[str]:
        """Each text's fingerprint."""
        size, ends = len(self.sums[0]) - 1, self.edges
        level = np.zeros(0, np.int8)
        if size >= WINDOW:
            at = np.arange(size - WINDOW + 1)
            h = self.spans(at, at + WINDOW)
            h = (h ^ (h >> 29)) * 0x2545F4914F6CDD1D  # wraps around
            h = h ^ (h >> 32)
            low = (h & -h).astype(np.uint64)
            level = np.where(low == 0, 63, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int8)
        return [self._fingerprint(int(a), int(z), level[a : max(a, z - WINDOW + 1)]) for a, z in zip(ends, ends[1:])]

    def _fingerprint(self, a: int, z: int, level: np.ndarray) -> str:
        n = z - a
        stride = max(0, (-(-n // GRID) - 1).bit_length()) if n else 0
        grid = np.arange(1 << stride, n + 1, 1 << stride) if n else np.zeros(0, np.int64)
        with_ = np.bincount(level, minlength=1)[::-1].cumsum()[::-1] if len(level) else np.zeros(1, np.int64)
        least = max(SPARSE, int(np.argmax(with_ <= ANCHORS)) if with_[-1] <= ANCHORS else len(with_))
        found = np.flatnonzero(level >= least)
        anchors = found + WINDOW
        place = np.concatenate([[n], grid, anchors])
        h = self.spans(np.full(len(place), a), a + place)
        head = np.array([n, stride, least, len(grid)], np.int64)
        return base64.b64encode(head.tobytes() + h.astype("<i8").tobytes() + anchors.astype("<i8").tobytes() + level[found].tobytes()).decode()


class Fingerprint:
    """A fingerprint's parts."""

    def __init__(self, text: str):
        raw = base64.b64decode(text)
        self.n, self.stride, self.least, grid = np.frombuffer(raw, "<i8", 4).tolist()
        k = (len(raw) - 8 * (5 + grid)) // 17
        h = np.frombuffer(raw, "<i8", 1 + grid + k, 32)
        self.whole, self.grid, self.sums = int(h[0]), h[1 : 1 + grid], h[1 + grid :]
        self.anchors = np.frombuffer(raw, "<i8", k, 32 + h.nbytes)
        self.level = np.frombuffer(raw, np.int8, k, 32 + h.nbytes + 8 * k)

    def at(self, stride: int) -> np.ndarray:
        """Prefix hashes at multiples of 2**stride, from the first."""
        step = 1 << (stride - self.stride)
        return self.grid[step - 1 :: step]

    def from_anchors(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of level least or higher, and prefix hashes there."""
        keep = self.level >= least
        return self.anchors[keep], self.sums[keep]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many prefix hashes agree from the first on, by binary search: prefixes of equal prefixes are equal."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[middle - 1] == b[middle - 1] else (low, middle - 1)
    return low


#: Places up to which likeness() takes inverse powers from the worker's table.
_TABLE = 1 << 22


class _Spans:
    """Hashes of spans between a fingerprint's anchors."""

    def __init__(self, place: np.ndarray, sums: np.ndarray):
        self.place = place.tolist()
        if self.place and self.place[-1] < _TABLE:
            down = [both[1][place].tolist() for both in powers(self.place[-1])]
        else:
            down = [[pow(pow(b, P - 2, P), x, P) for x in self.place] for b in BASES]
        self.sides = list(zip(((sums >> 31).tolist(), (sums & P).tolist()), down))

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """Length and hash of the span from anchor i to anchor j."""
        return self.place[j] - self.place[i], *[(s[j] - s[i]) * d[i] % P for s, d in self.sides]


def _run(x: _Spans, i: int, y: _Spans, j: int) -> int:
    """How many anchors on the spans from i and from j are the same, by binary search; 1 at least is known."""
    low, high = 1, min(len(x.place) - i, len(y.place) - j) - 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x.span(i, i + middle) == y.span(j, j + middle) else (low, middle - 1)
    return low


def likeness(one: str, two: str) -> float:
    """Share of the longer text that both are known to have in common, 0 to 1: their common prefix up to the last grid
    place, then longest common runs of spans between anchors, of WINDOW code points at least. 1 for equal fingerprints; symmetric."""
    if one == two:
        return 1.0
    f, g = Fingerprint(min(one, two)), Fingerprint(max(one, two))
    if not f.n or not g.n:
        return 0.0
    stride = max(f.stride, g.stride)
    prefix = _common(f.at(stride), g.at(stride)) << stride
    least = max(f.least, g.least)
    x, y = _Spans(*f.from_anchors(least)), _Spans(*g.from_anchors(least))
    first = {y.span(j, j + 1): j for j in range(len(y.place) - 2, -1, -1)}
    covered, i = prefix, 0
    while i < len(x.place) - 1:
        j = first.get(x.span(i, i + 1)) if x.place[i + 1] > prefix else None
        if j is None:
            i += 1
            continue
        to = i + _run(x, i, y, j)
        if x.place[to] - x.place[i] >= WINDOW:
            covered += x.place[to] - max(prefix, x.place[i])
        i = to
    return min(covered, f.n, g.n) / max(f.n, g.n)


def add_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column fingerprint of its whole texts; a null text is empty. Equal texts, and no others but by chance
    (1 in 2**62 a pair, times the length), have equal ones. An older column of that name gives way."""
    keep = [c for c in docs.columns if c != "fingerprint"]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            prints = Prefixes([t or "" for t in b.column(text).to_pylist()]).fingerprints()
            yield pa.record_batch([*[b.column(c) for c in keep], pa.array(prints, pa.string())], names=[*keep, "fingerprint"])

    return docs.select(*[column(docs, c) for c in keep]).mapInArrow(run, schema)


@F.pandas_udf(T.DoubleType())
def likeness_of(one: pd.Series, two: pd.Series) -> pd.Series:
    """likeness() of two columns of fingerprints; null where either is."""
    return pd.Series([likeness(a, b) if a is not None and b is not None else None for a, b in zip(one, two)], dtype="float64")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shards in order; a row of the kind tail only says which text follows its shard."""
    held: list[tuple[int | None, str]] = []
    points, now = 0, None

    def flush(after: str) -> pa.RecordBatch:
        texts = [t for _, t in held]
        edited = [_edited(a, b) for a, b in zip(texts, [*texts[1:], after])]
        prints = Prefixes([*texts, after, *edited]).fingerprints()
        own, changed = prints[: len(texts) + 1], prints[len(texts) + 1 :]
        cols = [[i for i, _ in held], [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], own[:-1], changed, list(map(likeness, own, changed)), list(map(likeness, own, own[1:]))]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in _OUT.split(", ")])

    for b in sliced(batches, "text"):
        for shard, tail, doc, text in zip(*[b.column(c).to_pylist() for c in ("shard", "tail", "doc_id", "text")]):
            text = text or ""
            if shard != now:
                now, points = shard, 0
            elif not tail and points > BATCH:
                yield flush(text)
                held, points = [], 0
            if not tail:
                held.append((doc, text))
                points += len(text)
            elif held:  # the first tail row; copies of it follow at most
                yield flush(text)
                held, points = [], 0


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness to the
    edited text) and near_next (to the next row's text), where the edited text has the first floor(n_chars / 2) code points
    of the next row, or all of a shorter one, for its own last floor(n_chars / 2).

    Rows go by descending doc_id, null ones last, equal ones by descending hash of the text; after the last comes the
    first, and a single row is its own next. A null text is empty; other columns are ignored; an empty table gives none.
    Shards of rows in order are cut by bytes, and each is also dealt the first row of the shard that follows.
    """
    own = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").alias("text"))
    keyed = own.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    tie, low = F.col("tie"), F.lit(-(2**63))
    found = cuts(keyed, F.col("doc_id"), tie, F.coalesce(F.octet_length("text"), F.lit(0)) + 64, SHARD)
    numbered = keyed.withColumn("shard", shard_of(found)(F.col("doc_id"), tie))
    # each shard's first row, some 30 bytes a shard: its text ends the shard before it
    heads = sorted(numbered.groupBy("shard").agg(F.max(F.struct(F.coalesce("doc_id", low).alias("i"), F.col("tie").alias("h"))).alias("head")).collect(), key=lambda r: -r["shard"])
    before = [(r["head"]["i"], r["head"]["h"], heads[k - 1]["shard"]) for k, r in enumerate(heads)]
    ends = docs.sparkSession.createDataFrame(before, "i long, h long, ends int")
    marked = numbered.join(F.broadcast(ends), (F.coalesce("doc_id", low) == F.col("i")) & (F.col("tie") == F.col("h")), "left")
    places = F.when(F.col("ends").isNull(), F.array(F.struct(F.col("shard"), F.lit(False).alias("tail")))).otherwise(F.array(F.struct(F.col("shard"), F.lit(False).alias("tail")), F.struct(F.col("ends").alias("shard"), F.lit(True).alias("tail"))))
    rows = marked.select(F.explode(places).alias("p"), "doc_id", "tie", "text").select("p.shard", "p.tail", "doc_id", "tie", "text")
    order = ["tail", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    return dealt(rows, len(found[0]) + 1, order).mapInArrow(_compare, _OUT)
