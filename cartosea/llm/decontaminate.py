"""Benchmark decontamination by the CGK embedding and bit-sampling LSH.

The CGK random walk reads a window of words with a pointer that moves on or stays by a random bit of (step, word) and
writes the word under it at every step; windows at edit distance k get strings at Hamming distance O(k) with good
probability, since the walks of two edited windows fall in step again. Windows of the texts start at every `STRIDE`-th
word and reach as far as the walk goes, at most an item's size; an item contributes its tails from each word of its
first half, so that several windows inside a leaked passage start where a tail does.

`ROUNDS` repetitions, each with a walk of its own, sample `BITS` steps of the walk's first 12, 15, 18, ... steps, hash
the words there and look for tails with the same hash: the early rounds stand many edits, the late ones tell apart
better. Two exact look-ups stand beside the walks. Any unedited item of `SHORT` words or more holds `STRIDE` whole words
from some `STRIDE`-th word of the text on, which are looked up too. Items under `SHORT` words have too few tails for the
walks; they are cut into one piece more than they may have edits, so that one piece is unedited, and the pieces are
looked up at every word of the text. What is found is verified: the item's words are aligned to the text around the
window by edit distance, and the text leaks the item if that is at most (100 - percent) % of the item's words. The tests
measure the recall on edited items.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.llm.common import column, sliced, stage, text_key
from cartosea.llm.wordhash import Words, mix

PERCENT, STRIDE, ROUNDS, BITS, SHORT = 80, 8, 12, 4, 30
#: Items held by each worker at a time; a larger benchmark goes over the texts in blocks of so many.
ITEMS = 20_000
_U = np.uint64
_LONG = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-case words of letters and digits."""
    return "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFC", text or "").lower()).split()


def _samples(rnd: int) -> list[int]:
    """The sampled steps of a round: one from each quarter of its walk."""
    parts = np.array_split(np.arange(12 + 3 * rnd), BITS)
    rng = np.random.default_rng(rnd)
    return [int(rng.choice(x)) for x in parts]


def _need(rnd: int) -> int:
    """Words that a tail must have for a round: what the walk reads up to its last sample, but for rare luck."""
    n = _samples(rnd)[-1] + 1
    return int(n / 2 + 1.3 * np.sqrt(n)) + 1


def embed(code: np.ndarray, start: np.ndarray, stop: np.ndarray, rnd: int) -> np.ndarray:
    """Hash of a round's sampled steps for the window from each start; past stop it reads nothing."""
    samples = _samples(rnd)
    odd = mix(np.arange(1, samples[-1] + 2, dtype=_U) * _LONG + _U(rnd)) | _U(1)
    padded = np.append(code, _U(0))
    none = len(code)
    at, out = start.copy(), np.full(len(start), rnd + 1, _U)
    for step in range(samples[-1] + 1):
        here = padded[np.where(at < stop, at, none)]
        if step in samples:
            out = mix(out * _LONG + here + _U(step))
        at += ((here * odd[step]) >> _U(63)).astype(np.int64)
    return out


class _Keys:
    """Sorted hashes with the item and the shift in it that each stands for."""

    def __init__(self, h: np.ndarray, item: np.ndarray, shift: np.ndarray):
        order = np.argsort(h)
        self.h, self.item, self.shift = h[order], item[order], shift[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.h >> _U(44)).astype(np.int64)] = True

    def match(self, h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window's start, word index where the item would start, item) for each window's hash h that is a key."""
        hit = np.flatnonzero(self.seen[(h >> _U(44)).astype(np.int64)])
        a, z = np.searchsorted(self.h, h[hit]), np.searchsorted(self.h, h[hit], side="right")
        n = z - a
        flat = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(start[hit], n)
        return at, at - self.shift[flat], self.item[flat]


class Index:
    """The hashes of the items' tails in every round, of their unedited words and of the short ones' pieces."""

    def __init__(self, ids: list[int], texts: list[str], percent: int = PERCENT):
        words = [words_of(t) for t in texts]
        keep = [i for i, w in enumerate(words) if w]
        self.ids = [ids[i] for i in keep]
        self.words = [words[i] for i in keep]
        raw = Words([" ".join(w).encode() for w in self.words])
        self.codes = [raw.hash[a:z] for a, z in zip(raw.first[:-1], raw.first[1:])]
        self.size = size = raw.n
        self.most = (100 - percent) * size // 100
        # what stands in an item, to tell at once that too much of it is missing
        self.own = np.unique(self._code(raw.hash, raw.doc))
        first = raw.first[:-1]
        tails = np.where(size < SHORT, 0, size // 2)
        item = np.repeat(np.arange(len(size)), tails)
        shift = np.arange(len(item)) - np.repeat(np.cumsum(tails) - tails, tails)
        rest = size[item] - shift
        start, stop = first[item] + shift, raw.first[1:][item]
        self.plain = None
        own = np.flatnonzero(shift < STRIDE)
        if len(own):
            self.plain = _Keys(raw.windows(STRIDE)[start[own]], item[own], shift[own])
        # only a tail that is long enough for a round, so that it reads no end
        self.rounds = []
        for r in range(ROUNDS):
            own = np.flatnonzero(rest >= _need(r))
            if len(own):
                self.rounds.append((r, _Keys(embed(raw.hash, start[own], stop[own], r), item[own], shift[own])))
        pieces: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(size < SHORT).tolist():
            for part in np.array_split(np.arange(size[i]), min(self.most[i] + 1, size[i])):
                pieces.setdefault(len(part), []).append((i, int(part[0])))
        self.pieces = []
        for k, found in sorted(pieces.items()):
            item, shift = np.array(found).T
            self.pieces.append((k, _Keys(raw.windows(k)[first[item] + shift], item, shift)))

    @staticmethod
    def _code(word: np.ndarray, item: np.ndarray) -> np.ndarray:
        return mix(word + (item.astype(_U) + _U(1)) * _LONG)

    def _close(self, w: Words, doc: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether enough of each item's words stand in the text where it would, give or take its edits."""
        good = np.zeros(len(at), bool)
        step = 20_000
        for a in range(0, len(at), step):
            d, i = doc[a : a + step], item[a : a + step]
            low, high = at[a : a + step] - self.most[i], at[a : a + step] + self.size[i] + self.most[i]
            where = low[:, None] + np.arange((high - low).max())
            inside = (where >= w.first[:-1][d][:, None]) & (where < np.minimum(high, w.first[1:][d])[:, None])
            row, _ = np.nonzero(inside)
            code = self._code(w.hash[where[inside]], i[row])
            slot = np.minimum(np.searchsorted(self.own, code), len(self.own) - 1)
            good[a : a + step] = np.bincount(row, self.own[slot] == code, len(d)) >= self.size[i] - self.most[i]
        return good

    def candidates(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, word index where the item would start, item) of the hash matches."""
        none = np.zeros(0, np.int64)
        if not len(w.hash) or not self.ids:
            return none, none, none
        start = np.flatnonzero((np.arange(len(w.hash)) - w.first[:-1][w.doc]) % STRIDE == 0)
        end = w.first[1:][w.doc[start]]
        found = []
        if self.plain:
            whole = start[start + STRIDE <= end]
            by, at, item = self.plain.match(w.windows(STRIDE)[whole], whole)
            found.append(np.stack([w.doc[by], at, item], 1))
        for r, keys in self.rounds:
            by, at, item = keys.match(embed(w.hash, start, end, r), start)
            found.append(np.stack([w.doc[by], at, item], 1))
        for k, keys in self.pieces:
            whole = np.flatnonzero(w.inside(k))
            by, at, item = keys.match(w.windows(k)[whole], whole)
            close = self._close(w, w.doc[by], at, item)
            found.append(np.stack([w.doc[by], at, item], 1)[close])
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        return both[:, 0], both[:, 1], both[:, 2]


def edit_within(text: np.ndarray, item: np.ndarray, most: int) -> tuple[int, int, int]:
    """(distance, begin, end) of the stretch of text that is closest to item by word edits; distance most + 1 if none is
    within most. Ties: the earliest end, then the shortest stretch."""
    m = len(item)
    row, origin = np.arange(m + 1), np.zeros(m + 1, np.int64)
    best = (int(row[m]), 0, 0)
    for j, c in enumerate(text):
        diag = row[:-1] + (item != c)
        up = row[1:] + 1
        take = np.minimum(diag, up)
        source = np.where(diag <= up, origin[:-1], origin[1:])
        new, begun = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        new[0], begun[0] = 0, j + 1
        # insertions along the item: running minimum of take - position
        shifted = np.concatenate([[0], take - np.arange(1, m + 1)])
        low = np.minimum.accumulate(shifted)
        new[1:] = low[1:] + np.arange(1, m + 1)
        first = np.maximum.accumulate(np.where(shifted == low, np.arange(m + 1), 0))
        begun = np.concatenate([[j + 1], source])[first]
        row, origin = new, begun
        if row[m] < best[0]:
            best = (int(row[m]), int(origin[m]), j + 1)
    return best if best[0] <= most else (most + 1, 0, 0)


_FOUND = "k binary, item_id long, distance int, begin long, stop long"


def _search(index: Index, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            plain = [" ".join(words_of(t)).encode() for t in b.column("text").to_pylist()]
            w = Words(plain)
            keys, rows, done, equal = b.column("k").to_pylist(), set(), set(), set()
            for d, at, i in zip(*(x.tolist() for x in index.candidates(w))):
                code = index.codes[i]
                most = (100 - percent) * len(code) // 100
                mark = (d, i, at // (most + STRIDE))  # starts that hint at one stretch are aligned once
                if mark in done or (d, i) in equal:  # nothing is closer than an unedited passage
                    continue
                done.add(mark)
                low, high = int(w.first[d]), int(w.first[d + 1])
                slack = 2 * most + 2 * STRIDE
                x, y = max(low, at - slack), min(high, at + len(code) + slack)
                if (~np.isin(code, w.hash[x:y])).sum() > most:  # so many words are missing that no alignment is near
                    continue
                dist, s, e = edit_within(w.hash[x:y], code, most)
                if dist <= most:
                    rows.add((keys[d], index.ids[i], dist, x + s - low, x + e - low))
                    if dist == 0:
                        equal.add((d, i))
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _passages(docs: DataFrame, benchmark: DataFrame, text: str, percent: int) -> DataFrame:
    """(k, item_id, distance, begin, stop) of the passages of each distinct text that leak an item, up to an unedited one."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null").distinct()
    numbered = stage(items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, -(-items.count() // ITEMS))))), "leak-items")
    body = column(docs, text)
    slim = docs.select(text_key(body).alias("k"), F.coalesce(body, F.lit("")).alias("text"))
    out = None
    for (part,) in sorted(numbered.select("part").distinct().collect()):
        rows = numbered.where(F.col("part") == part).orderBy("i", "t").collect()
        index = spark.sparkContext.broadcast(Index([r["i"] for r in rows], [r["t"] for r in rows], percent))
        here = slim.mapInArrow(lambda it, index=index: _search(index.value, percent)(it), _FOUND)
        out = here if out is None else out.unionByName(here)
    return spark.createDataFrame([], _FOUND) if out is None else out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, item_id and distance (word edits of the closest passage) for each row of docs and item that it leaks.

    Texts and items are compared as lower-case words of letters and digits. Items without words leak nowhere; equal items
    of several ids are all reported; null and empty texts leak nothing; equal rows are reported once each.
    """
    found = stage(_passages(docs, benchmark, text, percent).groupBy("k", "item_id").agg(F.min("distance").alias("distance")), "leaks")
    rows = docs.select(column(docs, id).alias(id), text_key(column(docs, text)).alias("k"))
    return rows.join(found, "k").select(id, "item_id", "distance")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without the rows that leak an item."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    wide = docs.select(*[column(docs, c).alias(f) for c, f in zip(docs.columns, names)])
    at = dict(zip(docs.columns, names))
    found = stage(_passages(wide, benchmark, at[text], percent).select("k").distinct(), "leaks")
    left = wide.withColumn("k", text_key(F.col(at[text]))).join(found, "k", "left_anti")
    return left.select(*[F.col(f).alias(c) for c, f in at.items()])
