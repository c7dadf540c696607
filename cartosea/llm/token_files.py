"""Token-id files with an adaptive context-mixing range coder.

A shard file holds the ids of a range of documents as numbers of phrases (the ids of one pre-token) and, before them, the
phrases' own ids, both in blocks of `BLOCK` numbers at most that can each be read alone: a block starts with empty
statistics and has its own CRC-32. Each number is coded in two steps. First: is it what the order-2 context (the two
numbers before) or the order-1 context saw last, or neither? The two predictions have adaptive confidences, which are
mixed into one distribution over those answers and, where both are wrong, over the number's order-0 group, by the block's
own counts. Then the place within its group, whose numbers are about equally frequent in the file. A block is cut into
lanes that are coded side by side, an array element each, by a carrying range coder of 48 bits; they share the block's
statistics, which a step brings up to date for all of them, and distributions are made anew every `REFRESH` steps.

File: magic, a zstandard-packed JSON header (documents, sizes, alphabet, weights, blocks), the phrases' lengths, then the
blocks' bytes: the words of all lanes in the order in which a reader needs them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from cartosea.llm import files, shards
from cartosea.llm.common import LONG_WORD, column, discard, sliced, stage, workspace

VOCABULARY, END = "word_bpe_49k.json", 2
MAGIC = b"CMRC0003"
#: Numbers of a block, its lanes at most and numbers of a lane at least, steps between two updates of distributions, bits of
#: the context tables of order 2 and 1, members of a group at most, a group's least share of 2^14.
BLOCK, LANES, LANE, REFRESH, TABLES, MEMBERS, LEAST = 1 << 20, 4096, 64, 8, (17, 16), 1 << 14, 8
#: Ids and phrases in a file, bytes of text in a shard and in a slice, about: bound what a worker holds and what a task does.
FILE_IDS, FILE_PHRASES, SHARD_BYTES, SLICE, CACHE = 12 << 20, 500_000, 24 << 20, 8 << 20, 200_000
_TOP, _SHARE = 16, 14
_ONE, _ALL = 1 << _TOP, 1 << _SHARE
_INT = np.int64


def _weight(count: np.ndarray) -> np.ndarray:
    """Quarters of a binary logarithm."""
    return np.rint(4 * np.log2(count)).astype(_INT)


class _Letters:
    """Numbers from 0, most frequent first, in groups of equal weight: the static part of order 0."""

    def __init__(self, weight: np.ndarray):
        """weight falls; it holds quarters of a binary logarithm of each number's count."""
        new = np.r_[True, weight[1:] != weight[:-1]][: len(weight)]
        at = np.arange(len(weight))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % MEMBERS == 0
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.first, len(weight)])
        self.group = np.cumsum(new) - 1
        self.mass = np.rint(2.0 ** (weight[self.first] / 4)).astype(_INT) * self.size


#: What an entry's confidence goes up or down by, at 0 to 7 after a miss and then after a hit; at 0 and 1 a miss replaces it.
_CHANGE = np.array([0, 0, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], np.int32)


class _Model:
    """A block's statistics. A table's entry is (number + 1) * 8 + confidence, or 0; a state is both entries' confidences
    and whether they agree, and is counted with its outcome: order 2 was right, order 1 was, neither."""

    def __init__(self, lanes: int, letters: _Letters):
        self.two, self.one = (np.zeros(1 << b, np.int32) for b in TABLES)
        self.a, self.b = np.zeros(lanes, _INT), np.zeros(lanes, _INT)  # hashes of the number before and the one before that
        self.seen = np.zeros((8, 8, 2, 3), _INT)
        for k in range(8):  # what is expected before anything was seen
            self.seen[k, :, :, 0] += k
            self.seen[:, k, 0, 1] += k
        self.seen[..., 2] = 4
        self.count = 1 + 256 * letters.mass // max(1, int(letters.mass.sum()))
        self.fresh, self.escaped = [], []
        self.refresh()

    def refresh(self) -> None:
        """Mix the confidences into edges x and y between the three answers for each state; shares of the groups."""
        if self.fresh:
            self.seen += np.bincount(np.concatenate(self.fresh), minlength=384).reshape(8, 8, 2, 3)
            self.seen[self.seen.sum(3) > 1 << 16] >>= 1
            self.count += np.bincount(np.concatenate(self.escaped), minlength=len(self.count))
            if self.count.sum() > 1 << 20:
                self.count = (self.count + 1) >> 1
            self.fresh, self.escaped = [], []
        c, total = self.seen[..., :2], self.seen.sum(3)
        # each order's own odds by its confidence, then by both: the rarer a state, the more its parts count
        two = (c[..., 0].sum(1) << _TOP) // total.sum(1)
        one = (c[..., 1].sum(0) << _TOP) // total.sum(0)
        x = ((c[..., 0] << _TOP) + 16 * two[:, None]) // (total + 16)
        y = ((c[..., 1] << _TOP) + 16 * one[None]) // (total + 16)
        x = np.clip(x, 16, _ONE - 4096)
        y = x + np.clip(y, 16, _ONE - 2048 - x)
        y[..., 1] = x[..., 1]  # they agree
        self.x, self.y = x.ravel(), y.ravel()
        n = len(self.count)
        if n:
            self.low = np.r_[0, np.cumsum(LEAST + self.count * (_ALL - LEAST * n) // self.count.sum())]
            self.low[-1] = _ALL
            self.find = np.repeat(np.arange(n), np.diff(self.low))

    def predict(self, n: int):
        """Of the first n lanes: places and entries of both contexts, their numbers + 1, the states."""
        a = self.a[:n]
        i2, i1 = ((a + self.b[:n] * 40503) & 0xFFFFFFFF) >> (32 - TABLES[0]), a >> (32 - TABLES[1])
        e2, e1 = self.two.take(i2), self.one.take(i1)
        s2, s1 = e2 >> 3, e1 >> 3
        return i2, i1, e2, e1, s2, s1, ((e2 & 7) << 4) + ((e1 & 7) << 1) + (s2 == s1)

    def learn(self, n: int, was, sym, h2, h1, escaped) -> None:
        """Remember the numbers of a step and count the outcome; escaped has the groups of those that neither context knew."""
        i2, i1, e2, e1, _, _, state = was
        self.fresh.append(state * 3 + np.where(h2, 0, 2 - h1))
        self.escaped.append(escaped)
        new = ((sym + 1) << 3).astype(np.int32)
        for table, i, e, hit in ((self.two, i2, e2, h2), (self.one, i1, e1, h1)):
            k = (e & 7) + (hit.view(np.int8) << 3)
            table[i] = np.where(k > 1, e + _CHANGE.take(k), new)
        self.b[:n] = self.a[:n]
        self.a[:n] = (sym + 1) * 2654435761 & 0xFFFFFFFF


_LOW, _RANGE = (1 << 32) - 1, 1 << 48


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of numbers below 2^52: no quotient of such is closer below a whole number than float64 can tell."""
    return (a / b).astype(_INT)


def _lanes(n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Steps of a block of n numbers, lanes alive in each step, first numbers of the lanes."""
    lanes = max(1, min(LANES, n // LANE))
    size = n // lanes + (np.arange(lanes) < n % lanes)
    steps = int(size[0])
    return steps, np.count_nonzero(size[:, None] > np.arange(max(0, steps - 1), steps), axis=0), np.cumsum(size) - size


def encode_block(ids: np.ndarray, letters: _Letters) -> bytes:
    """Code numbers to bytes."""
    steps, last, begin = _lanes(len(ids))
    lanes, ids = len(begin), ids.astype(_INT)
    model = _Model(lanes, letters)
    low, span = np.zeros(lanes, _INT), np.full(lanes, _RANGE, _INT)
    out = np.zeros((2 * steps + 8, lanes), _INT)
    flat, at, order = out.ravel(), np.arange(lanes), []
    for t in range(steps):
        live = lanes if t + 1 < steps else int(last[0])
        sym = ids.take(begin[:live] + t)
        was = model.predict(live)
        s2, s1, state = was[4:]
        h2, h1 = s2 == sym + 1, s1 == sym + 1
        y = model.y.take(state)
        rest, g = _ONE - y, letters.group.take(sym)
        a, z = y + (rest * model.low.take(g) >> _SHARE), y + (rest * model.low.take(g + 1) >> _SHARE)
        size, place = letters.size.take(g), sym - letters.first.take(g)
        known = h2 | h1
        hit = np.flatnonzero(known)
        if len(hit):
            x, right = model.x.take(state.take(hit)), h2.take(hit)
            a[hit], z[hit] = np.where(right, 0, x), np.where(right, x, y.take(hit))
            size[hit], place[hit] = 1, 0
        lo, r = low[:live], span[:live] >> _TOP
        lo += r * a
        r = _quotient(r * (z - a), size)
        lo += r * place
        span[:live] = r
        small = np.flatnonzero(r <= _LOW)
        while len(small):
            v, where = low.take(small), at.take(small)
            flat[where] = v >> 32
            order.append(where)
            low[small] = (v & _LOW) << 16
            at[small] = where + lanes
            r = span.take(small) << 16
            span[small] = r
            small = small[r <= _LOW]
        model.learn(live, was, sym, h2, h1, g[~known])
        if (t + 1) % REFRESH == 0 or t < REFRESH:
            model.refresh()
    for _ in range(3):  # the rest of low
        flat[at] = low >> 32
        low = (low & _LOW) << 16
        at += lanes
    # carries: words above 16 bits pass their top on to the word before
    carry = np.zeros(lanes, _INT)
    for row in out[int(at.max(initial=0)) // lanes :: -1]:
        row += carry
        carry[:] = row >> 16
        row &= 0xFFFF
    # a reader starts with three words of each lane and then always is three words ahead
    return np.concatenate([flat[: 3 * lanes], *(flat[x + 3 * lanes] for x in order)]).astype(">u2").tobytes()


def decode_block(block: bytes, n: int, letters: _Letters) -> np.ndarray:
    """The n numbers of a block."""
    steps, last, begin = _lanes(n)
    lanes = len(begin)
    words = np.frombuffer(block, ">u2").astype(_INT)
    model = _Model(lanes, letters)
    w = words[: 3 * lanes].reshape(3, lanes)
    code, used, span = (w[0] << 32) | (w[1] << 16) | w[2], 3 * lanes, np.full(lanes, _RANGE, _INT)
    ids = np.zeros(n, np.int32)
    for t in range(steps):
        live = lanes if t + 1 < steps else int(last[0])
        was = model.predict(live)
        s2, s1, state = was[4:]
        y, r, c = model.y.take(state), span[:live] >> _TOP, code[:live]
        got = np.minimum(_quotient(c, r), _ONE - 1)
        rest, t_ = _ONE - y, got - y
        hit = np.flatnonzero(t_ < 0)
        g = model.find.take(_quotient((np.maximum(t_, 0) + 1 << _SHARE) - 1, rest))
        a, z = y + (rest * model.low.take(g) >> _SHARE), y + (rest * model.low.take(g + 1) >> _SHARE)
        size = letters.size.take(g)
        if len(hit):
            x = model.x.take(state.take(hit))
            right = got.take(hit) < x
            a[hit], z[hit], size[hit] = np.where(right, 0, x), np.where(right, x, y.take(hit)), 1
        c -= r * a
        r = _quotient(r * (z - a), size)
        place = np.minimum(_quotient(c, r), size - 1)
        c -= r * place
        span[:live] = r
        sym = letters.first.take(g) + place
        if len(hit):
            sym[hit] = np.where(right, s2.take(hit), s1.take(hit)) - 1
        small = np.flatnonzero(r <= _LOW)
        while len(small):
            code[small] = (code.take(small) << 16) | words[used : used + len(small)]
            used += len(small)
            r = span.take(small) << 16
            span[small] = r
            small = small[r <= _LOW]
        known = t_ < 0
        model.learn(live, was, sym, s2 == sym + 1, s1 == sym + 1, g[~known])
        ids[begin[:live] + t] = sym
        if (t + 1) % REFRESH == 0 or t < REFRESH:
            model.refresh()
    return ids


def _crc(ids: np.ndarray, block: bytes) -> int:
    """Of a block's numbers and bytes: the last words of a lane also have bits that no number needs."""
    return zlib.crc32(block, zlib.crc32(ids.astype("<u4").tobytes()))


def _blocks(ids: np.ndarray, letters: _Letters) -> tuple[list[list[int]], list[bytes]]:
    """Sizes and checksums of ids' blocks, and the blocks."""
    parts = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    done = [encode_block(x, letters) for x in parts]
    return [[len(d), len(x), _crc(x, d)] for d, x in zip(done, parts)], done


def _ranked(number: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of numbers below kinds: those that occur, most frequent first and then in order of their first place; their weights;
    the numbers as places in that list."""
    count, first = np.bincount(number, minlength=kinds), np.zeros(kinds, np.int32)
    first[number[::-1]] = np.arange(len(number), dtype=np.int32)[::-1]
    have = np.flatnonzero(count)
    weight = _weight(count[have])
    order = np.lexsort((first[have], -weight))
    rank = np.zeros(kinds, np.int32)
    rank[have[order]] = np.arange(len(have))
    return have[order], weight[order], rank[number]


def _expanded(number: np.ndarray, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
    """ids of the phrases that number names."""
    start, parts = np.cumsum(length) - length, [np.zeros(0, ids.dtype)]
    for i in range(0, len(number), BLOCK):
        x = number[i : i + BLOCK]
        n = length.take(x)
        stop = np.cumsum(n)
        parts.append(ids.take(np.repeat(start.take(x) - stop + n, n) + np.arange(stop[-1])))
    return np.concatenate(parts)


def dump(docs: list[int | None], sizes: np.ndarray, ids: np.ndarray, phrases: list[bytes] | None = None) -> bytes:
    """A file of documents with `sizes` ids each; with phrases (ids as 32-bit integers) ids has numbers of them."""
    if phrases is None:
        kinds, ids = np.unique(ids, return_inverse=True)
        flat, length = kinds.astype(_INT), np.ones(len(kinds), _INT)
    else:
        flat = np.frombuffer(b"".join(phrases), "<u4").astype(_INT)
        length = np.fromiter((len(p) // 4 for p in phrases), _INT, len(phrases))
    used, weight, number = _ranked(ids, len(length))
    flat, length = _expanded(used, flat, length), length[used]
    alphabet, id_weight, spelled = _ranked(flat, int(flat.max(initial=-1)) + 1)
    inner, spelled = _blocks(spelled, _Letters(id_weight))
    outer, coded = _blocks(number, _Letters(weight))
    edge = np.flatnonzero(np.r_[True, weight[1:] != weight[:-1]][: len(weight)])
    pack = zstandard.ZstdCompressor(level=6, write_checksum=True).compress
    lengths = pack(length.astype("<u4").tobytes())
    head = {"docs": docs, "sizes": sizes.tolist(), "alphabet": alphabet.tolist(), "id_weight": id_weight.tolist(), "weight": weight[edge].tolist(), "from": edge.tolist(), "phrases": len(weight), "lengths": len(lengths), "inner": inner, "outer": outer}
    packed = pack(json.dumps(head, separators=(",", ":")).encode())
    return MAGIC + struct.pack("<I", len(packed)) + packed + lengths + b"".join(spelled) + b"".join(coded)


def load(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """docs, sizes and ids of dump(), sizes in ids; damaged blocks raise ValueError."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<I", data, 8)
    unpack = zstandard.ZstdDecompressor().decompress
    head = json.loads(unpack(data[12 : 12 + n]))
    at = 12 + n + head["lengths"]
    length = np.frombuffer(unpack(data[12 + n : at]), "<u4").astype(_INT)

    def numbers(blocks, letters):
        nonlocal at
        parts = [np.zeros(0, np.int32)]
        for size, many, crc in blocks:
            try:
                parts.append(decode_block(data[at : at + size], many, letters))
            except (IndexError, ValueError) as e:  # a damaged block may run past its end
                raise ValueError("a block is damaged") from e
            if _crc(parts[-1], data[at : at + size]) != crc:
                raise ValueError("a block's checksum differs")
            at += size
        return np.concatenate(parts)

    flat = np.asarray(head["alphabet"], np.uint32)[numbers(head["inner"], _Letters(np.asarray(head["id_weight"], _INT)))]
    weight = np.repeat(np.asarray(head["weight"], _INT), np.diff([*head["from"], head["phrases"]]))
    number = numbers(head["outer"], _Letters(weight))
    before = np.r_[0, np.cumsum(length.take(number))]
    return head["docs"], np.diff(before[np.r_[0, np.cumsum(np.asarray(head["sizes"], _INT))]]), _expanded(number, flat, length)


#: The pattern of the vocabulary's pre-tokens; texts of nothing but ASCII and the letters of Latin-1 are cut here, all at
#: once, by classes of their bytes. Of other texts, and of those with a special token, the library gets the chunks between
#: blanks whole.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CHUNKS = re.compile(r"[^ \n]+")
#: What keeps a text from being cut here.
_BEYOND = re.compile(r"[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Pre-tokens that are given to the library in one text, and letters at once, about: an encoding takes much more than its text.
_JOINED, _LETTERS_AT_ONCE = 200, 1 << 18
_BYTES = np.arange(256)
#: Bytes in lower case (of Latin-1's letters the second byte, after 0xC3), and their classes: blank, letter, digit, other.
_LOWER = (_BYTES + 32 * ((_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 0x80) & (_BYTES <= 0x9E))).astype(np.uint8)
_CLASS = np.where((_BYTES >= 0x80) | (_BYTES >= 97) & (_BYTES <= 122), 1, np.where((_BYTES >= 48) & (_BYTES <= 57), 2, 3)).astype(np.uint8)
_FOREIGN = (_BYTES >= 0xC0) & (_BYTES != 0xC3)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the texts and their bytes; null is empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    edge = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]] if len(col) else np.zeros(0, np.uint8)
    return edge - edge[:1] if len(col) else np.zeros(1, np.int64), data


def _pre_tokens(edge: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of plain texts, and how many of them each text has."""
    text = np.zeros(len(data) + 4, np.uint8)
    _LOWER.take(data, out=text[: len(data)])
    kind = _CLASS.take(text)
    kind[len(data) :] = 0
    first = np.zeros(len(text), bool)  # of a text
    first[edge] = True
    start = np.r_[True, kind[1:] != kind[:-1]] | first | (kind == 2)
    start &= kind != 0
    # an apostrophe alone takes s, t, m, d, re, ve or ll from the letters behind it
    at = np.flatnonzero(start & (text == 39)) + 1
    at = at[(kind[at] == 1) & ~first[at]]
    b, c = text[at], np.where(first[at + 1], 0, text[at + 1])
    size = np.where(np.isin(b, list(b"stmd")), 1, np.where(((b == 114) | (b == 118)) & (c == 101) | (b == 108) & (c == 108), 2, 0))
    at, size = at[size > 0], size[size > 0]
    start[at] = False
    start[at + size] |= kind[at + size] == 1
    held = kind != 0
    begin = np.flatnonzero(start[held])
    body = text[held]
    count = np.diff(np.searchsorted(np.flatnonzero(start), edge))
    parts = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.r_[begin, len(body)]), pa.py_buffer(body))
    return parts, count


class _Words:
    """A worker's tokenizer with the ids of the pre-tokens that it has seen; blanks never join tokens.

    They are remembered in two generations: when the young one is full it becomes the old one, and pre-tokens that are
    met again move up, so common ones are never encoded twice. Digits are always known. Pre-tokens of more than LONG_WORD
    letters are encoded for each batch anew, so that texts without blanks don't fill the memory.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        split = self.tokenizer.pre_tokenizer
        self.known = split is not None and json.dumps(_SPLIT) in split.__getstate__().decode()
        # the same merges without the steps that leave such pre-tokens as they are
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.digits = {p: array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes() for p in "0123456789"}
        self.young, self.old = {}, {}

    def cut(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pre-tokens of texts, the places in that list of all, how many each text has."""
        edge, data = _buffers(col)
        n = len(edge) - 1
        odd = np.full(n, not self.known)
        if self.known:
            # lead bytes of other letters, and 0xC3 before the signs of multiplication and division
            beyond = _FOREIGN.take(data)
            beyond[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
            odd[np.searchsorted(edge, np.flatnonzero(beyond), "right") - 1] = True
            for t in self.special:
                odd |= pc.fill_null(pc.match_substring(col, t), False).to_numpy(zero_copy_only=False)
        if not odd.any():
            parts, count = _pre_tokens(edge, data)
        else:
            plain = col.filter(pa.array(~odd))
            parts, count = _pre_tokens(*_buffers(plain))
        found = parts.dictionary_encode()
        words, which = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        if not odd.any():
            return words, which, count
        chunks = [_CHUNKS.findall(t or "") for t in col.filter(pa.array(odd)).to_pylist()]
        own = {w: i for i, w in enumerate(words)}
        more = np.fromiter((own.setdefault(c, len(own)) for x in chunks for c in x), np.int32)
        every = np.zeros(n, _INT)
        every[~odd], every[odd] = count, [len(x) for x in chunks]
        # both sorts of texts back in their order
        out, mark = np.empty(len(which) + len(more), np.int32), np.repeat(odd, every)
        out[~mark], out[mark] = which, more
        return list(own), out, every

    @staticmethod
    def _encoded(tokenizer: Tokenizer, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        at = np.cumsum(np.fromiter(map(len, texts), _INT, len(texts))) // _LETTERS_AT_ONCE
        edge = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
        for a, z in zip(edge, edge[1:]):
            yield from (e.ids for e in tokenizer.encode_batch_fast(texts[a:z], add_special_tokens=False))

    def _joined(self, words: list[str]) -> Iterator[bytes]:
        """Ids of pre-tokens that are encoded side by side; each ends where a token ends a word."""
        some = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        for x, got in zip(some, self._encoded(self.merges, [" ".join(x) for x in some])):
            ids = np.asarray(got, "<u4")
            edge = [0, *(4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()]
            if len(edge) != len(x) + 1:
                raise ValueError("a pre-token of the vocabulary doesn't end where a word ends")
            raw = ids.tobytes()
            yield from (raw[a:z] for a, z in zip(edge, edge[1:]))

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens as 32-bit integers."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        apart, plain, other = dict(self.digits), [], []
        for p in words:
            if p in young or p in apart:
                continue
            if p in old:
                young[p] = old[p]
            elif self.known and len(p) <= LONG_WORD and _PLAIN.fullmatch(p):
                plain.append(p)
            else:
                other.append(p)
        young.update(zip(plain, self._joined(plain)))
        for p, got in zip(other, self._encoded(self.tokenizer, other)):
            (young if len(p) <= LONG_WORD else apart)[p] = array("I", got).tobytes()
        out = [young[p] if p in young else apart[p] for p in words]
        if len(young) > 2 * CACHE:  # nearly all were new: such words hardly come again
            self.young, self.old = {}, {}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        words, which, count = self.cut(pa.array(texts, pa.string()))
        ids, edge = self.ids(words), np.r_[0, np.cumsum(count)].tolist()
        return [b"".join([ids[i] for i in which[a:z].tolist()]) for a, z in zip(edge, edge[1:])]


class _File:
    """Documents of a file to be, as numbers of the phrases that it has met; phrase 0 is END alone."""

    def __init__(self):
        self.phrases, self.length, self.index = [np.asarray([END], "<u4").tobytes()], array("I", [1]), {}
        self.docs, self.sizes, self.parts, self.held, self.full = [], [], [], 0, False

    def add(self, coder: _Words, docs: list[int | None], texts: pa.Array) -> int:
        """Take documents until the file is full; how many were taken."""
        words, which, count = coder.cut(texts)
        index = self.index
        new = [w for w in words if w not in index]
        ids = coder.ids(new)
        index.update(zip(new, range(len(self.phrases), len(self.phrases) + len(new))))
        self.phrases += ids
        self.length.extend(len(x) >> 2 for x in ids)
        number, edge = np.fromiter(map(index.__getitem__, words), np.int32, len(words))[which], np.r_[0, np.cumsum(count)]
        held = np.r_[0, np.cumsum(np.asarray(self.length).take(number), dtype=_INT)][edge[1:]] + np.arange(1, len(docs) + 1)
        kinds = np.r_[0, np.maximum.accumulate(number)][edge[1:]]  # phrases so far, which are numbered as they come
        n = min(len(docs), int(np.searchsorted(held, FILE_IDS - self.held)) + 1, int(np.searchsorted(kinds, FILE_PHRASES)) + 1)
        self.full = int(held[n - 1]) + self.held >= FILE_IDS or int(kinds[n - 1]) >= FILE_PHRASES
        out = np.zeros(edge[n] + n, np.int32)
        out[np.arange(edge[n]) + np.repeat(np.arange(n), count[:n])] = number[: edge[n]]
        self.docs += docs[:n]
        self.sizes.append(count[:n] + 1)
        self.parts.append(out)
        self.held += int(held[n - 1])
        return n

    def dump(self) -> bytes:
        sizes, number = np.concatenate(self.sizes), np.concatenate(self.parts)
        self.index, self.parts = {}, []
        return dump(self.docs, sizes, number, self.phrases)


_CODERS: dict[str, _Words] = {}


def _coder(path: str) -> _Words:
    """A worker's tokenizer; Spark's tasks are all the threads it needs."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _CODERS:
        _CODERS[path] = _Words(path)
    return _CODERS[path]


_ROWS = "shard int, seq int, temp string, file string, n long, bytes long, sha256 string"
_KINDS = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())


def _writer(path: str, base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, attempt, now, file = _coder(path), uuid.uuid4().hex[:12], None, _File()

        def close():
            data = file.dump()
            temp = f"{base}/_temporary/{attempt}-{now[0]:06d}-{now[1]:05d}"
            f, p = files.at(temp)
            with f.open_output_stream(p, compression=None) as out:
                out.write(data)
            row = [*now, temp, f"{base}/tokens-{now[0]:06d}-{now[1]:05d}.cmrc", file.held, len(data), hashlib.sha256(data).hexdigest()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, _KINDS)], names=[x.split()[0] for x in _ROWS.split(", ")])

        for b in sliced(batches, limit=SLICE):
            docs, shard, text = b.column("doc").to_pylist(), b.column("shard").to_numpy(), b.column("text")
            i = 0
            while i < len(docs):
                if file.docs and (shard[i] != now[0] or file.full):
                    yield close()
                    now, file = (int(shard[i]), now[1] + 1 if shard[i] == now[0] else 0), _File()
                now = now or (int(shard[i]), 0)
                z = i + int(np.count_nonzero(shard[i:] == shard[i]))  # rows are in order of shards
                i += file.add(coder, docs[i:z], text[i:z])
        if file.docs:
            yield close()

    return run


def _commit(batches):
    for b in batches:
        for temp, final in zip(b.column("temp").to_pylist(), b.column("file").to_pylist()):
            files.move(temp, final)
        yield b


def write(docs: DataFrame, base: str, id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode docs, append END to each, write them under base in ascending order of id, and return the manifest.

    A null or empty text has END only; a null id sorts first; rows of one id are ordered by a hash of their text, equal
    rows stay equal rows. Other columns are ignored, under any name. An empty table gives an empty manifest. Files of
    failed attempts never get a final name.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select(column(docs, id).cast("long").alias("doc"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    found = shards.cuts(rows, F.col("doc"), tie, F.octet_length("text") + 20, SHARD_BYTES)
    sharded = rows.select(shards.shard_of(found)(F.col("doc"), tie).alias("shard"), "doc", tie.alias("tie"), "text")
    ready = shards.dealt(sharded, len(found[0]) + 1, [F.col("doc").asc_nulls_first(), "tie", "text"]).select("shard", "doc", "text")
    files.make(f"{base}/_temporary")
    accepted = stage(ready.mapInArrow(_writer(path, base), _ROWS), "tokens-accepted")
    accepted.mapInArrow(_commit, _ROWS).write.mode("overwrite").parquet(f"{base}/manifest")
    discard(accepted)
    f, p = files.at(f"{base}/_temporary")
    f.delete_dir(p)
    return docs.sparkSession.read.parquet(f"{base}/manifest")


_READ = "shard int, seq int, at long, doc_id long, n_tokens long, ids binary"


def _reader(batches):
    for b in batches:
        for uri, shard, seq, digest in zip(*[b.column(c).to_pylist() for c in ("file", "shard", "seq", "sha256")]):
            f, p = files.at(uri)
            with f.open_input_stream(p, compression=None) as stream:
                data = stream.read()
            if hashlib.sha256(data).hexdigest() != digest:
                raise ValueError(f"{uri} isn't what the manifest says")
            docs, sizes, ids = load(data)
            edge, raw = np.r_[0, np.cumsum(sizes)], pa.py_buffer(ids.astype("<u4"))
            for i in range(0, len(docs), 2000):
                n = len(docs[i : i + 2000])
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * edge[i : i + n + 1]), raw]).cast(pa.binary())
                cols = [pa.array([shard] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(edge[i : i + n]), pa.array(docs[i : i + n], pa.int64()), pa.array(sizes[i : i + n]), body]
                yield pa.record_batch(cols, names=[x.split()[0] for x in _READ.split(", ")])


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian 32-bit) of each document."""
    counts = sorted((r["shard"], r["seq"], r["n"]) for r in manifest.select("shard", "seq", "n").collect())  # a row for each file
    starts, at = [], 0
    for shard, seq, n in counts:
        starts.append((shard, seq, at))
        at += n
    spark = manifest.sparkSession
    base = spark.createDataFrame(starts, "shard int, seq int, base long")
    rows = manifest.select("file", "shard", "seq", "sha256").repartition(max(1, len(starts))).mapInArrow(_reader, _READ)
    return rows.join(F.broadcast(base), ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write docs to a new folder in the shared one and read them back: doc_id, start, n_tokens, ids_crc32."""
    back = read(write(docs, workspace(docs.sparkSession, "tokens")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
