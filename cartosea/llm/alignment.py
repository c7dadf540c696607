"""Cross-tokenizer alignment: minimal groups of two tokenizers' tokens, their links, and corpus-wide pair counts.

Tokens of A and B are the two sides of a bipartite graph whose edges join tokens with overlapping bytes; union-find gives
its connected components, which are exactly the minimal groups between offsets where tokens of both end. A group's members
expand to links, every A occurrence with every B occurrence in it.

Neither tokenizer merges across white space that follows something else, so a text is cut there, and groups never cross
a cut: a worker aligns each distinct chunk once. A slice of texts (about 4 MB) keeps one row: its distinct id pairs, in
how many of its documents each is linked, and which documents hold which. Pairs are counted by Spark's aggregation of
those rows, joined back to the slices that asked, and the slices add up their documents. A very common pair is one row
of a slice, so no key is hot.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cartosea.llm.bpe import _CUT, pack, unpack
from cartosea.llm.common import column, sliced, stage

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE = 4 << 20
#: Bytes of aligned chunks that a worker remembers, by estimate; a longer chunk than LONG characters isn't remembered.
KNOWN_BYTES, LONG = 80 << 20, 64
#: Links of a group beyond which they are multiplied by distinct ids.
MANY = 4096
#: A chunk: white space, then what follows up to the next space or line end that follows no white space.
_CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_RARE = re.compile(r"[^\x00-ɏ]")
_SPACE = "▁"


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each A token, then each B token, the first A token of its connected component in the graph of overlapping
    tokens; ends are ascending byte offsets, and the last of both is the same. Union-find by whole arrays: edges hang the
    greater root below the smaller one, then all paths are compressed."""
    up = np.arange(len(a_ends) + len(b_ends))
    if not len(up):
        return up
    start = np.concatenate([[0], np.union1d(a_ends, b_ends)[:-1]])  # each stretch between ends is an edge
    x, y = np.searchsorted(a_ends, start, "right"), np.searchsorted(b_ends, start, "right") + len(a_ends)
    while len(x):
        p, q = up[x], up[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]
    return up


def _byte_level() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Aligner:
    """A worker's two tokenizers and the chunks that it has aligned."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        letters = _byte_level()
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        whole = {t: i for t, i in vocabulary.items() if all(c in letters for c in t)}
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in whole.items()}
        # ids in the order of merges: then ranks say the same, and single pre-tokens go the short way
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [vocabulary.get("".join(m), -1) for m in pairs]
        self.single = None
        if ids == list(range(256, 256 + len(ids))):
            own = {self.a_bytes[i]: i for i in range(256 + len(ids))}
            self.single = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})._core_bpe.encode_single_piece
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # cuts need that no piece has a space or line end after anything else; else a text is one chunk
        self.cut = re.compile(r".+", re.S) if any(re.search("[^▁]▁|\n", p) for p in pieces) else _CHUNK
        self.blank = self.b.piece_to_id(_SPACE)
        self.a_len, self.b_len = np.zeros(max(self.a_bytes) + 1, np.int64), np.fromiter(map(len, self.b_bytes), np.int64)
        self.a_len[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.clear()

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace(_SPACE, " ").encode()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.start, self.size = array("q"), array("i")
        self.n_a, self.n_b, self.n_groups = array("i"), array("i"), array("i")
        self.keys, self.times = array("q"), array("q")
        self.bytes, self.odd = 0, set()

    def _ids(self, chunks: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids by A and by B of each chunk, as they are inside a text."""
        # letters that are rare or new may be letters to one library and not to another: those chunks go the long way
        short = [c for c in chunks if self.single and not _RARE.search(c)]
        a_ids = {c: [i for x in _CUT.findall(c) for i in self.single(x.encode())] for c in short}
        long = [c for c in chunks if c not in a_ids]
        a_ids |= dict(zip(long, (e.ids for e in self.a.encode_batch(long, add_special_tokens=False))))
        for c, ids in zip(chunks, self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)):
            yield a_ids[c], [self.blank] if c == " " else ids if c[0] == " " else ids[1:]

    def add(self, chunks: list[str]) -> list[int]:
        """Align chunks and number them."""
        numbers = list(range(len(self.groups), len(self.groups) + len(chunks)))
        ids = list(self._ids(chunks))
        raw = [c.encode() for c in chunks]
        left, right = ([i for x in ids for i in x[side]] for side in (0, 1))
        if not (b"".join(map(self.a_bytes.__getitem__, left)) == b"".join(map(self.b_bytes.__getitem__, right)) == b"".join(raw)):
            good = [all(b"".join(map(table.__getitem__, x)) == c for table, x in zip((self.a_bytes, self.b_bytes), pair)) for pair, c in zip(ids, raw)]
            ids = [pair if g else ([], []) for pair, g in zip(ids, good)]
            left, right = ([i for x in ids for i in x[side]] for side in (0, 1))
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        n_a, n_b = (np.fromiter((len(x[side]) for x in ids), np.int64, len(ids)) for side in (0, 1))
        root = components(np.cumsum(self.a_len[left]), np.cumsum(self.b_len[right]))
        _, of = np.unique(root, return_inverse=True)  # a component's first A token: groups are numbered in order
        of_a, of_b = of[: len(left)], of[len(left) :]
        size_a, size_b = np.bincount(of_a), np.bincount(of_b)
        begin_a, begin_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        n_groups = np.diff(np.concatenate([[0], size_a.cumsum().searchsorted(np.cumsum(n_a), "right")]))
        keys, times, per_group = _links(left, right, begin_a, size_a, begin_b, size_b)
        size = _sums(per_group, n_groups)
        names_a, names_b = list(map(str, left.tolist())), list(map(str, right.tolist()))
        found = [
            f"{names_a[a]}|{names_b[b]}" if m == 1 and n == 1 else ",".join(names_a[a : a + m]) + "|" + ",".join(names_b[b : b + n])
            for a, m, b, n in zip(begin_a.tolist(), size_a.tolist(), begin_b.tolist(), size_b.tolist())
        ]
        edges = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        self.groups += [";".join(found[x:y]) if y > x else None for x, y in zip(edges, edges[1:])]
        self.start.frombytes((len(self.keys) + np.cumsum(size) - size).tobytes())
        for mine, values in ((self.size, size), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)):
            mine.frombytes(values.astype(np.int32).tobytes())
        self.keys.frombytes(keys.tobytes())
        self.times.frombytes(times.tobytes())
        self.bytes += 300 * len(chunks) + 6 * sum(map(len, raw)) + 16 * len(keys)
        return numbers

    def chunks(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' chunks in order, and each text's number of chunks. A text whose bytes the tokens don't
        give back, and one that is null or empty, has none."""
        if self.bytes > KNOWN_BYTES:
            self.clear()
        cut, known = self.cut.findall, self.known
        parts = [cut(" " + t) if t else [] for t in texts]
        new = dict.fromkeys(c for p in parts for c in p if c not in known)
        here = dict(zip(new, self.add(list(new)))) if new else {}
        known.update((c, k) for c, k in here.items() if len(c) <= LONG)
        get = (known | here).__getitem__ if len(here) != len(known) and any(len(c) > LONG for c in here) else known.__getitem__
        numbers = [list(map(get, p)) for p in parts]
        odd = {k for k in here.values() if self.groups[k] is None} | self.odd
        self.odd = {known[c] for c in here if len(c) <= LONG and self.groups[known[c]] is None} | self.odd
        if odd:
            numbers = [self._whole(t, n) if not odd.isdisjoint(n) else n for t, n in zip(texts, numbers)]
        return np.fromiter((k for n in numbers for k in n), np.int64), np.fromiter(map(len, numbers), np.int64, len(numbers))

    def _whole(self, text: str, numbers: list[int]) -> list[int]:
        """A text with a chunk that isn't given back: perhaps it is as a whole."""
        (k,) = self.add([" " + text])
        return [] if self.groups[k] is None else [k]


def _links(left, right, begin_a, size_a, begin_b, size_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, times, number of them for each group): each group's A tokens with each of its B tokens. In a large group
    equal ids are multiplied, not walked through."""
    count = size_a * size_b
    large = {int(g): Counter(left[begin_a[g] : begin_a[g] + size_a[g]].tolist()) for g in np.flatnonzero(count > MANY)}
    own = {g: (a, Counter(right[begin_b[g] : begin_b[g] + size_b[g]].tolist())) for g, a in large.items()}
    for g, (a, b) in own.items():
        count[g] = len(a) * len(b)
    g = np.repeat(np.arange(len(count)), count)
    at = _gather(np.zeros(len(count), np.int64), count)
    a, b = np.divmod(at, size_b[g]) if not own else (np.minimum(at // size_b[g], size_a[g] - 1), at % size_b[g])
    keys, times = (left[begin_a[g] + a] << 32) | right[begin_b[g] + b], np.ones(len(g), np.int64)
    begin = np.cumsum(count) - count
    for k, (a, b) in own.items():
        span = slice(int(begin[k]), int(begin[k] + count[k]))
        keys[span] = [i << 32 | j for i in a for j in b]
        times[span] = [m * n for m in a.values() for n in b.values()]
    return keys, times, count


_LOADED: dict[tuple[str, str], _Aligner] = {}


def _aligner(a_path: str, b_path: str) -> _Aligner:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = _Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or public_tokenizers.path(A), b or public_tokenizers.path(B)


_MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_SLICES = (
    "slice long, doc_id array<long>, " + ", ".join(f"{m} array<long>" for m in _MEASURES) + ", groups_sha256 array<string>, keys array<long>, docs array<long>, distinct binary, which binary, times binary"
)
_SLICES_ARROW = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3]


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of each run of count values."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(count)])])


def _slices(a_path: str, b_path: str):
    """One row for each slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, v = TaskContext.get().partitionId(), 0, _aligner(a_path, b_path)
        for b in _merged(sliced(batches, "_text", SLICE)):
            at, count = v.chunks(b.column("_text").to_pylist())
            view = {m: np.frombuffer(getattr(v, m), np.int32)[at].astype(np.int64) for m in ("n_a", "n_b", "n_groups", "size")}
            place = _gather(np.frombuffer(v.start, np.int64)[at], view["size"])
            keys, times = np.frombuffer(v.keys, np.int64)[place], np.frombuffer(v.times, np.int64)[place]
            per_doc = _sums(view["size"], count)
            distinct, inv = np.unique(keys, return_inverse=True)
            code = np.repeat(np.arange(b.num_rows), per_doc) * max(1, len(distinct)) + inv
            code, first = np.unique(code, return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, first, times)
            doc, which = np.divmod(code, max(1, len(distinct)))
            own = np.bincount(doc, minlength=b.num_rows)
            # a document's pairs are ascending: gaps are small, and the first of each follows its own zero
            gaps = np.diff(which, prepend=0)
            gaps[np.concatenate([[0], np.cumsum(own)[:-1]])[own > 0]] = which[np.concatenate([[0], np.cumsum(own)[:-1]])[own > 0]]
            edges, names = np.concatenate([[0], np.cumsum(count)]).tolist(), v.groups
            at = at.tolist()
            sums = [hashlib.sha256(";".join([names[k] for k in at[x:y]]).encode()).hexdigest() if y > x else "" for x, y in zip(edges, edges[1:])]
            n_links = _sums(total, own)
            row = [(part << 32) | seq, b.column("_row"), *[pa.array(_sums(view[m], count)) for m in ("n_a", "n_b", "n_groups")], pa.array(n_links), pa.array(sums), pa.array(distinct), pa.array(np.bincount(which, minlength=len(distinct))), pack(own), pack(gaps), pack(total)]
            seq += 1
            del view, place, keys, times, inv, code, first, doc, which, total
            yield pa.record_batch([_one(x, t) for x, t in zip(row, _SLICES_ARROW)], names=[f.split()[0] for f in _SLICES.split(", ")])

    return run


def _one(value, kind: pa.DataType) -> pa.Array:
    """An array of one entry."""
    if isinstance(value, (pa.Array, pa.ChunkedArray)):
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value.cast(kind.value_type))
    return pa.array([value], kind)


def _merged(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches together, up to SLICE bytes of them: fewer, larger slices ask for fewer pairs."""
    held, size = [], 0
    for b in pieces:
        if held and size + b.nbytes > SLICE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def slices(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Aligned slices of docs (doc_id, text), staged: what pair_counts() and digests() read."""
    slim = docs.select(column(docs, "doc_id").cast("long").alias("_row"), column(docs, "text").alias("_text"))
    return stage(slim.mapInArrow(_slices(*_paths(a, b)), _SLICES), "alignment")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(key, docs, best) for each id pair that any document has linked: key is A's id * 2**32 + B's, docs the number
    of documents (rows) that hold it linked, best whether no other pair of the same A id has more."""
    pairs = aligned.select(F.explode(F.arrays_zip("keys", "docs")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.docs").alias("docs"))
    pairs = stage(pairs, "alignment-pairs")
    of = F.shiftright("key", 32)
    # one row for each id of A's vocabulary
    top = pairs.groupBy(of.alias("a")).agg(F.max("docs").alias("top"))
    return pairs.withColumn("a", of).join(F.broadcast(top), "a").select("key", "docs", (F.col("docs") == F.col("top")).alias("best"))


_DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _add_up(mine: pa.Table, asked: pa.Table) -> pa.Table:
    """One slice's documents with the counts of its pairs."""
    row = mine.to_pylist()[0] if mine.num_rows == 1 else None
    if row is None:
        raise ValueError(f"{mine.num_rows} rows for a slice")
    place = asked.column("pos").to_numpy()
    docs, best = np.zeros(len(row["keys"]), np.int64), np.zeros(len(row["keys"]), np.int64)
    docs[place], best[place] = asked.column("docs").to_numpy(), asked.column("best").to_numpy()
    own, gaps, times = unpack(row["distinct"]), unpack(row["which"]), unpack(row["times"])
    run = np.concatenate([[0], np.cumsum(gaps)])
    begin = np.concatenate([[0], np.cumsum(own)])[:-1]
    which = run[1:] - np.repeat(run[begin], own)
    cols = {"doc_id": row["doc_id"], **{m: row[m] for m in _MEASURES}, "n_best": _sums(best[which] * times, own), "count_sum": _sums(docs[which] * times, own), "groups_sha256": row["groups_sha256"]}
    return pa.table({k: pa.array(x, pa.string() if k == "groups_sha256" else pa.int64()) for k, x in cols.items()})


def digests(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is best, see pair_counts),
    count_sum (the pairs' documents, over links) and groups_sha256 of `a1,a2|b1;a3|b2,b3`.

    A is given a space and the text, B the text, to which it adds the space; strings of special tokens are plain text. A
    null or empty text, and one whose bytes either side's tokens don't give back, has zeros and an empty digest. Equal rows
    are rows of their own, and each counts; a null doc_id stays null; other columns are ignored; an empty table gives
    none. A very long text is a slice of its own: a task holds some 100 bytes for each of its tokens.
    """
    aligned = slices(docs, a, b)
    counts = pair_counts(aligned)
    asked = aligned.select("slice", F.posexplode("keys").alias("pos", "key")).hint("merge").join(counts, "key").select(F.col("slice").alias("_slice"), "pos", "docs", "best")
    mine = aligned.drop("docs").withColumn("keys", F.expr("cast(array_repeat(0, size(keys)) as array<byte>)"))
    return mine.groupBy("slice").cogroup(asked.groupBy("_slice")).applyInArrow(_add_up, _DIGESTS)


_GROUP = "array<struct<start: long, stop: long, a: array<int>, b: array<int>>>"


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """docs with a column alignment: the minimal groups in order, each with its bytes (of space and text) and the ids of
    both sides; empty where digests() has zeros. An older column of that name gives way."""
    paths, keep = _paths(a, b), [c for c in docs.columns if c != "alignment"]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("alignment", T._parse_datatype_string(_GROUP))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _aligner(*paths)
        for batch in sliced(batches, "text"):
            at, count = v.chunks(batch.column("text").to_pylist())
            edges, out = np.concatenate([[0], np.cumsum(count)]).tolist(), []
            for x, y in zip(edges, edges[1:]):
                groups, start = [], 0
                for g in (g for k in at[x:y].tolist() for g in v.groups[k].split(";")):
                    left, right = ([int(i) for i in side.split(",")] for side in g.split("|"))
                    stop = start + sum(len(v.a_bytes[i]) for i in left)
                    groups.append({"start": start, "stop": stop, "a": left, "b": right})
                    start = stop
                out.append(groups)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(out, kind)], names=[*keep, "alignment"])

    return docs.select(*[column(docs, c) for c in keep]).mapInArrow(run, schema)
