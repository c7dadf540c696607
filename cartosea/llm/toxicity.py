"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the text of documents labelled toxic and one on that of ordinary ones;
nothing but the labels says which text goes where. A window (a word with its borders) is compressed with each, and the
lengths are compared. Bytes are spread to `SPREAD` fixed pseudo-random bytes before, so that what a dictionary doesn't know
costs its length and what it knows costs one match. The thresholds are calibrated on labelled documents that trained no
dictionary: a logistic one over both lengths of a window, and one over a document's largest log-odds and its number of
windows. A toxic document is mostly ordinary text, and labels mark documents, not windows; so the window's threshold
is found in rounds, each against the windows that stand out most in toxic documents by the round before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.llm.common import LONG_WORD, column, sliced, utf8

SPREAD, LEVEL = 8, 19
#: Windows of a document that its score looks at.
TOP = 6
#: The fit takes at most so many labelled rows of each kind, in order of a hash of the id, none longer than LONGEST.
FIT_TOXIC, FIT_ORDINARY, LONGEST = 2500, 5000, 20_000
#: Dictionaries: bytes at most, segment and smallest piece of training. Calibration: ordinary windows, rounds, and windows of a
#: toxic document that count as toxic. Windows that a worker remembers.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, PIECE, SAMPLES, ROUNDS, STANDING, CACHE = 8 << 10, 64 << 10, 16, 6, 120_000, 4, 3, 2_000_000
_CODE = np.random.default_rng(20).integers(0, 256, (256, SPREAD), dtype=np.uint8)
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


@dataclass
class Model:
    """Dictionaries and calibrated weights."""

    toxic: bytes
    ordinary: bytes
    window: list[float]
    document: list[float]
    base: float


def windows(text: bytes) -> list[bytes]:
    """The words of a text, lower case, parted at ASCII punctuation."""
    return text.translate(_PLAIN).split()


def spread(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words with their borders, spread; and the offset and length of each."""
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8)
    size = (np.fromiter(map(len, words), np.int64, len(words)) + 2) * SPREAD
    return _CODE[data].tobytes(), np.stack([np.cumsum(size) - size, size], 1)


def lengths(words: list[bytes], dictionary: zstandard.ZstdCompressionDict) -> np.ndarray:
    """Compressed length of each window."""
    if not words:
        return np.zeros(0)
    data, segments = spread(words)
    conf = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    made = zstandard.ZstdCompressor(compression_params=conf, dict_data=dictionary).multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.astype(np.uint64).tobytes()), threads=1)
    return np.fromiter(map(len, made), np.float64, len(made))


def _train(docs: list[list[bytes]], size: int) -> bytes:
    """A dictionary of some documents' text."""
    samples = [b" " + b" ".join(d) + b" " for d in docs if d]
    size = max(256, min(size, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=PIECE).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text is the dictionary
        return b"".join(samples)[-size:] or bytes(8)


def _dictionaries(*raw: bytes) -> list[zstandard.ZstdCompressionDict]:
    return [zstandard.ZstdCompressionDict(_CODE[np.frombuffer(x, np.uint8)].tobytes(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in raw]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, bias last, by damped Newton steps on standardised columns."""
    mid, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mid) / scale, np.ones((len(x), 1))])
    pull = np.r_[np.full(x.shape[1], ridge), 1e-6]
    loss = lambda w: (weight * (np.logaddexp(0, z @ w) - y * (z @ w))).sum() + 0.5 * (pull * w * w).sum()
    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(pull)
        step, size = np.linalg.solve(h, z.T @ (weight * (y - p)) - pull * w), 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        now, last = loss(w), now
        if last - now < 1e-7 * abs(last):
            break
    flat = w[:-1] / scale
    return np.r_[flat, w[-1] - flat @ mid]


def _features(toxic: np.ndarray, ordinary: np.ndarray, words: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, words), np.float64, len(words)) + 2
    d, t, o = (ordinary - toxic) / 8, toxic / 16, ordinary / 16
    return np.stack([d, np.maximum(d, 0) ** 2, t, o, t * t, o * o, t * o, toxic / (SPREAD * size), ordinary / (SPREAD * size), size / 8, d * size / 8, t * size / 8], 1)


def _window_threshold(toxic: list[list[bytes]], ordinary: list[list[bytes]], dicts: list[zstandard.ZstdCompressionDict]) -> np.ndarray:
    """Weights over a window's lengths that part what stands out in toxic documents from ordinary windows."""
    known = list(dict.fromkeys(w for d in toxic + ordinary for w in d))
    number = dict(zip(known, range(len(known))))
    x = _features(lengths(known, dicts[0]), lengths(known, dicts[1]), known)
    own = [np.unique(np.fromiter(map(number.__getitem__, d), np.int64, len(d))) for d in toxic if d]
    rest = np.concatenate([np.fromiter(map(number.__getitem__, d), np.int64, len(d)) for d in ordinary if d])
    some = np.random.default_rng(1).permutation(len(rest))[:SAMPLES]
    score, weights = x[:, 0], np.zeros(x.shape[1] + 1)
    for _ in range(ROUNDS):
        # what stands out in ordinary documents too is no sign, however often toxic ones have it
        high = rest[np.argsort(-score[rest], kind="stable")[: len(some) // 4]]
        top = np.concatenate([d[np.argsort(-score[d], kind="stable")[:STANDING]] for d in own])
        rows = np.concatenate([top, rest[some], high])
        weights = _logistic(x[rows], np.r_[np.ones(len(top)), np.zeros(len(rows) - len(top))], np.ones(len(rows)))
        score = x @ weights[:-1] + weights[-1]
    return weights


def fit(texts: list[bytes], labels: list[int], base: float | None = None) -> Model:
    """Train on labelled texts: even ones train the dictionaries, odd ones calibrate (all do both if they are few)."""
    docs = [windows(t) for t in texts]
    toxic, ordinary = ([d for d, y in zip(docs, labels) if y == k] for k in (1, 0))
    share = float(np.mean(labels)) if labels else 0.0
    part = lambda x, k: x[k::2] if len(x) > 20 else x
    hot, cold = part(toxic, True), part(ordinary, True)
    if not any(hot) or not any(cold):
        return Model(bytes(8), bytes(8), [0.0] * 13, [0.0] * (TOP + 2), share)
    raw = _train(part(toxic, False), TOXIC_BYTES), _train(part(ordinary, False), ORDINARY_BYTES)
    model = Model(*raw, _window_threshold(hot, cold, _dictionaries(*raw)).tolist(), [0.0] * (TOP + 2), share if base is None else base)
    marks = np.r_[np.ones(len(hot)), np.zeros(len(cold))]
    # the sample's kinds are weighted as they stand among all labelled rows
    weight = np.where(marks == 1, model.base / len(hot), (1 - model.base) / len(cold)) * len(marks)
    model.document = _logistic(_document_rows(model, hot + cold), marks, weight).tolist()
    return model


class Scorer:
    """A worker's compressors, with the log-odds of the windows that it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.dicts = _dictionaries(model.toxic, model.ordinary)
        self.known: dict[bytes, float] = {}

    def odds(self, words: list[bytes]) -> np.ndarray:
        """Log-odds of each window."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            x = _features(lengths(new, self.dicts[0]), lengths(new, self.dicts[1]), new)
            w = np.asarray(self.model.window)
            self.known.update(zip(new, np.clip(x @ w[:-1] + w[-1], -20, 20).tolist()))
        out = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        for k in [k for k in new if len(k) > LONG_WORD]:  # they would fill the memory
            del self.known[k]
        return out

    def rows(self, docs: list[list[bytes]]) -> np.ndarray:
        """The TOP largest log-odds and the logarithm of the number of windows of each document."""
        flat = self.odds([w for d in docs for w in d])
        out, at = np.zeros((len(docs), TOP + 1)), 0
        for i, d in enumerate(docs):
            o = flat[at : at + len(d)]
            at += len(d)
            out[i, :TOP] = -5.0
            best = -np.partition(-o, TOP - 1)[:TOP] if len(o) > TOP else o
            out[i, : len(best)] = -np.sort(-best) / 4
            out[i, TOP] = np.log1p(len(d)) / 4
        return out

    def scores(self, docs: list[list[bytes]]) -> np.ndarray:
        """Score of each document, 0 to 1."""
        w = np.asarray(self.model.document)
        if not w.any():
            return np.full(len(docs), self.model.base)
        return 1 / (1 + np.exp(-np.clip(self.rows(docs) @ w[:-1] + w[-1], -30, 30)))


def _document_rows(model: Model, docs: list[list[bytes]]) -> np.ndarray:
    scorer, out = Scorer(model), []
    for i in range(0, len(docs), 500):
        out.append(scorer.rows(docs[i : i + 500]))
    return np.concatenate(out)


def _score(model: Model, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in sliced(batches, "_text"):
            s = np.clip(scorer.scores([windows(t) for t in utf8(b.column("_text"))]), 0.0, 1.0)
            yield pa.record_batch([*[b.column(f) for f in fields], pa.array(s)], names=[*fields, "_score"])

    return run


def held_out(id):
    """Whether an id's row is never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out. A row with several labels counts as toxic if
    one says so; null labels and ids are left out."""
    marks = labels.where(F.col(id).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id).alias("_i")).agg(F.max("toxic").alias("_y"))
    marks = marks.where(~held_out(F.col("_i")))
    share = marks.agg(F.avg(F.col("_y").cast("double"))).first()[0]
    got = []
    for y, n in ((1, FIT_TOXIC), (0, FIT_ORDINARY)):
        some = F.broadcast(marks.where(F.col("_y") == y).orderBy(F.xxhash64("_i"), "_i").limit(n))  # n ids at most
        rows = docs.select(column(docs, id).alias("_i"), column(docs, text).alias("_t")).join(some, "_i").where(F.length("_t") <= LONGEST).withColumn("_h", F.xxhash64("_i"))
        got += rows.collect()
    got.sort(key=lambda r: (-r["_y"], r["_h"], r["_i"], r["_t"]))
    return fit([r["_t"].encode() for r in got], [r["_y"] for r in got], share)


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns with score and predicted for each row; null and empty texts get the score of a text without
    windows. Equal texts get equal scores."""
    names = [f"_c{i}" for i in range(len(keep))]
    slim = docs.select(*[column(docs, c).alias(f) for c, f in zip(keep, names)], column(docs, text).alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    out = slim.mapInArrow(_score(model, names), f"{fields}, _score double")
    return out.select(*[F.col(f).alias(c) for c, f in zip(keep, names)], F.col("_score").alias("score"), F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"))
