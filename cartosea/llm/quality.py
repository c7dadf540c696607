"""Quality rules from tokeniser fertility.

Public vocabularies tell ordinary text of a language from junk: a document is measured by its characters per token in
two vocabularies, the share of its pieces that fall back to bytes, and the entropy of its pieces in bits. For each
language (column `lang`; the dominant script where there is none) the corpus gives each measure's median and median
absolute deviation over all documents, and a document outside the band around the median is rejected. Entropy grows
with length, so its medians and deviations are those of the language's documents of like length. Texts that are too short or repeat themselves fail beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.llm.bpe import _CUT, coder
from cartosea.llm.common import LONG_WORD, column, sliced, stage, text_key, tidy, utf8
from cartosea.llm.wordhash import Words, covered

MIN_WORDS, REPEAT_PERCENT, RUN = 10, 20, 5
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Median absolute deviations that each measure may be off its language's median; a deviation counts as LEAST of the
#: median at least, and the band widens as 1/sqrt for texts shorter than the language's median length.
SPREAD = {"chars_per_token": 5.0, "chars_per_piece": 7.0, "byte_share": 5.0}
LEAST = 0.01
#: The least deviation of the share of pieces that fall back to bytes; its median is mostly 0.
LEAST_SHARE = 0.05
#: Deviations that entropy may be off, the least one in bits, and the documents that a doubling of lengths needs for a
#: median of its own; fewer are held against the nearest one that has them.
ENTROPY_SPREAD, LEAST_BITS, ENOUGH = 7.0, 0.1, 20
#: The least entropy against log2 of the number of pieces, whatever the language.
LEAST_ENTROPY = 0.35
#: Distinct words that a worker keeps measured.
CACHE = 150_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_pieces long, n_byte_pieces long, n_tokens long, entropy double, script string"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


class _Vocabularies:
    """A worker's two vocabularies with the words that it has measured."""

    def __init__(self, pieces: str, tokens: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.one = coder(tokens)._core_bpe.encode_single_piece
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.known: dict[bytes, tuple[bytes, int]] = {}

    def measure(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Piece ids (32-bit) and number of byte-level tokens of each word."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        long = {}
        if new:
            texts = [w.decode() for w in new]
            for w, t, ids in zip(new, texts, self.sp.encode(texts, num_threads=1)):
                (self.known if len(w) <= LONG_WORD else long)[w] = np.asarray(ids, np.int32).tobytes(), sum(len(self.one(x.encode())) for x in _CUT.findall(" " + t))
        known = self.known
        got = [long[w] if w in long else known[w] for w in words] if long else [known[w] for w in words]
        return [g[0] for g in got], np.fromiter((g[1] for g in got), np.int64, len(got))


_LOADED: dict[tuple[str, str], _Vocabularies] = {}


def _repeats(w: Words, n: int) -> np.ndarray:
    """Words of each text in a 5-word window that the text has twice or more."""
    at = np.flatnonzero(w.inside(RUN))
    if not len(at):
        return np.zeros(n, np.int64)
    code = w.windows(RUN)[at] ^ ((w.doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, inv, c = np.unique(code, return_inverse=True, return_counts=True)
    return np.bincount(w.doc, covered(len(w.hash), at[c[inv] > 1], RUN), n).astype(np.int64)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else ()
    return len(lines) - len(set(lines))


def _script(arr: np.ndarray, begin: np.ndarray) -> list[str]:
    """latin, wide (three-byte letters) or other: the commonest kind of character among letters."""
    def per(mask):
        run = np.concatenate([[0], np.cumsum(mask)])
        return run[begin[1:]] - run[begin[:-1]]
    latin = per(((arr | 32) >= 97) & ((arr | 32) <= 122)) + per((arr >= 0xC3) & (arr <= 0xC9))
    other, wide = per((arr >= 0xCA) & (arr < 0xE0)), per(arr >= 0xE0)
    return [("latin", "other", "wide")[i] for i in np.argmax(np.stack([latin, other, wide]), 0)]


def _measure(fields: list[str], pieces: str, tokens: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (pieces, tokens) not in _LOADED:
            _LOADED[pieces, tokens] = _Vocabularies(pieces, tokens)
        v = _LOADED[pieces, tokens]
        for b in sliced(batches, "_body"):
            texts = utf8(b.column("_body"))
            n = len(texts)
            w = Words(texts)
            # word characters: code points (bytes that start one) outside white space
            in_word = np.zeros(len(w.buf) + 1, np.int8)
            in_word[w.start] += 1
            in_word[w.end] -= 1
            chars = np.concatenate([[0], np.cumsum((np.cumsum(in_word[:-1]) > 0) & ((w.buf & 0xC0) != 0x80))])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.buf])])
            per = lambda run, at=w.begin: run[at[1:] - 1] - run[at[:-1]]
            uniq, first, inv = np.unique(w.hash, return_index=True, return_inverse=True)
            raw = w.raw
            ids, toks = v.measure([raw[s:e] for s, e in zip(w.start[first].tolist(), w.end[first].tolist())])
            size = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            flat, begin = np.frombuffer(b"".join(ids), np.int32), np.concatenate([[0], np.cumsum(size)])
            byte_run = np.concatenate([[0], np.cumsum(v.is_byte[flat])])
            bytes_of = byte_run[begin[1:]] - byte_run[begin[:-1]]
            total = lambda x: np.bincount(w.doc, x[inv], n).astype(np.int64) if len(inv) else np.zeros(n, np.int64)
            n_pieces = total(size)
            # entropy: pieces of each (document, word), weighted by how often the word stands there
            pair, times = np.unique(w.doc * max(1, len(uniq)) + inv, return_counts=True)
            doc, word = pair // max(1, len(uniq)), pair % max(1, len(uniq))
            k = size[word]
            stop = np.cumsum(k)
            where = np.repeat(begin[word] - (stop - k), k) + np.arange(int(stop[-1]) if len(stop) else 0)
            code, inv2 = np.unique(np.repeat(doc, k) * (1 << 20) + flat[where], return_inverse=True)
            count = np.bincount(inv2, np.repeat(times, k)) if len(code) else np.zeros(0)
            h = np.bincount(code >> 20, count * np.log2(np.maximum(count, 1)), n) if len(code) else np.zeros(n)
            entropy = np.where(n_pieces > 0, np.log2(np.maximum(n_pieces, 1)) - h / np.maximum(n_pieces, 1), 0.0)
            out = [w.n.astype(np.int64), per(chars), per(symbols), np.asarray([_dup_lines(t) for t in texts], np.int64), _repeats(w, n), n_pieces, total(bytes_of), total(toks), np.maximum(entropy, 0.0)]
            names = [x.split()[0] for x in MEASURES.split(", ")]
            yield pa.record_batch([*[b.column(f) for f in fields], *[pa.array(x) for x in out], pa.array(_script(w.buf, w.begin))], names=[*fields, *names])
        v.known.clear()
        tidy()

    return run


#: What score_documents adds.
OUT = (*(x.split()[0] for x in MEASURES.split(", ")), "chars_per_piece", "chars_per_token", "byte_share", "relative_entropy", "base_failed", "kept")


def measures(docs: DataFrame, keep: list[str], text: str = "text", pieces: str | None = None, tokens: str | None = None) -> DataFrame:
    """keep's columns and, for each row, MEASURES and the ratios that the bands look at. Null and empty texts: zeros."""
    kept = docs.select(*[column(docs, c) for c in keep])
    slim = docs.select(*[column(docs, c) for c in keep], column(docs, text).alias("_body"))
    run = _measure(keep, pieces or public_tokenizers.path(PIECES), tokens or public_tokenizers.path(BYTES))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    out = slim.mapInArrow(run, f"{fields}, {MEASURES}")
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.withColumns({
        "chars_per_piece": ratio("word_chars", "n_pieces"),
        "chars_per_token": ratio("word_chars", "n_tokens"),
        "byte_share": ratio("n_byte_pieces", "n_pieces"),
        "relative_entropy": F.col("entropy") / F.log2(F.greatest(F.col("n_pieces"), F.lit(2))),
    })


def _median(value):
    """The exact median of values rounded to 1/1024: the same whatever the order in which parts are merged, and counted
    by at most as many distinct values as the measures have steps (some ten thousands)."""
    return F.percentile(F.round(value * 1024) / 1024, 0.5)


def _small(bands: DataFrame) -> DataFrame:
    """Bands of so few groups that every executor can hold them; more are joined by shuffle."""
    return F.broadcast(bands) if bands.count() <= 10_000 else bands


def _by_length(measured: DataFrame) -> DataFrame:
    """measured with `_bits` (log2 of the number of pieces) and medians of it and of entropy, and entropy's median
    absolute deviation, over the group's documents of like length."""
    bits = F.log2(F.greatest(F.col("n_pieces"), F.lit(1)))
    sized = measured.withColumns({"_bits": bits, "_octave": F.floor(bits)})
    many = sized.where("n_words > 0").groupBy(F.col("_group").alias("_g3"), "_octave").count().where(F.col("count") >= ENOUGH)
    dense = many.groupBy("_g3").agg(F.sort_array(F.collect_list("_octave")).alias("_dense"))
    with_dense = sized.join(_small(stage(dense, "quality-lengths")), F.col("_group").eqNullSafe(F.col("_g3")), "left")
    nearest = F.array_min(F.transform("_dense", lambda x: F.struct(F.abs(x - F.col("_octave")).alias("off"), x.alias("at"))))["at"]
    near = with_dense.withColumn("_like", F.coalesce(nearest, F.lit(-1)))
    same = lambda g, k: F.col("_group").eqNullSafe(F.col(g)) & (F.col("_like") == F.col(k))
    mid = near.where("n_words > 0").groupBy(F.col("_group").alias("_g4"), F.col("_like").alias("_k4")).agg(
        _median(F.col("_bits")).alias("_mid_bits"), _median(F.col("entropy")).alias("_mid_entropy")
    )
    near = near.join(_small(stage(mid, "quality-lengths")), same("_g4", "_k4"), "left")
    off = near.where("n_words > 0").groupBy(F.col("_group").alias("_g5"), F.col("_like").alias("_k5")).agg(_median(F.abs(F.col("entropy") - F.col("_mid_entropy"))).alias("_mad_entropy"))
    return near.join(_small(stage(off, "quality-lengths")), same("_g5", "_k5"), "left")


def judge(measured: DataFrame) -> DataFrame:
    """measured (with `_group`, the language or script) plus base_failed and kept, by the corpus's own bands."""
    mid = measured.groupBy(F.col("_group").alias("_g1")).agg(
        *[_median(F.col(c)).alias(f"_mid_{c}") for c in SPREAD],
        F.pow(F.lit(2.0), _median(F.log2(F.greatest(F.col("n_words"), F.lit(1))))).alias("_mid_words"),
    )
    near = measured.join(_small(stage(mid, "quality-bands")), F.col("_group").eqNullSafe(F.col("_g1")))
    off = near.groupBy(F.col("_group").alias("_g2")).agg(*[_median(F.abs(F.col(c) - F.col(f"_mid_{c}"))).alias(f"_mad_{c}") for c in SPREAD])
    full = _by_length(near.join(_small(stage(off, "quality-bands")), F.col("_group").eqNullSafe(F.col("_g2"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    widen = F.sqrt(F.greatest(F.lit(1.0), F.col("_mid_words") / F.greatest(F.col("n_words"), F.lit(1))))
    good = F.col("relative_entropy") >= LEAST_ENTROPY
    for c, times in SPREAD.items():
        least = F.lit(LEAST_SHARE) if c == "byte_share" else LEAST * F.col(f"_mid_{c}")
        half = times * widen * F.greatest(F.col(f"_mad_{c}"), least)
        good &= F.abs(F.col(c) - F.col(f"_mid_{c}")) <= half
    # a longer text has at least the entropy of a shorter one of its kind, and at most what the added length allows
    longer, bits = F.col("_bits") - F.col("_mid_bits"), F.col("entropy") - F.col("_mid_entropy")
    half = ENTROPY_SPREAD * F.greatest(F.col("_mad_entropy"), F.lit(LEAST_BITS))
    good &= (bits >= F.least(longer, F.lit(0.0)) - half) & (bits <= F.greatest(longer, F.lit(0.0)) + half)
    return full.withColumns({"base_failed": failed, "kept": ~failed & F.coalesce(good, F.lit(False))}).select(*measured.columns, "base_failed", "kept")


def score_documents(docs: DataFrame, keep: list[str], text: str = "text", lang: str | None = "lang") -> DataFrame:
    """keep's columns with all measures, base_failed and kept.

    Null, empty and blank texts have no words and fail the base rule; a null language is a group of its own; documents
    without a language column are grouped by script. Equal rows get equal verdicts, and so does every run. An empty
    table gives no rows. A column of docs that is named like a measure or a verdict gives way to it.
    """
    keep = [c for c in keep if c not in OUT]
    has = lang is not None and lang in docs.columns
    names = [f"_c{i}" for i in range(len(keep))]
    cols = [column(docs, c).alias(n) for c, n in zip(keep, names)]
    slim = docs.select(*cols, column(docs, text).alias("_text"), *([column(docs, lang).cast("string").alias("_lang")] if has else []))
    out = measures(slim, [*names, *(["_lang"] if has else [])], "_text").withColumn("_group", F.col("_lang" if has else "script"))
    scored = judge(stage(out, "quality-measures"))
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *[c for c in scored.columns if not c.startswith("_")])


def keep_good(docs: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    wide = docs.select(*[column(docs, c).alias(n) for c, n in zip(docs.columns, names)])
    own = dict(zip(docs.columns, names))
    good = score_documents(wide.withColumn("_key", text_key(F.col(own[text]))), ["_key", *([own[lang]] if lang in own else [])], own[text], own.get(lang))
    good = good.where("kept").select("_key", *([F.col(own[lang]).alias("_l")] if lang in own else [])).distinct()
    left = wide.withColumn("_key", text_key(F.col(own[text])))
    on = left["_key"] == good["_key"]
    if lang in own:
        on &= left[own[lang]].eqNullSafe(good["_l"])
    return left.join(good, on, "left_semi").select(*[F.col(n).alias(c) for c, n in own.items()])
