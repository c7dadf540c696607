import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cartosea.llm import token_files as K
from cartosea.llm.common import workspace


def test_blocks_round_trip_and_checksums():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (5000, 1), (20_000, 40), (9000, 60_000)):
        ids = (rng.integers(0, top, n) ** 2 % 49_408).astype(np.uint32)
        sizes = np.array([n // 3, n - n // 3])
        data = K.dump([1, None], sizes, ids)
        docs, back_sizes, back = K.load(data)
        assert docs == [1, None] and back_sizes.tolist() == sizes.tolist() and back.tolist() == ids.tolist()
    with pytest.raises(ValueError):
        K.load(data[:-40] + bytes([data[-40] ^ 1]) + data[-39:])
    text = np.tile(rng.integers(0, 49_000, 50), 400).astype(np.uint32)
    assert len(K.dump([1], np.array([len(text)]), text)) < 0.2 * 2 * len(text)


def _want(rows):
    t = Tokenizer.from_file(P.path(K.VOCABULARY))
    out, at = [], 0
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip_against_the_library(spark):
    rnd = random.Random(9)
    bits = ["The", "l'été", " ", "\n", "\t", "\xa0", "\x1c", "é", "<|endoftext|>", "Ｗide", "日本", "12", "!?", "it's", "x" * 300, "　", "İ"]
    rows = [(None, "a"), (5, None), (6, ""), (7, "b"), (7, "a"), (8, "word " * 20_000)]
    rows += [(i * 1000, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))) for i in range(10, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, K.round_trip(df).collect()), key=lambda r: r[1])
    # rows of one id stand in the order of a hash of their text
    tie = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) as h").collect()}
    assert got == _want(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]])))
    assert K.round_trip(df.limit(0)).count() == 0


def test_files_are_the_same_for_any_order(spark):
    df = spark.createDataFrame([(i, f"text {i} again") for i in range(50)], "doc_id long, text string")
    a, b = (K.write(x, workspace(spark, "t")) for x in (df, df.repartition(5, "text")))
    assert sorted(r["sha256"] for r in a.collect()) == sorted(r["sha256"] for r in b.collect())


def test_many_shards_and_long_texts(spark, monkeypatch):
    """A hot id, an outlying one and one very long text: even shards, one order."""
    monkeypatch.setattr(K, "SHARD_BYTES", 20_000)
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{rnd.randrange(999)}" for _ in range(20))) for i in range(1500)] + [(5, f"again {i} " * 9) for i in range(700)] + [(10**15, "far"), (40, "long " * 100_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, tie string").repartition(5)
    m = K.write(df, workspace(spark, "t"))
    got = sorted(map(tuple, K.read(m).selectExpr("doc_id", "start", "n_tokens", "crc32(ids)").collect()), key=lambda r: r[1])
    tie = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    assert got == _want(sorted(rows, key=lambda r: (r[0], tie[r[1]])))
    assert m.select("shard").distinct().count() > 10


def test_long_chunks_are_not_remembered():
    words = K._Words(P.path(K.VOCABULARY))
    texts = [f"word {'ab' * 5000}{i} word" for i in range(300)]
    first = words.encode(texts)
    assert words.encode(texts) == first and len(words.young) == 1 and len(set(first)) == 300


def test_words_are_encoded_once_whatever_stands_around_them():
    """Case, marks and digits beside a word don't make it new; ids are the library's for any text."""
    words = K._Words(P.path(K.VOCABULARY))
    marks = ["{}", "({})", "{}.", '"{}",', "{}7", "x@{}", "{}'S", "{}'re!", "?{}"]
    texts = [m.format(w) for w in ("Haanth", "haanth", "HAANTH", "Éßÿñ") for m in marks]
    want = lambda x: [np.asarray(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(x, add_special_tokens=False)]
    assert words.encode(texts) == want(texts) and len(words.young) < 20
    rnd = random.Random(5)
    bits = ["É", "ß", "Þ", "e\u0301", "\u0301", "×", "÷", "ª", "µ", "\x85", "\xa0", "\x1c", "\x00", "\x7f", "\t", "\r", "\x0b", "\n", " ", "  ", "'", "'S", "'lL", "'VE", "''d", "a", "Z", "09", "²", "½", "İ", "Σ", "K", "_", "</w>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "日本", "\u200b", "\U0001f600"]
    for some in (bits, [b for b in bits if not K._BEYOND.search(b) and "<|" not in b]):
        texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
        assert words.encode(texts) == want(texts)


def _phrased(n: int, seed: int):
    rnd = random.Random(seed)
    phrases = [np.asarray([rnd.randrange(49_000) for _ in range(rnd.randint(1, 6))], "<u4").tobytes() for _ in range(400)]
    number = np.array([min(399, int(rnd.expovariate(0.02))) for _ in range(n)], np.int32)
    return phrases, number, np.frombuffer(b"".join(phrases[i] for i in number), "<u4")


def test_a_phrase_is_coded_as_one_number(monkeypatch):
    """What is coded grows with words, not with their ids; phrases that no document has aren't written."""
    phrases, number, ids = _phrased(30_000, 1)
    coded, real = [], K.encode_block
    monkeypatch.setattr(K, "encode_block", lambda x, letters: coded.append(len(x)) or real(x, letters))
    data = K.dump([1, 2], np.array([10_000, 20_000]), number, [*phrases, np.asarray([7] * 90_000, "<u4").tobytes()])
    docs, sizes, back = K.load(data)
    assert docs == [1, 2] and back.tolist() == ids.tolist() and sum(coded) < 32_000 < 3 * 32_000 < len(ids)
    assert sizes.tolist() == [sum(len(phrases[i]) // 4 for i in x) for x in (number[:10_000], number[10_000:])]


def test_blocks_stand_alone_and_any_damage_is_seen(monkeypatch):
    """Several blocks, whose lanes differ in length; a changed byte anywhere is an error, not other ids."""
    monkeypatch.setattr(K, "BLOCK", 3001)
    phrases, number, ids = _phrased(10_000, 2)
    data = K.dump([1], np.array([len(number)]), number, phrases)
    assert K.load(data)[2].tolist() == ids.tolist()
    rnd = random.Random(3)
    for i in [8, 12, 20, len(data) - 1, *(rnd.randrange(len(data)) for _ in range(60))]:
        with pytest.raises((ValueError, K.zstandard.ZstdError)):
            K.load(data[:i] + bytes([data[i] ^ 1 << rnd.randrange(8)]) + data[i + 1 :])
    letters = K._Letters(np.array([40, 40, 30, 8, 8, 0], np.int64))
    for n in (1, 63, 64, 127, 128, 129, 1000):
        some = np.array([rnd.randrange(6) for _ in range(n)])
        assert K.decode_block(K.encode_block(some, letters), n, letters).tolist() == some.tolist()


def test_rare_and_frequent_numbers():
    """More numbers than a group holds, all seen once, beside one that is nearly everything: intervals never vanish."""
    number = np.zeros(300_000, np.int32)
    number[::6] = np.arange(50_000)
    ids = (number * 7 % 49_408).astype(np.uint32)
    assert K.load(K.dump([0], np.array([len(ids)]), ids))[2].tolist() == ids.tolist()
    phrases = [np.asarray([i, i + 1], "<u4").tobytes() for i in range(50_000)]
    assert K.load(K.dump([0], np.array([len(number)]), number, phrases))[2].reshape(-1, 2)[:, 0].tolist() == number.tolist()


def test_a_file_takes_documents_until_it_is_full(monkeypatch):
    monkeypatch.setattr(K, "FILE_IDS", 20)
    words, texts = K._Words(P.path(K.VOCABULARY)), [None, "", "the the the", "of 日本 it's the", "a " * 50, "the"]
    col, at, files = K.pa.array(texts), 0, []
    while at < len(texts):
        file = K._File()
        while at < len(texts) and file.held < 20:
            at += file.add(words, list(range(at, len(texts))), col[at:])
        files.append(K.load(file.dump()))
    want = [[*words.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert [d for f in files for d in f[0]] == list(range(6)) and len(files) == 2
    assert [x for f in files for x in f[2].tolist()] == [x for w in want for x in w] and [n for f in files for n in f[1].tolist()] == [len(w) for w in want]


def test_files_and_memory_are_bounded_by_distinct_words_too(monkeypatch):
    """Texts whose words never come again: a file ends, and nothing of them is remembered for ever."""
    monkeypatch.setattr(K, "FILE_PHRASES", 500)
    monkeypatch.setattr(K, "CACHE", 200)
    words, texts, at, files = K._Words(P.path(K.VOCABULARY)), [" ".join("q" + "".join(chr(97 + n // d % 26) for d in (676, 26, 1)) for n in range(150 * i, 150 * i + 150)) for i in range(30)], 0, []
    while at < len(texts):
        file = K._File()
        while at < len(texts) and not file.full:
            at += file.add(words, list(range(at, len(texts)))[:7], K.pa.array(texts[at : at + 7]))
            assert len(words.young) + len(words.old) <= 800
        files.append(K.load(file.dump()))
    assert len(files) > 3 and [d for f in files for d in f[0]] == list(range(30))
    assert [x for f in files for x in f[2].tolist()] == [x for t in texts for x in [*words.tokenizer.encode(t, add_special_tokens=False).ids, 2]]
