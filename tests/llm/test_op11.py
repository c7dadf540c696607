import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cartosea.llm import alignment

ODD = [None, "", " ", "\n", "   ", "  a  b\n\n c\t\td \r\n e", "a▁b", "<|endoftext|> <s></s> <0x41>", "\x1c a\x1d\x1e b", "日本語 テキスト　です\nええ", "٣٤ abc ۱۲", "'S 's don't  DON'T", "\x85 a\x85b", "𝔘𝔫𝔦 😀😀 👩‍👩‍👧 ", "a" * 500, " " * 300 + "x", "\n" * 300 + "x", "x\r\ny;\r\n z", "a \t b", "\x00a", "same words", "same words"]


def _rows():
    rnd = random.Random(5)
    alphabet = [*"ab 1'.\n\t\r ", "é", "日", "\xa0", "😀", "　", "ß", "  ", "don't", "the ", " of", "\x85"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    return [(None if i == 7 else i // 2 if i > 160 else i, t) for i, t in enumerate(texts)]


def brute(rows):
    """Groups by walking both token lists; counts by a dictionary."""
    path = public_tokenizers.path
    a_side = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    letters = alignment._byte_level()
    links, shapes = [], []
    for _, t in rows:
        links.append(Counter())
        shapes.append((0, 0, 0, ""))
        if not t:
            continue
        e = a_side.encode(" " + t, add_special_tokens=False)
        a, b = e.ids, b_side.encode(t)
        x = [bytes(letters[c] for c in s) for s in e.tokens]
        y = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, b_side.id_to_piece(b))]
        if not b"".join(x) == b"".join(y) == (" " + t).encode():
            continue
        i = j = at_a = at_b = 0
        groups, g, h = [], [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                g.append(a[i])
                at_a += len(x[i])
                i += 1
            else:
                h.append(b[j])
                at_b += len(y[j])
                j += 1
            if at_a == at_b and g and h:
                groups.append(",".join(map(str, g)) + "|" + ",".join(map(str, h)))
                links[-1].update((p, q) for p in g for q in h)
                g, h = [], []
        shapes[-1] = (len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    docs = Counter(k for c in links for k in c)
    top = defaultdict(int)
    for (p, _), n in docs.items():
        top[p] = max(top[p], n)
    return [(d, *s[:3], sum(c.values()), sum(n for k, n in c.items() if docs[k] == top[k[0]]), sum(n * docs[k] for k, n in c.items()), s[3]) for (d, _), s, c in zip(rows, shapes, links)]


def test_equals_brute_force(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, slice string").repartition(5)
    assert sorted(map(tuple, alignment.digests(docs).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_pair_counts_and_groups(spark):
    docs = spark.createDataFrame([(1, "the cat", 5), (1, "the cat", 6), (2, "the", 7)], "doc_id long, text string, alignment int")
    counts = alignment.pair_counts(alignment.slices(docs)).collect()
    assert max(r["docs"] for r in counts) == 3 and all(r["best"] for r in counts)
    out = alignment.align(docs).collect()
    assert out[0]["alignment"][0]["start"] == 0 and out[0]["alignment"][-1]["stop"] == 8
    assert [g.stop for g in out[0]["alignment"][:-1]] == [g.start for g in out[0]["alignment"][1:]]


def test_components_are_minimal_groups():
    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randint(1, 60)
        a, b = (np.array(sorted({n, *rnd.sample(range(1, n + 1), rnd.randint(1, n))})) for _ in range(2))
        root = alignment.components(a, b)
        stops = sorted(set(a.tolist()) & set(b.tolist()))
        want = [next(i for i, s in enumerate(stops) if e <= s) for e in [*a.tolist(), *b.tolist()]]
        assert len(set(zip(root.tolist(), want))) == len(set(want)) == len(set(root.tolist()))


def test_large_groups_are_multiplied():
    left, right = np.array([1] * 90 + [2] * 10 + [3]), np.array([7] * 80 + [8, 9])
    keys, times, count = alignment._links(left, right, np.array([0, 100]), np.array([100, 1]), np.array([0, 81]), np.array([81, 1]))
    assert dict(zip(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist()), times.tolist())) == {(1, 7): 7200, (1, 8): 90, (2, 7): 800, (2, 8): 10, (3, 9): 1}
    assert count.tolist() == [4, 1]


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 300_000 + "x", "日" * 100_000, "\n" * 300_000])
def test_very_long(spark, text):
    (r,) = alignment.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["n_a"] and r["n_links"] >= r["n_groups"] > 0


def test_empty(spark):
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = alignment.digests(spark.createDataFrame([(4, None)], "doc_id long, text string")).collect()
    assert tuple(r) == (4, 0, 0, 0, 0, 0, 0, "")
