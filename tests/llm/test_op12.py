import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartosea.llm import fingerprint, shards

SCHEMA = "doc_id long, text string"


def plain_hash(text):
    """The same polynomials, one code point at a time."""
    return tuple(sum((ord(c) + 1) * pow(b, i, fingerprint.P) for i, c in enumerate(text)) % fingerprint.P for b in fingerprint.BASES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00é😀", max_size=30), min_size=1, max_size=4), st.randoms(use_true_random=False))
def test_spans_and_extensions(texts, rnd):
    p, whole = fingerprint.Prefixes(texts), "".join(texts)
    at = [sorted((rnd.randint(0, len(whole)), rnd.randint(0, len(whole)))) for _ in range(20)]
    a, b = np.array([x for x, _ in at]), np.array([y for _, y in at])
    assert p.spans(a, b).tolist() == [h[0] << 31 | h[1] for h in (plain_hash(whole[x:y]) for x, y in at)]
    limit = len(whole) - np.maximum(a, b)
    want = [next((k for k in range(n) if whole[x + k] != whole[y + k]), int(n)) for x, y, n in zip(a, b, limit)]
    assert p.extensions(a, b, limit).tolist() == want


def _text(rnd, n):
    return "".join(rnd.choice("abcdefgh ijklmnop\né日") for _ in range(n))


def test_likeness_follows_what_is_shared():
    rnd = random.Random(3)
    for n in (1, 2, 20, 33, 100, 700, 5000, 60_000):
        a, b = _text(rnd, n), _text(rnd, n)
        moved = "new start " + a
        edited = a[: n - n // 2] + b[: n // 2]
        fa, fb, fm, fe, again = fingerprint.Prefixes([a, b, moved, edited, a]).fingerprints()
        assert fa == again == fingerprint.Prefixes([a]).fingerprints()[0] and fingerprint.likeness(fa, again) == 1.0
        assert fingerprint.likeness(fa, fe) == fingerprint.likeness(fe, fa)
        if n >= 20:
            assert 0.4 <= fingerprint.likeness(fa, fe) <= 0.62 and fingerprint.likeness(fa, fb) < 0.2
        if n >= 5000:
            assert fingerprint.likeness(fa, fm) > 0.8
        for f, t in ((fa, a), (fe, edited)):
            x = fingerprint.Fingerprint(f)
            places = [1 << x.stride] * len(x.grid)
            assert x.n == len(t) and x.grid.tolist() == [h[0] << 31 | h[1] for h in (plain_hash(t[: (k + 1) * s]) for k, s in enumerate(places))][: len(x.grid)] if n <= 700 else True


def test_odd_texts():
    texts = ["", "a", "a" * 5000, "a" * 5001, "\x00", "\x00\x00", "ab" * 3000]
    prints = fingerprint.Prefixes(texts).fingerprints()
    assert len(set(prints)) == len(texts)
    assert all(0 <= fingerprint.likeness(x, y) <= 1 for x in prints for y in prints)
    assert fingerprint.likeness(prints[0], prints[0]) == 1 and fingerprint.likeness(prints[0], prints[1]) == 0
    assert fingerprint.likeness(prints[2], prints[3]) > 0.9


def brute(rows):
    """Neighbours by one sort, fingerprints of single texts."""
    import xxhash

    def tie(t):
        h = xxhash.xxh64(t.encode(), seed=42).intdigest()
        return h - 2**64 if h >= 2**63 else h

    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])), reverse=True)
    one = lambda t: fingerprint.Prefixes([t]).fingerprints()[0]
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), one(t), one(e), fingerprint.likeness(one(t), one(e)), fingerprint.likeness(one(t), one(after))))
    return out


@pytest.mark.parametrize("shard,batch", [(1 << 25, 1 << 20), (3000, 500), (300, 1)])
def test_equals_brute_force(spark, monkeypatch, shard, batch):
    monkeypatch.setattr(fingerprint, "SHARD", shard)
    monkeypatch.setattr(shards, "SAMPLES", 2)
    rnd = random.Random(shard)
    rows = [(rnd.choice([None, i, i, i, 7]), rnd.choice([None, "", "é", "copy", "copy", _text(rnd, rnd.choice([1, 5, 40, 900]))])) for i in range(120)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", shard int, tail string").repartition(4)
    found = shards.cuts
    monkeypatch.setattr(fingerprint, "cuts", lambda *a: found(*a))
    assert sorted(map(repr, map(tuple, fingerprint.compare_with_next(docs).collect()))) == sorted(map(repr, brute(rows)))


def test_one_row_empty_table_and_long_text(spark):
    assert fingerprint.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    (r,) = fingerprint.compare_with_next(spark.createDataFrame([(3, "abcd")], SCHEMA)).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0
    rows = fingerprint.compare_with_next(spark.createDataFrame([(3, "ab" * 1_500_000), (4, None)], SCHEMA)).collect()
    assert {r["doc_id"]: r["n_chars"] for r in rows} == {3: 3_000_000, 4: 0}


def test_columns(spark):
    df = spark.createDataFrame([("a b", 1, "old"), (None, 2, "old")], "text string, x long, fingerprint string")
    out = fingerprint.add_fingerprints(df)
    assert out.columns == ["text", "x", "fingerprint"]
    assert [r[0] for r in out.select(fingerprint.likeness_of("fingerprint", "fingerprint")).collect()] == [1.0, 1.0]
