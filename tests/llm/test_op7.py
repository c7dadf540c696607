import hashlib
import random

import public_tokenizers as P
import tiktoken

from cartosea.llm import bpe


def test_against_the_library(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    rnd = random.Random(2)
    bits = ["the", " it's", "  ", "\n\n", "\t", " ", "\x1c", "12", "éà", "日本", "!!", "<|endoftext|>", "🙂", " x", "x" * 700, "'ll"]
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (None, "b c"), (7, "word " * 30000)]
    rows += [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 80)))) for i in range(10, 200)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, word string").repartition(3)
    out = bpe.digests(df).collect()
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_empty(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decode_and_one_scan(spark):
    df = spark.createDataFrame([(1, "héllo  wörld"), (2, None)], "doc_id long, text string")
    out = bpe.decode(bpe.encode(df))
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in out.collect()} == {1: "héllo  wörld", 2: ""}
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_unknown_ids_are_errors(spark):
    import pytest
    from pyspark.errors import PythonException

    for bad in (-1, 10**6):
        with pytest.raises(PythonException, match="vocabulary|below"):
            bpe.decode(spark.createDataFrame([([bad],)], "ids array<int>")).collect()
