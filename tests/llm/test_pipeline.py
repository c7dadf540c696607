import hashlib
import random

import public_tokenizers as P
import tiktoken

from cartosea.llm import bpe, quality
from cartosea.llm.decontaminate import words_of
from tests.llm import brute
from tests.llm.test_op3 import _distance


def _corpus(tmp_path, spark):
    rnd = random.Random(11)
    vocab = ["the", "and", "river", "harbour", "vessel", "morning", "between", "quiet", "lantern", "meadow", "signal", "winter", "copper", "garden", "letter", "window", "market", "bridge", "silver", "forest"]
    text = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randrange(9) or "") for _ in range(n))
    passage, items = text(60), [(1, text(20)), (2, text(25))]
    docs = [(i, text(rnd.randint(40, 90)), "en") for i in range(20)]
    docs += [(20, docs[3][1], "en"), (21, docs[4][1] + " tail", "en"), (22, text(30) + " " + passage + " " + text(30), "en"), (23, text(35) + " " + passage, "en")]
    docs += [(24, text(40) + " " + items[0][1] + " " + text(20), "en"), (25, "too short", "en"), (26, None, None), (27, "same words " * 40, "en")]
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, items


def test_run_against_brute_force(spark, tmp_path):
    import corpus_pipeline as pipe

    docs, items = _corpus(tmp_path, spark)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in quality.score_documents(table, ["doc_id"]).where("kept").collect()}
    assert kept >= {d for d, t, _ in docs if d < 24} and not kept & {25, 26, 27}
    rows = [(d, t) for d, t, _ in docs if d in kept]
    rows = [(d, t) for (d, t), r in zip(rows, brute.near_components(rows, 5, 80)) if r[3]]
    assert 20 not in dict(rows) and 21 not in dict(rows)
    cut = []
    for (d, t), (_, n, gone, sha) in zip(rows, brute.substring_dedup(rows)):
        cut.append((d, t, gone, sha))
    out = pipe.run(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in out.collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    third = {r["doc_id"]: r["text"] for r in pipe.repeated_passages(spark, spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], table.schema), str(tmp_path)).collect()}
    want = set()
    for d, t, gone, sha in cut:
        if gone:
            assert hashlib.sha256(third[d].encode()).hexdigest() == sha
        else:
            assert third[d] == t
        w = words_of(third[d])
        if not any(_distance(w, words_of(x)) <= len(words_of(x)) // 5 for _, x in items):
            want.add(d)
    assert got.keys() == want and 24 not in want and {22, 23} <= want
    for d in want:
        ids = enc.encode_ordinary(third[d])
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(third[d].encode()).hexdigest()


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline as pipe

    _corpus(tmp_path, spark)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in pipe.STAGES[:-1]:
        assert f(spark, table.limit(0), str(tmp_path)).columns == table.columns
