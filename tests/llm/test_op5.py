import os

import pytest

from cartosea.llm import toxicity


def _auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = toxicity.score_documents(docs, model, ["doc_id"]).where(toxicity.held_out(toxicity.F.col("doc_id"))).join(labels, "doc_id").collect()
    assert _auc([r["score"] for r in got], [r["toxic"] for r in got]) > 0.85
    assert sum(r["predicted"] == r["toxic"] for r in got) > 0.9 * len(got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot " * 5), (3, "you idiot " * 5), (None, "calm words"), (6, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.learn(docs, labels), ["doc_id"]).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    none = toxicity.learn(docs.limit(0), labels.limit(0))
    assert toxicity.score_documents(docs.limit(0), none, ["doc_id"]).count() == 0


def test_held_out_is_crc32_of_the_id(spark):
    import zlib

    rows = spark.range(50).select("id", toxicity.held_out(toxicity.F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
