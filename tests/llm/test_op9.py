import random

from cartosea.llm.near_dedup import JOINED, chunks, keep_one, limit, mark_documents
from tests.llm.brute import near_components


def _rows():
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE TWO"), (8, "é"), (9, "É")]
    d = 10
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(5, 150))]
        for _ in range(rnd.randint(1, 8)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 20))):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((d, " ".join(w)))
            d += 1
            if rnd.random() < 0.2:
                rows.append((d, rows[-1][1]))
                d += 1
            base = w if rnd.random() < 0.5 else base
    rnd.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = _rows()
    for size, percent in ((3, 85), (5, 80)):
        got = mark_documents(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size, percent=percent)
        assert sorted(map(tuple, got.collect())) == sorted(near_components(rows, size, percent))


def test_keep_one_keeps_columns_and_one_of_each(spark):
    rows = _rows()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key int, _id string")
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(d for d, _, _, k in near_components(rows, 5, 80) if k)
    assert keep_one(df.limit(0)).count() == 0


def test_pigeonhole():
    for s in (0.8, 0.85):
        assert len(chunks(s)) * 2 > limit(JOINED, s) and sum(map(len, chunks(s))) == JOINED


def test_one_bucket_of_many_unlike_texts(spark):
    """Texts that share so much that their keys meet, yet not enough to be linked; some pairs among them are."""
    rnd = random.Random(8)
    common, rows = " ".join(f"c{i}" for i in range(24)), []
    for i in range(20_000):
        rows.append((i, common + " " + " ".join(f"u{i}x{j}" for j in range(rnd.randint(14, 20)))))
    for i in range(40):
        rows.append((20_000 + i, rows[rnd.randrange(20_000)][1] + f" end{i}"))
    got = {r["doc_id"]: r["component_id"] for r in mark_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {}
    by = {t: i for i, t in rows[:20_000]}
    for i, t in rows[20_000:]:
        want[i] = by[t.rsplit(" ", 1)[0]]
    assert all(got[i] == want.get(i, i) for i, _ in rows)
