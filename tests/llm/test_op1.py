import random

from cartosea.llm.substring_dedup import dedup_substrings
from tests.llm.brute import substring_dedup


def _check(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["_n_words"], r["_n_removed"], r["_kept_sha256"]) for r in dedup_substrings(df, size).collect())
    assert got == sorted(substring_dedup(rows, size))


def test_random_against_brute_force(spark):
    rnd = random.Random(1)
    pool = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(60)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a b"), (3, pool[0]), (4, pool[0]), (4, pool[0])]
    for i in range(5, 60):
        p = [rnd.choice(pool).split() for _ in range(rnd.randint(1, 3))]
        w = [x for q in p for x in q[rnd.randint(0, 20) : rnd.randint(30, 60)]]
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"x{rnd.random()}"
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
    rows.append((99, "orre " * 500))
    _check(spark, rows, 35)
    _check(spark, rows, 10)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, k long, h string")
    assert dedup_substrings(df).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, "z", 1, 7, "y")], "doc_id long, text string, k long, h string, copies int, _n_words int, c0 string")
    out = dedup_substrings(df)
    r = out.first()
    assert (r["k"], r["h"], r["copies"], r["text"], r["_n_words"], r["c0"]) == (5, "z", 1, "a b", 2, "y")
    assert out.columns == ["doc_id", "text", "k", "h", "copies", "c0", "_n_words", "_n_removed", "_kept_sha256", "_longest"]


def test_many_pieces_and_very_long_texts(spark, monkeypatch):
    from cartosea.llm import substring_dedup as S

    rnd = random.Random(3)
    shared = [" ".join(f"s{i}x{j}" for j in range(60)) for i in range(5)]
    rows = [(i, " ".join([f"u{i}", rnd.choice(shared), *(f"v{i}x{j}" for j in range(rnd.randint(0, 30)))])) for i in range(400)]
    long = " ".join(f"w{i % 70_000}" for i in range(100_000))
    rows += [(1000, long), (1001, long[5000:400_000]), (1002, "")]
    monkeypatch.setattr(S, "PIECE", 3000)
    monkeypatch.setattr(S, "BUCKET", 1500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = sorted((r["doc_id"], r["_n_words"], r["_n_removed"], r["_kept_sha256"]) for r in S.dedup_substrings(df).collect())
    assert got == sorted(substring_dedup(rows))


def _longest(rows, size):
    """The largest doubled length at which each text has a window that stands anywhere else."""
    words, best = [(t or "").split() for _, t in rows], [0] * len(rows)
    while True:
        count = {}
        for w in words:
            for i in range(len(w) - size + 1):
                count[tuple(w[i : i + size])] = count.get(tuple(w[i : i + size]), 0) + 1
        hit = [any(count[tuple(w[i : i + size])] > 1 for i in range(len(w) - size + 1)) for w in words]
        if not any(hit):
            return sorted((d, n) for (d, _), n in zip(rows, best))
        best = [size if h else n for h, n in zip(hit, best)]
        size *= 2


def test_longest_against_brute_force(spark):
    rnd = random.Random(4)
    fresh = lambda n: [f"u{rnd.random()}" for _ in range(n)]
    rows, d = [(1, "same " * 400), (2, None), (3, " ".join(fresh(90)))], 10
    for n in (34, 35, 36, 69, 70, 71, 80, 104, 105, 139, 140, 150, 279, 280, 281, 300, 560):
        part = fresh(n)
        for _ in range(2):
            rows.append((d, " ".join(fresh(rnd.randint(0, 40)) + part + fresh(rnd.randint(1, 40)))))
            d += 1
    copied = fresh(320)
    rows += [(d, " ".join(copied)), (d + 1, " ".join(copied)), (d + 2, " ".join(fresh(9) + copied[100:175] + fresh(9))), (d + 3, " ".join(fresh(5) + (p := fresh(70)) + p))]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["_longest"]) for r in got.collect()) == _longest(rows, 35)
