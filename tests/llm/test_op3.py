import random

from cartosea.llm.decontaminate import Index, edit_within, find_leaks, keep_clean, words_of
from cartosea.llm.wordhash import Words


def _corpus():
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(300)] + ["über", "été"]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, text(rnd.randint(15, 60))) for i in range(30)] + [(30, text(6)), (31, text(3))]
    docs, want = [], set()
    for d in range(300):
        body = text(rnd.randint(0, 120))
        if d % 2:
            i, w = rnd.choice(items)
            w, most = list(w), len(w) // 5
            for _ in range(rnd.choice([0, 0, 1, most // 2, most])):
                q = rnd.randrange(len(w))
                w[q] = "zz" if rnd.random() < 0.5 else w[q]
            body = body[: d % 50] + [x.upper() + "," for x in w] + body[d % 50 :]
        docs.append((d, " ".join(body)))
    for d, t in docs:
        w = Words([" ".join(words_of(t)).encode()])
        for i, x in items:
            code = Words([" ".join(x).encode()]).hash
            if edit_within(w.hash, code, len(x) // 5)[0] <= len(x) // 5:
                want.add((d, i))
    return docs, [(i, " ".join(x)) for i, x in items], want


def _distance(text, item):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        prev, row[0] = row[0], 0
        for j in range(1, len(item) + 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != item[j - 1]))
        best = min(best, row[-1])
    return best


def test_alignment():
    import numpy as np

    rnd = random.Random(8)
    for _ in range(300):
        a, b = [rnd.randrange(4) for _ in range(rnd.randint(0, 12))], [rnd.randrange(4) for _ in range(rnd.randint(1, 8))]
        got, s, e = edit_within(np.array(a, np.uint64), np.array(b, np.uint64), len(b))
        assert got == _distance(a, b)
        row = _distance(a[s:e], b)
        assert row == got


def test_recall_against_all_alignments(spark):
    docs, items, want = _corpus()
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want
    assert len(got) >= 0.95 * len(want)


def test_odd_rows_and_filter(spark):
    item = "the quick brown fox jumps over the lazy dog again and again today"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, item, 0), (3, item, 0), (4, "so " * 50_000 + item, 0), (5, "clean text", 0)], "doc_id long, text string, k int")
    got = sorted((r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect())
    assert got == [(3, 1), (3, 1), (3, 4), (3, 4), (4, 1), (4, 4)]
    kept = keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
    assert find_leaks(docs.limit(0), items).count() == 0 and keep_clean(docs, items.limit(0)).count() == 6


def _leaks(index, text, percent=80):
    w = Words([text.encode()])
    hits = set()
    for _, at, i in zip(*(x.tolist() for x in index.candidates(w))):
        most = (100 - percent) * len(index.codes[i]) // 100
        x, y = max(0, at - 2 * most - 16), at + len(index.codes[i]) + 2 * most + 16
        if edit_within(w.hash[x:y], index.codes[i], most)[0] <= most:
            hits.add(index.ids[i])
    return hits


def test_unedited_items_at_all_offsets(spark):
    sizes = [*range(1, 41), 60, 100]
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in sizes]
    docs = [(100 * n + o, " ".join(["x"] * o + [t] + ["y"] * (o % 5))) for n, t in items for o in range(17)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()) == sorted((d, d // 100, 0) for d, _ in docs)


def test_edited_short_items_are_all_found():
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(200)]
    for n in range(1, 30):
        item = [rnd.choice(vocab) for _ in range(n)]
        index = Index([n], [" ".join(item)])
        for _ in range(20):
            w = list(item)
            for _ in range(n // 5):
                q = rnd.randrange(len(w))
                w[q : q + 1] = rnd.choice([[], ["new"], [w[q], "new"]]) if len(w) > 1 else w
            around = [rnd.choice(vocab) for _ in range(20)]
            cut = rnd.randrange(20)
            assert _leaks(index, " ".join(around[:cut] + w + around[cut:])) == {n}
