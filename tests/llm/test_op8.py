import random

from cartosea.llm.quality import keep_good, score_documents
from tests.llm.brute import base_measures


def _rows():
    rnd = random.Random(3)
    bits = ["über", "a", "the", "x#*", "日本", "\n", "\n", " \n", "\x1c", "\xa0", "b|<>", "word"]
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t", None), (4, "same " * 30, "en"), (4, "same " * 30, "en")]
    return rows + [(i, rnd.choice([" ", " ", "\t"]).join(rnd.choice(bits) for _ in range(rnd.randint(1, 90))), rnd.choice(["en", "de", None])) for i in range(10, 150)]


def test_base_measures(spark):
    rows = _rows()
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"])
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got.collect())
    assert got == sorted((d, *base_measures(t)) for d, t, _ in rows)


def test_fertility_separates(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    got = {(x["quality"], x["kept"]): x["n"] for x in score_documents(docs, ["doc_id"]).join(labels, "doc_id").groupBy("quality", "kept").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got[1, True] > 0.95 * (got[1, True] + got.get((1, False), 0))
    assert got[0, False] > 0.8 * (got[0, False] + got.get((0, True), 0))


def test_filter_keeps_columns(spark):
    df = spark.createDataFrame([(1, "short", "en", "c0")], "doc_id long, text string, lang string, _c0 string")
    assert keep_good(df).columns == df.columns and keep_good(df).count() == 0
    assert keep_good(spark.createDataFrame([], df.schema)).count() == 0


def test_entropy_bands_by_language(spark):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdefghijklmnoprstuvwyz") for _ in range(6)) for _ in range(1800)]
    prose = lambda n, v: " ".join(rnd.choice(v) for _ in range(n))
    rows = [(i, prose(rnd.randint(300, 800), vocab), "en") for i in range(60)] + [(100 + i, prose(500, vocab[::90]), "en") for i in range(3)]
    rows += [(200 + i, prose(rnd.randint(300, 800), vocab[::90]), "xx") for i in range(60)] + [(300 + i, prose(500, vocab), "xx") for i in range(3)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert all(got[100 + i] == (False, False) and got[300 + i] == (False, False) for i in range(3))
    assert all(got[i][1] and got[200 + i][1] for i in range(60))


def _verdicts(rows, group):
    """kept of measured rows, restated with plain lists."""
    import math
    import statistics as st

    from cartosea.llm import quality as Q

    grid = lambda x: math.floor(abs(x) * 1024 + 0.5) / 1024 * (1 if x >= 0 else -1)
    median = lambda xs: st.median(map(grid, xs))
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[group], []).append(r)
    bits = lambda r: math.log2(max(1, r["n_pieces"]))
    for own in by.values():
        mid = {c: median(r[c] for r in own) for c in Q.SPREAD}
        mad = {c: median(abs(r[c] - mid[c]) for r in own) for c in Q.SPREAD}
        words = 2 ** median(math.log2(max(1, r["n_words"])) for r in own)
        some = [r for r in own if r["n_words"] > 0]
        octaves = [math.floor(bits(r)) for r in some]
        dense = sorted({o for o in octaves if octaves.count(o) >= Q.ENOUGH})
        like = lambda r: min(dense, key=lambda o: (abs(o - math.floor(bits(r))), o)) if dense else -1
        classes = {}
        for r in some:
            classes.setdefault(like(r), []).append(r)
        mids = {k: (median(map(bits, rs)), median(r["entropy"] for r in rs)) for k, rs in classes.items()}
        mads = {k: median(abs(r["entropy"] - mids[k][1]) for r in rs) for k, rs in classes.items()}
        for r in own:
            good = not r["base_failed"] and r["relative_entropy"] >= Q.LEAST_ENTROPY
            widen = math.sqrt(max(1.0, words / max(1, r["n_words"])))
            for c, times in Q.SPREAD.items():
                least = Q.LEAST_SHARE if c == "byte_share" else Q.LEAST * mid[c]
                good = good and abs(r[c] - mid[c]) <= times * widen * max(mad[c], least)
            if good:
                k = like(r)
                longer, off = bits(r) - mids[k][0], r["entropy"] - mids[k][1]
                half = Q.ENTROPY_SPREAD * max(mads[k], Q.LEAST_BITS)
                good = min(longer, 0.0) - half <= off <= max(longer, 0.0) + half
            out[r["doc_id"]] = good
    return out


def test_verdicts_against_plain_lists_in_any_order(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").selectExpr("*", "0 as entropy", "'x' as kept")
    got = score_documents(docs, ["doc_id", "lang", "entropy", "kept"]).collect()
    assert got[0].__fields__.count("entropy") == got[0].__fields__.count("kept") == 1
    want = _verdicts(got, "lang")
    assert {r["doc_id"]: r["kept"] for r in got} == want and 0 < sum(want.values()) < len(want)
    again = score_documents(docs.repartition(7, "text"), ["doc_id", "lang"]).collect()
    assert {r["doc_id"]: r["kept"] for r in again} == want


def test_long_words_are_not_remembered():
    import public_tokenizers

    from cartosea.llm import quality

    v = quality._Vocabularies(public_tokenizers.path(quality.PIECES), public_tokenizers.path(quality.BYTES))
    words = [b"plain", *[b"long" * 5000 + str(i).encode() for i in range(50)]]
    ids, counts = v.measure(words)
    again, more = v.measure(words)
    assert ids == again and counts.tolist() == more.tolist() and set(v.known) == {b"plain"}
