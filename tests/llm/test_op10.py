import hashlib
import random

from cartosea.llm import warc


def _want(rows):
    best = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        r = best.get(p, i)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if r == i else "revisit", None if r == i else r))
    return sorted(out)


def _rows():
    rnd = random.Random(5)
    same = ["é" * 600, "a" * 999, "a" * 1000, "\r\n\r\nWARC/1.1\r\n" * 100]
    return [(i * 7, rnd.choice([None, "http://x/y z", "u\r\nX: 1"]), rnd.choice([None, "", *same, "z" * rnd.randint(0, 5000)])) for i in range(300)]


def test_round_trip(spark, tmp_path):
    rows = _rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, id int").repartition(5)
    m = warc.write(df.drop("id"), f"file://{tmp_path}/a", roll_bytes=4000)
    assert m.count() > 2
    assert sorted(map(tuple, warc.read(m).collect()), key=str) == sorted(_want(rows), key=str)
    again = warc.write(df.drop("id").orderBy("html"), f"file://{tmp_path}/b", roll_bytes=4000)
    assert sorted(r["sha256"] for r in m.collect()) == sorted(r["sha256"] for r in again.collect())
    assert not (tmp_path / "a" / "_temporary").exists()


def test_empty_and_nulls(spark):
    schema = "page_id long, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    got = warc.round_trip(spark.createDataFrame([(None, None, None), (5, "u", "x" * 1000), (5, "u", "x" * 1000)], schema)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in got) == [(0, "response"), (5, "response"), (5, "response")]


def test_shards_are_even_whatever_the_ids(spark, tmp_path, monkeypatch):
    """One outlying id, ten thousand rows in one narrow range of ids, and a third of all rows under one id."""
    from cartosea.llm import shards

    rnd = random.Random(2)
    rows = [(i, f"u{i}", rnd.randbytes(40).hex()) for i in range(10_000)] + [(10**15, "far", "x" * 50)] + [(77, f"v{i}", rnd.randbytes(40).hex()) for i in range(5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    monkeypatch.setattr(warc, "SHARD_BYTES", 200_000)
    m = warc.write(df, f"file://{tmp_path}/a").groupBy("shard").agg({"records": "sum"}).collect()
    sizes = [r[1] for r in m]
    assert sum(sizes) == len(rows) and len(sizes) > 30 and max(sizes) < 3 * len(rows) / len(sizes)
    assert shards.cuts(df.limit(0), df["page_id"], df["page_id"], df["page_id"], 10)[0].size == 0


def test_records_name_what_they_refer_to(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "p" * 2000), (2, "v", "p" * 2000), (3, None, "p" * 2_000_000)], "page_id long, url string, html string")
    m = warc.write(df, f"file://{tmp_path}/a").collect()
    assert len(m) == 1 and m[0]["records"] == 3
    with open(m[0]["file"][7:], "rb") as f:
        heads = [dict(x.split(": ", 1) for x in r.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for r in warc._members(f)]
    assert [h["WARC-Type"] for h in heads] == ["warcinfo", "revisit", "response", "response"]
    assert heads[1]["WARC-Refers-To"] == heads[2]["WARC-Record-ID"] and heads[1]["WARC-Refers-To-Target-URI"] == "v"
    assert len({h["WARC-Record-ID"] for h in heads}) == 4
