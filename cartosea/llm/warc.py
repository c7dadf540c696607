"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id and dealt to shards of about `SHARD_BYTES` of payload, whose bounds depend on the rows
alone (`shards`), so that equal tables give equal files however their rows arrive. A worker writes a shard's files under
names of its own attempt and begins a new file when the compressed size passes `roll_bytes`; the names that Spark's
commit accepts form the manifest, and only those files get their final names. Headers and digests are made anew from
the payloads; every file begins with a warcinfo record. Of equal payloads (by SHA-256) of `MIN_REVISIT` bytes or more the
one with the largest id is written, others refer to it by record id. Which those are is found on rows without payload;
payloads move once, and each shard merges them with its revisits in order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.llm import files, shards
from cartosea.llm.common import column, discard, stage, workspace

MIN_REVISIT, SHARD_BYTES, ROLL_BYTES = 1000, 64 << 20, 32 << 20
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "shard int, seq int, temp string, file string, records long, bytes long, sha256 string"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _name(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ' '.join(map(str, parts)))}>"


def _packed(head: list[tuple[str, str]], block: bytes) -> bytes:
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _info(file: str) -> bytes:
    """The record that begins a file."""
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name("warcinfo", file)), ("WARC-Date", DATE), ("WARC-Filename", file), ("Content-Type", "application/warc-fields")]
    return _packed(head, b"software: cartosea\r\nformat: WARC File Format 1.1\r\n")


def _record(page: int | None, url: str | None, payload: bytes, sha1: str, again: int, refers: tuple | None) -> bytes:
    """A page's record; again counts earlier rows that equal it, refers has id and URL of the page that it revisits."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers is None else http
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _name(page, url, sha1, *[again] * (again > 0))), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if refers is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(*refers, sha1)), ("WARC-Refers-To-Date", DATE)]
        head += [("WARC-Refers-To-Target-URI", _uri(refers[1]))] if refers[1] is not None else []
        head.append(("X-Refers-To-Page", str(refers[0])))
    return _packed([*head, ("X-Page", "" if page is None else str(page)), ("Content-Type", "application/http; msgtype=response")], block)


def _writer(base: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, out, now = uuid.uuid4().hex[:12], None, None
        fields = [f.split()[0] for f in _MANIFEST.split(", ")]
        before, again, mark, refers = None, 0, None, None

        def close():
            out["stream"].close()
            row = [now[0], now[1], out["temp"], out["file"], out["n"], out["bytes"], out["sha"].hexdigest()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=fields)

        def put(data: bytes) -> None:
            out["stream"].write(data)
            out["sha"].update(data)
            out["bytes"] += len(data)

        for b in batches:
            for shard, kind, id, url, key, payload, sha1, winner, target in zip(*[b.column(c).to_pylist() for c in ("shard", "kind", "id", "url", "key", "payload", "sha1", "winner", "target")]):
                if kind == 0:  # what follows with the same id, URL and payload is a revisit
                    mark, refers = (id, url, key), (winner, target)
                    continue
                if out and (shard != now[0] or out["bytes"] >= roll):
                    yield close()
                    now, out = ((shard, now[1] + 1) if shard == now[0] else (shard, 0)), None
                if out is None:
                    now = now if now and now[0] == shard else (shard, 0)
                    temp, name = f"{base}/_temporary/{attempt}-{now[0]:06d}-{now[1]:04d}", f"shard-{now[0]:06d}-{now[1]:04d}.warc.gz"
                    f, p = files.at(temp)
                    out = {"temp": temp, "file": f"{base}/{name}", "stream": f.open_output_stream(p, compression=None), "n": 0, "bytes": 0, "sha": hashlib.sha256()}
                    put(_info(name))
                again = again + 1 if before == (id, url, key) else 0
                before = (id, url, key)
                put(_record(id, url, payload, sha1, again, refers if mark == before else None))
                out["n"] += 1
        if out:
            yield close()

    return run


def _commit(batches):
    for b in batches:
        for temp, final in zip(b.column("temp").to_pylist(), b.column("file").to_pylist()):
            files.move(temp, final)
        yield b


def write(pages: DataFrame, base: str, id: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages under the folder base (a URI that all machines share) and return the manifest.

    A null payload is empty; a null id sorts first; rows of one id are ordered by a hash of URL and payload; rows of the
    same id and payload are all responses if that id is the largest. Other columns are ignored, under any name. An empty
    table gives an empty manifest. A payload is one value of a row, so its size is bounded by memory.
    """
    payload = F.coalesce(column(pages, html), F.lit("")).cast("binary")
    rows = pages.select(column(pages, id).cast("long").alias("id"), column(pages, url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"key": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload"), "size": F.length("payload").cast("long")})
    tie = F.xxhash64("url", "key")
    found = shards.cuts(rows, F.col("id"), tie, F.col("size") + 500, SHARD_BYTES)
    number = shards.shard_of(found)
    big = rows.where(F.col("size") >= MIN_REVISIT).select("id", "url", "key")
    equal = big.groupBy("key").agg(F.max(F.struct("id", "url")).alias("w"), F.count("*").alias("n")).where("n > 1")
    revisits = big.join(equal.hint("merge"), "key").where(~F.col("id").eqNullSafe(F.col("w.id")) & F.col("w.id").isNotNull())
    revisits = revisits.groupBy("id", "url", "key").agg(F.first("w").alias("w"))
    shared = ["id", "url", "key", tie.alias("tie"), number(F.col("id"), tie).alias("shard")]
    marks = revisits.select(*shared, F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("string").alias("sha1"), F.col("w.id").alias("winner"), F.col("w.url").alias("target"))
    full = rows.select(*shared, F.lit(1).alias("kind"), "payload", "sha1", F.lit(None).cast("long").alias("winner"), F.lit(None).cast("string").alias("target"))
    ready = shards.dealt(full.unionByName(marks), len(found[0]) + 1, [F.col("id").asc_nulls_first(), "tie", "url", "key", "kind"])
    files.make(f"{base}/_temporary")
    accepted = stage(ready.mapInArrow(_writer(base, roll_bytes), _MANIFEST), "warc-accepted")
    accepted.mapInArrow(_commit, _MANIFEST).write.mode("overwrite").parquet(f"{base}/manifest")
    discard(accepted)
    f, p = files.at(f"{base}/_temporary")
    f.delete_dir(p)
    return pages.sparkSession.read.parquet(f"{base}/manifest")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a stream."""
    rest = b""
    while True:
        packer, parts = zlib.decompressobj(31), []
        while not packer.eof:
            rest = rest or stream.read(chunk)
            if not rest:
                if parts:
                    raise EOFError("cut off within a record")
                return
            parts.append(packer.decompress(rest))
            rest = packer.unused_data
        yield b"".join(parts)


_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(batches):
    for b in batches:
        for uri in b.column("file").to_pylist():
            f, p = files.at(uri)
            rows: list[tuple] = []
            with f.open_input_stream(p, compression=None) as stream:
                for record in _members(stream):
                    head, _, rest = record.partition(b"\r\n\r\n")
                    field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    block = rest[: int(field["Content-Length"])]
                    kind = field["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    if hashlib.sha1(block).digest() != base64.b32decode(field["WARC-Block-Digest"][5:]):
                        raise ValueError(f"a block of {uri} is damaged")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = base64.b32decode(field["WARC-Payload-Digest"][5:]).hex()
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    rows.append((int(field["X-Page"]) if field["X-Page"] else None, size, digest, kind, int(field["X-Refers-To-Page"]) if kind == "revisit" else None))
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)


def _rows(rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _ROW.split(", ")])


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record; block digests are checked."""
    n = manifest.count()
    return manifest.select("file").repartition(max(1, n)).mapInArrow(_reader, _ROW)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to a new folder in the shared one, and read the archives back."""
    return read(write(pages, workspace(pages.sparkSession, "warc")))
