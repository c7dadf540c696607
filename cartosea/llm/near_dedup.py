"""MinHash near-duplicate detection by a multi-index Hamming join.

A text's signature is `SYMBOLS` b-bit minhashes of its word shingles. Texts of the asked similarity differ in at most
`limit` of the first `JOINED` symbols (but for `MISS` of the pairs that are just as similar as asked; more similar
ones miss less). The signature is split into chunks so that, by pigeonhole, two signatures within the limit agree in
some chunk but for `ERRORS` symbols; enumerating those errors (a key for each chunk and each set of masked symbols)
finds every pair within the limit. Candidates then pass the distance over all symbols and the sizes' ratio, and the
full shingle sets decide.

Exact copies are one entry. Each bucket of equal keys goes to its most popular entry, the one that shares most keys
with others: a group of near copies then has one or few such centres, whatever number of buckets it fills. Every entry
is compared with its centres and the closest one is verified, which merges most of the group. Entries that are still in
another component than most of their centre's group are a query set against that group: group and queries are cut by
set size (a partner's is within the similarity), then into blocks of bounded size that compare signatures only. What
has a near signature there, and nothing else, meets again with its text; full sets decide, and links come out. So no
component is lost, pairs are never listed, and unlike texts that share a bucket never move their texts. The plan is
the same at every size: texts of entries that share a key are shuffled once.
Components come from alternating large-star and small-star steps over tables in the shared folder.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.llm.common import column, discard, sliced, stage, text_key, utf8
from cartosea.llm.wordhash import Words, mix

SYMBOLS, JOINED, BITS, ERRORS, MISS = 128, 48, 16, 1, 1e-5
#: Entries and queries of a block of signatures; words of both kinds of a block of texts.
BLOCK, ASKING, WORDS, ASKING_WORDS = 8192, 2048, 1_000_000, 500_000
_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def limit(n: int, similarity: float, miss: float = MISS) -> int:
    """Fewest differing symbols of n that texts of this similarity exceed with probability under miss."""
    p, tail, d = 1 - similarity, 1.0, 0
    for d in range(n + 1):
        tail -= math.comb(n, d) * p**d * (1 - p) ** (n - d)
        if tail < miss:
            break
    return d


def chunks(similarity: float) -> list[list[int]]:
    """The symbols of each chunk: as many chunks as pigeonhole needs for ERRORS errors in the best one."""
    m = limit(JOINED, similarity) // (ERRORS + 1) + 1
    return [x.tolist() for x in np.array_split(np.arange(JOINED), m)]


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, in order; a text with fewer words has its whole sequence."""
    at = np.flatnonzero(w.inside(size))
    doc, code = w.doc[at], w.windows(size)[at]
    short = np.flatnonzero((w.n > 0) & (w.n < size))
    if len(short):
        more = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = w.n[short] > j
            more[has] = mix(more[has] * np.uint64(0x9E3779B97F4A7C15) + w.hash[w.first[short][has] + j] + np.uint64(1))
        doc, code = np.concatenate([doc, short]), np.concatenate([code, more])
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[new], code[new]


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n = b.num_rows
            doc, code = shingle_sets(Words(utf8(b.column("text")), lower=True), size)
            count = np.bincount(doc, minlength=n).astype(np.int64)
            some = np.flatnonzero(count)
            sig = np.zeros((n, SYMBOLS), np.uint16)
            if len(some):
                heads = np.searchsorted(doc, some)
                for i, seed in enumerate(_SEEDS):
                    sig[some, i] = (mix(np.minimum.reduceat(code * seed, heads)) >> np.uint64(64 - BITS)).astype(np.uint16)
            raw = sig.tobytes()
            step = 2 * SYMBOLS
            yield pa.record_batch([b.column("id"), pa.array(count), pa.array([raw[i * step : (i + 1) * step] if count[i] else None for i in range(n)], pa.binary())], names=["id", "n", "sig"])

    return run


def _keys(similarity: float):
    parts = chunks(similarity)

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
            out = []
            for c, symbols in enumerate(parts):
                for masked in itertools.combinations(symbols, ERRORS):
                    h = np.full(len(sig), c * SYMBOLS**ERRORS + sum(x * SYMBOLS**i for i, x in enumerate(masked)) + 1, np.uint64)
                    for s in symbols:
                        if s not in masked:
                            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, s] + np.uint64(1))
                    out.append(h.view(np.int64))
            flat = np.stack(out, 1) if len(sig) else np.zeros((0, len(out)), np.int64)
            offsets = np.arange(len(sig) + 1, dtype=np.int32) * flat.shape[1]
            yield pa.record_batch([b.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))], names=["id", "keys"])

    return run


def _near(similarity: float):
    """Of pairs with both signatures, those within the limits; dist is the distance over all symbols."""
    joined, whole = limit(JOINED, similarity), limit(SYMBOLS, similarity)

    def run(batches):
        for b in batches:
            a, z = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
            off = a != z
            dist = off.sum(1)
            good = np.flatnonzero((off[:, :JOINED].sum(1) <= joined) & (dist <= whole))
            take = pa.array(good)
            yield pa.record_batch([b.column("a").take(take), b.column("b").take(take), pa.array(dist[good].astype(np.int32))], names=["a", "b", "dist"])

    return run


def _verify(size: int, percent: int):
    def run(batches):
        for b in sliced(batches, "ta"):
            sets = []
            for c in ("ta", "tb"):
                doc, code = shingle_sets(Words(utf8(b.column(c)), lower=True), size)
                sets.append(np.split(code, np.searchsorted(doc, np.arange(1, b.num_rows))))
            good = []
            for i, (x, y) in enumerate(zip(*sets)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both) and both:
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.record_batch([b.column("a").take(take), b.column("b").take(take)], names=["a", "b"])

    return run


def _near_blocks(percent: int):
    """A block's entries that have a near signature of another component: the asking ones, and those that they meet."""
    joined, whole = limit(JOINED, percent / 100), limit(SYMBOLS, percent / 100)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        asks = np.asarray(group.column("asks").to_pylist(), bool)
        n = group.column("n").to_numpy()
        _, comp = np.unique(np.asarray(group.column("comp").to_pylist(), "S12"), return_inverse=True)
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        others, hot = np.flatnonzero(~asks), np.zeros(len(n), bool)
        low, size = sig[others, :JOINED], n[others]
        for r in np.flatnonzero(asks):
            a, z = np.searchsorted(size, -(-percent * n[r] // 100)), np.searchsorted(size, 100 * n[r] // percent, "right")
            near = np.flatnonzero((low[a:z] != sig[r, :JOINED]).sum(1) <= joined)
            near = others[a + near]
            near = near[comp[near] != comp[r]]
            near = near[(sig[near] != sig[r]).sum(1) <= whole]
            hot[near] = True
            hot[r] |= len(near) > 0
        return group.select(["centre", "band", "rb", "xb", "asks", "id", "comp", "n"]).filter(pa.array(hot))

    return run


def _blocks(size: int, percent: int):
    """Links between asking entries of a block and the others in it that are of another component."""
    joined, whole = limit(JOINED, percent / 100), limit(SYMBOLS, percent / 100)

    def run(group: pa.Table) -> pa.Table:
        asks = np.asarray(group.column("asks").to_pylist(), bool)
        ids, comps = group.column("id").to_pylist(), group.column("comp").to_pylist()
        number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([number[c] for c in comps])
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        doc, code = shingle_sets(Words([t.encode() for t in group.column("text").to_pylist()], lower=True), size)
        _, code = np.unique(code, return_inverse=True)
        edge = np.searchsorted(doc, np.arange(len(ids) + 1))
        n = np.diff(edge)
        mark = np.zeros(int(code.max(initial=0)) + 1, np.int64)
        others, out = np.flatnonzero(~asks), []
        for r in np.flatnonzero(asks):
            near = others[(comp[others] != comp[r]) & (100 * np.minimum(n[others], n[r]) >= percent * np.maximum(n[others], n[r]))]
            off = sig[near] != sig[r]
            near = near[(off.sum(1) <= whole) & (off[:, :JOINED].sum(1) <= joined)]
            if not len(near):
                continue
            mark[code[edge[r] : edge[r + 1]]] = 1
            both = np.array([mark[code[edge[x] : edge[x + 1]]].sum() for x in near])
            mark[code[edge[r] : edge[r + 1]]] = 0
            good = near[(100 * both >= percent * (n[near] + n[r] - both)) & (both > 0)]
            _, one = np.unique(comp[good], return_index=True)  # a link to each other component is enough
            out += [(ids[r], ids[x]) for x in good[one]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every end of links (a, b): comp is the smallest id that it reaches."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, edges = edges, stage(small.where("u != v").distinct(), "cc-edges")
        discard(last, large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    heads = edges.select(F.col("v").alias("u"), F.col("v").alias("m")).distinct()
    comps = stage(edges.select("u", F.col("v").alias("m")).unionByName(heads).groupBy("u").agg(F.min("m").alias("m")).select(F.col("u").alias("id"), F.col("m").alias("comp")), "cc-comps")
    discard(edges)
    return comps


def _of(count: str, salt: int = 0):
    """The part, of as many as a column says, that an entry belongs to."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(count)).cast("int")


def _over(count: str):
    """Every part."""
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def _parts(amount, most: int):
    """Parts that hold most each."""
    return F.greatest(F.ceil(amount / most), F.lit(1)).cast("int")


def _signature_blocks(here: DataFrame, percent: int) -> DataFrame:
    """Blocks (centre, band, rb, xb) of entries and of those that ask; here has centre, id, comp, n and main.

    A pair's sizes are within the similarity, so its size bands are equal or neighbours: entries stand in their own
    band, queries in theirs and both beside it.
    """
    width = math.log(100 / percent) * 1.0001
    here = here.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    asking = here.where("comp != main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    count = lambda df, name, most: df.groupBy("centre", "band").agg(F.count("*").alias("c")).select("centre", "band", _parts(F.col("c"), most).alias(name))
    grid = stage(count(here, "nx", BLOCK).join(count(asking, "nr", ASKING), ["centre", "band"]), "near-grid")
    asks = asking.join(grid, ["centre", "band"]).select("centre", "band", _of("nr").alias("rb"), _over("nx").alias("xb"), F.lit(True).alias("asks"), "id", "comp")
    rest = here.join(grid, ["centre", "band"]).select("centre", "band", _over("nr").alias("rb"), _of("nx").alias("xb"), F.lit(False).alias("asks"), "id", "comp")
    return asks.unionByName(rest)


def link_documents(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """keep's columns for each row, with `_id` (the text's key), `_n` (size of its shingle set) and `_comp` (the key of
    its component; the text's own key where nothing is linked, null for texts without words, which nothing links).

    Equal rows are copies and linked if they have words. An empty table gives no rows.
    """
    body = column(docs, text)
    similarity = percent / 100
    slim = docs.select(text_key(body).alias("id"), body.alias("text"))
    sigs = stage(slim.mapInArrow(_signatures(shingle), "id binary, n long, sig binary").dropDuplicates(["id"]), "near-signatures")
    keys = sigs.where("sig is not null").select("id", "sig").mapInArrow(_keys(similarity), "id binary, keys array<long>").select("id", F.explode("keys").alias("key"))
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "near-shared")
    buckets = stage(keys.join(shared, "key"), "near-buckets")
    popular = buckets.groupBy("id").agg(F.sum("m").alias("pop"))
    centre = buckets.join(popular, "id").groupBy("key").agg(F.max(F.struct("pop", "id")).alias("x")).select("key", F.col("x.id").alias("centre"))
    routed = stage(buckets.join(stage(centre, "near-centres"), "key").select("centre", "id").distinct(), "near-routed")

    def close(pairs: DataFrame) -> DataFrame:
        x = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
        y = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
        both = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return both.select("a", "b", "sa", "sb").mapInArrow(_near(similarity), "a binary, b binary, dist int")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return stage(both.select("a", "b", "ta", "tb").mapInArrow(_verify(shingle, percent), "a binary, b binary"), "near-links")

    # the only texts that are looked at again: those that share a key with another. The hint keeps one plan at all sizes
    members = stage(routed.select("id").distinct(), "near-members")
    texts = stage(slim.dropDuplicates(["id"]).join(members.hint("merge"), "id", "left_semi"), "near-texts")
    first = routed.where("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    best = close(first).groupBy("a").agg(F.min(F.struct("dist", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    links = verified(stage(best, "near-best"))
    comps = components(links)
    # in each centre's group, entries outside its largest component against all of the group
    sizes = sigs.select("id", "n")
    placed = stage(routed.join(comps, "id", "left").join(sizes, "id").select("centre", "id", F.coalesce("comp", "id").alias("comp"), "n"), "near-placed")
    parts = placed.groupBy("centre", "comp").agg(F.count("*").alias("c"))
    main = parts.groupBy("centre").agg(F.max(F.struct("c", "comp")).alias("x"), F.count("*").alias("k"))
    main = stage(main.where("k > 1").select("centre", F.col("x.comp").alias("main")), "near-main")
    block = ["centre", "band", "rb", "xb"]
    both = stage(_signature_blocks(placed.join(main, "centre"), percent), "near-blocks")
    near = both.join(sigs.select("id", "n", "sig"), "id").groupBy(*block).applyInArrow(_near_blocks(percent), "centre binary, band int, rb int, xb int, asks boolean, id binary, comp binary, n long")
    near = stage(near, "near-hot")
    words = near.groupBy(*block).agg(F.sum(F.when(F.col("asks"), F.col("n"))).alias("a"), F.sum(F.when(~F.col("asks"), F.col("n"))).alias("x"))
    near = near.join(words.select(*block, _parts(F.col("a"), ASKING_WORDS).alias("nr"), _parts(F.col("x"), WORDS).alias("nx")), block)
    asks = near.where("asks").select(*block, _of("nr", 1).alias("r2"), _over("nx").alias("x2"), "asks", "id", "comp")
    rest = near.where("not asks").select(*block, _over("nr").alias("r2"), _of("nx", 1).alias("x2"), "asks", "id", "comp")
    found = asks.unionByName(rest).join(texts, "id").join(sigs.select("id", "sig"), "id").groupBy(*block, "r2", "x2").applyInArrow(_blocks(shingle, percent), "a binary, b binary")
    comps = components(links.unionByName(stage(found.distinct(), "near-more")))
    discard(texts, shared, buckets, routed, members, placed, both)
    names = [f"_c{i}" for i in range(len(keep))]
    rows = docs.select(*[column(docs, c).alias(f) for c, f in zip(keep, names)], text_key(body).alias("id"))
    known = stage(sigs.select("id", "n").join(comps, "id", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("comp", "id")).alias("comp")), "near-known")
    return rows.join(known, "id").select(*[F.col(f).alias(c) for c, f in zip(keep, names)], F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("comp").alias("_comp"))


def mark_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable) and kept (id = component_id) for each row.

    A text without words is its own component. Rows with equal id and text are both kept or both not.
    """
    linked = stage(link_documents(docs, [id], text, shingle, percent), "near-linked")
    low = linked.where("_comp is not null").groupBy("_comp").agg(F.min(id).alias("_low"))
    out = linked.join(low, "_comp", "left")
    comp = F.when(F.col("_comp").isNull(), F.col(id)).otherwise(F.col("_low"))
    return out.select(id, F.col("_n").alias("n_shingles"), comp.alias("component_id"), F.col(id).eqNullSafe(comp).alias("kept"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component one row of the smallest id stays, and every row without words."""
    own = docs.columns
    names = [f"_c{i}" for i in range(len(own))]
    wide = docs.select(*[column(docs, c).alias(f) for c, f in zip(own, names)])
    at = dict(zip(own, names))
    linked = stage(link_documents(wide, [at[id]], at[text], shingle, percent), "near-linked").where("_comp is not null")
    best = linked.groupBy("_comp").agg(F.min(F.struct(F.col(at[id]).isNull().alias("none"), F.col(at[id]).alias("i"), F.col("_id").alias("t"))).alias("x"))
    stay = stage(best.select(F.col("x.t").alias("_t"), F.col("x.i").alias("_i")), "near-stay")
    keyed = wide.withColumn("_t0", text_key(F.col(at[text])))
    words = keyed.where(F.coalesce(F.col(at[text]), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    none = keyed.where(~F.coalesce(F.col(at[text]), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")).select(*names)
    found = words.join(stay, (F.col("_t0") == F.col("_t")) & F.col(at[id]).eqNullSafe(F.col("_i")), "left_semi")
    one = found.dropDuplicates(["_t0"]).select(*names)
    return one.unionByName(none).select(*[F.col(f).alias(c) for c, f in zip(own, names)])
