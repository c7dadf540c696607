import hashlib
import heapq
import random
import re
import zlib

import pytest

from cartosea.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if f == 1 else re.sub(r"[.!?]", "", x) if f == 2 else x
        r = "user" if f == 4 else r
        out += [(c, t, r, x)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def brute_report(conv, rows):
    """Cheapest, then least audit by uniform-cost search over (turn, roles so far)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()))
    faults, seen = [], set()
    for _, _, r, x in rows:
        rest = BLANK.sub("", x)
        faults.append("blank" if not rest else "duplicate" if (r, x) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    first = [r[:1] for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(first, first[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for r in ("user", "assistant"):
            if (state, r[0]) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, r[0], (*said, (r, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, said))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*said, (role, text))))
                for r in ("user", "assistant"):
                    if (state, r[0]) in step:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, r[0], (*said, (r, text))))
    whole = "\n".join(f"{r}:{x}" for r, x in said)
    return (conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()), said


def _rows(n=300, seed=8):
    rnd = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", None, ""]
    texts = ["Yes.", "No!", "why", "ok? ", "", None, " \t\n", "a.b", "é", "x ", "end.\n\n"]
    rows = []
    for c in range(n):
        for t in range(rnd.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((None if c == 3 else c, rnd.choice([None, t, t, t, 2 * t]), rnd.choice(roles), rnd.choice(texts)))
    return rows + rows[5:9]


def test_audits_are_least():
    rnd = random.Random(9)
    letters = {0: "t", 1: "s", 2: "u", 3: "a"}
    for _ in range(1500):
        kinds = [rnd.choice([0, 1, 2, 2, 3, 3]) | rnd.choice([0, 0, 8, 16]) for _ in range(rnd.randint(0, 10))]
        rows = [(0, i, letters[k & 7], "" if k & 16 else f"{i}" if k & 8 else f"{i}.") for i, k in enumerate(kinds)]
        want, _ = brute_report(0, rows)
        assert repair.repair_kinds(bytes(k & 7 | (16 if k & 16 else k & 8) for k in kinds)) == want[6:8]


@pytest.mark.parametrize("damaged", [False, True])
def test_equals_brute_force(spark, damaged):
    rows = _rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", digest string, full int").repartition(3)
    left = brute_damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want, said = {}, {}
    for c in {r[0] for r in rows}:
        want[c], said[c] = brute_report(c, [r for r in left if r[0] == c])
    turns = repair.damage(df) if damaged else df
    if damaged:
        assert sorted(map(repr, map(tuple, turns.collect()))) == sorted(map(repr, left))
    assert {r["conv_id"]: tuple(r) for r in repair.report(turns, df).collect()} == want
    got = {}
    for r in sorted(repair.repaired(turns).collect(), key=lambda r: r["position"]):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {c: list(s) for c, s in said.items() if s}


def test_all_dropped_and_empty(spark):
    some = spark.createDataFrame([(5, 1, "user", "x")], SCHEMA)
    none = some.limit(0)
    assert repair.report(none).count() == 0 and repair.repaired(none).count() == 0 and repair.damage(none).count() == 0
    (r,) = repair.report(none, some).collect()
    assert tuple(r) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_and_texts(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"{i}.") for i in range(30_000)] + [(2, 0, "user", " " * 1_000_000 + "x"), (2, 1, "assistant", "y" * 1_000_000 + ".")]
    got = {r["conv_id"]: r for r in repair.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[2]["cost"], got[2]["audit"]) == (3, "KK")
    assert got[1]["cost"] == repair.repair_kinds(bytes([2 if i % 3 else 3 for i in range(30_000)]))[0] and 25_000 < len(got[1]["audit"])
