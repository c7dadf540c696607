"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

Roles must spell `(s?(ua)+)?`. Edits are Keep (0), Rerole to user or assistant (3), Delete (4, and the only one for a
blank or repeated turn) and Insert of an empty turn (3); a truncated turn that isn't deleted adds 3. Each turn has one
word of cost layers: four bits, one for each grammar state, of the states from which the rest can be accepted at that
cost, layer above layer. One shift moves all layers up by an edit's cost and one mask moves all of them through the
grammar, so a turn takes a few operations on words, from the last turn to the first. No state is more than 7 above
the best one (two insertions and a deletion make up for any difference), so a word of 16 layers above the turn's own
least holds all that the best repair needs. The first layer that has the start state is the cost; the trace goes
forward through the words and takes the least letter that still arrives at that cost.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.llm.common import column

REROLE = INSERT = TRUNCATED = 3
DELETE = 4
#: Grammar states: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's; 0 and 3 accept.
_STATE = int("1" * 16, 16)
_WORD = (1 << 64) - 1
_BLANK = " \t\n\x0b\x0c\r"
#: A turn's kind: its role's initial, and what is wrong with it.
_INITIAL = {"s": 1, "u": 2, "a": 3}
_CUT_OFF, _MUST_GO, _DUPLICATE = 8, 16, 32


def _user(w: int) -> int:
    return ((w >> 2) & _STATE) * 0b1011


def _assistant(w: int) -> int:
    return ((w >> 3) & _STATE) << 2


def _kept(w: int, initial: int) -> int:
    return (w >> 1) & _STATE if initial == 1 else _user(w) if initial == 2 else _assistant(w) if initial == 3 else 0


def _insertions(w: int) -> int:
    """States that reach those of w by insertions, two at most: a third never pays."""
    once = (_user(w) | _assistant(w)) << 4 * INSERT
    return w | once | (_user(once) | _assistant(once)) << 4 * INSERT


def layers(kinds: bytes) -> tuple[array, array]:
    """(word, least cost) before each turn and at the end."""
    words, least = array("Q", bytes(8 * (len(kinds) + 1))), array("q", bytes(8 * (len(kinds) + 1)))
    w, base = _insertions(0b1001) & _WORD, 0
    words[len(kinds)] = w
    for i in range(len(kinds) - 1, -1, -1):
        k = kinds[i]
        new = w << 4 * DELETE
        if not k & _MUST_GO:
            more = TRUNCATED if k & _CUT_OFF else 0
            new |= _kept(w, k & 7) << 4 * more | (_user(w) | _assistant(w)) << 4 * (REROLE + more)
        new = _insertions(new)
        up = ((new & -new).bit_length() - 1) // 4
        w, base = (new >> 4 * up) & _WORD, base + up
        words[i], least[i] = w, base
    return words, least


def _step(state: int, initial: int) -> int:
    """The state after a turn of that role, -1 where the grammar has none."""
    if initial == 2:
        return -1 if state == 2 else 2
    if initial == 3:
        return 3 if state == 2 else -1
    return 1 if initial == 1 and state == 0 else -1


def repair_kinds(kinds: bytes) -> tuple[int, str]:
    """(cost, least audit) of the turns' kinds."""
    words, least = layers(kinds)
    cost = least[0] + next(c for c in range(16) if words[0] >> 4 * c & 1)

    def open_(i: int, state: int, rest: int) -> bool:
        c = rest - least[i]
        return state >= 0 and 0 <= c < 16 and bool(words[i] >> (4 * c + state) & 1)

    i, state, rest, audit = 0, 0, cost, []
    while i < len(kinds) or rest:
        k = kinds[i] if i < len(kinds) else None
        other = 3 if state == 2 else 2  # the role that comes next, and the state after it
        if k is not None and open_(i + 1, state, rest - DELETE):
            audit.append("D")
            i, rest = i + 1, rest - DELETE
            continue
        if open_(i, other, rest - INSERT):
            audit.append("I")
            state, rest = other, rest - INSERT
            continue
        more = TRUNCATED if k & _CUT_OFF else 0
        to = _step(state, k & 7)
        if open_(i + 1, to, rest - more) and not k & _MUST_GO:
            audit.append("K")
            i, state, rest = i + 1, to, rest - more
        else:
            audit.append("R")
            i, state, rest = i + 1, other, rest - REROLE - more
    return cost, "".join(audit)


class _Conversation:
    """One conversation as its rows go by: first each turn's kind, then, with the audit known, its texts."""

    def __init__(self, conv: int | None):
        self.conv, self.kinds, self.digests, self.turns = conv, bytearray(), bytearray(), []
        self.low = self.high = None
        self.different = self.illegal = 0
        self.audit: str | None = None

    def kind(self, turn: int | None, initial: str, blank: bool, cut_off: bool, digest: bytes) -> None:
        k = _INITIAL.get(initial, 0)
        if self.kinds and (self.kinds[-1] & 7, k) not in ((1, 2), (2, 3), (3, 2)):
            self.illegal += 1
        self.kinds.append(k | (_MUST_GO if blank else 0) | (_CUT_OFF if cut_off and not blank else 0))
        self.digests += digest
        if turn is not None:
            self.different += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def plan(self) -> None:
        """Repeated turns, then the audit."""
        if self.audit is not None:
            return
        n = len(self.kinds)
        kinds = np.frombuffer(bytes(self.kinds), np.uint8).copy()
        if n:
            _, first = np.unique(np.frombuffer(bytes(self.digests), np.dtype((np.void, 16))), return_index=True)
            again = np.ones(n, bool)
            again[first] = False
            again &= (kinds & _MUST_GO) == 0
            kinds[again] = (kinds[again] & 7) | _MUST_GO | _DUPLICATE
        self.duplicate = int(np.count_nonzero(kinds & _DUPLICATE))
        self.blank = int(np.count_nonzero(kinds & _MUST_GO)) - self.duplicate
        self.truncated = int(np.count_nonzero(kinds & _CUT_OFF))
        self.cost, self.audit = repair_kinds(kinds.tobytes())
        self.at, self.state, self.out, self.hash = 0, 0, 0, hashlib.sha256()
        self.digests = bytearray()

    def _emit(self, edit: str, role: str, text: str) -> tuple:
        self.hash.update((("\n" if self.out else "") + role + ":" + text).encode())
        self.out += 1
        return self.conv, self.out - 1, edit, role, text

    def inserted(self) -> Iterator[tuple]:
        """Turns that the audit inserts here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = 3 if self.state == 2 else 2
            yield self._emit("I", "assistant" if self.state == 3 else "user", "")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        """The turns that come of the next row."""
        self.plan()
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = 3 if self.state == 2 else 2
            yield self._emit(edit, "assistant" if self.state == 3 else "user", text)
        elif edit == "K":
            self.state = _step(self.state, _INITIAL[role[0]])
            yield self._emit(edit, role, text)

    def end(self) -> Iterator[tuple]:
        self.plan()
        yield from self.inserted()

    def report(self) -> tuple:
        gaps = self.high - self.low + 1 - self.different if self.high is not None else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest()


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, edit string, role string, text string"
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _walk(schema: str, turns: bool):
    names, kinds = zip(*[(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        rows: list[tuple] = []

        def close():
            made = list(now.end())
            return made if turns else [now.report()]

        for b in batches:
            for conv, full, turn, initial, role, blank, cut_off, digest, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "full", "turn", "initial", "role", "blank", "cut_off", "digest", "text")]):
                if now is None or conv != now.conv:
                    if now is not None:
                        rows += close()
                    now = _Conversation(conv)
                if full is None:  # a conversation whose turns may all be gone
                    continue
                if not full:
                    now.kind(turn, initial, blank, cut_off, digest)
                elif turns:
                    rows += now.turn(role, text)
                else:
                    for _ in now.turn(role, text):
                        pass
            if rows:
                yield batch(rows)
                rows = []
        if now is not None and (rows := close()):
            yield batch(rows)

    return run


def _dealt(turns: DataFrame, all_of: DataFrame | None) -> DataFrame:
    """Each conversation's rows in one task, in order: first the turns' kinds, then the turns."""
    role, text = (F.coalesce(column(turns, c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    own = turns.select(column(turns, "conv_id").cast("long").alias("conv_id"), column(turns, "turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    end = F.rtrim("text", F.lit(_BLANK))
    marked = own.select(
        "conv_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("full"), "turn", F.substring("role", 1, 1).alias("initial"), "role", (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut_off"), F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))).alias("digest"), "text",
    )
    rows = marked.select("conv_id", "full", "turn", "initial", "role", "blank", "cut_off", "digest", F.when(F.col("full"), F.col("text")).alias("text"))
    if all_of is not None:
        ids = all_of.select(column(all_of, "conv_id").cast("long").alias("conv_id")).distinct()
        rows = rows.unionByName(ids, allowMissingColumns=True)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("full").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest")


def report(turns: DataFrame, all_of: DataFrame | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps (turn numbers between the least and greatest that are missing), the turns whose
    first fault is blank, duplicate (role and text seen earlier) or truncated (the last character that isn't white space
    isn't one of `.!?`), illegal (neighbours other than su, ua, au), cost, audit (K, R, D and I in order; of the
    cheapest the least in ASCII) and repaired_sha256 (of `role:text` lines).

    turns has conv_id, turn, role and text; other columns are ignored. Turns go by number, nulls first, equal ones by role,
    then by MD5 of role and text; a null role or text is one space, and a null conv_id is a conversation of its own. Roles
    go by their first letter; one that is empty or no s, u or a can't be kept. Conversations of all_of that have no
    turns get zeros, an empty audit and the digest of an empty string; without it they are absent, and an empty table gives
    none. A conversation goes through one task in order, as its digest needs; the task holds some 40 bytes for each of
    its turns, and texts only a batch at a time.
    """
    return _dealt(turns, all_of).mapInArrow(_walk(REPORT, False), REPORT)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations as turns: conv_id, position from 0, edit (K, R or I), role and text; see report()."""
    return _dealt(turns, None).mapInArrow(_walk(TURNS, True), TURNS)


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults, by CRC-32 of `conv_id:turn` modulo 20: 0 drops the turn, 1 empties its text, 2 removes
    its `.!?`, 3 repeats it, 4 makes the user say it. Nulls are one space, in that key too. Gives conv_id, turn, role, text."""
    space = F.lit(" ")
    conv, turn, role, text = (column(turns, c) for c in ("conv_id", "turn", "role", "text"))
    key = F.concat_ws(":", F.coalesce(conv.cast("string"), space), F.coalesce(turn.cast("string"), space))
    fault = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    own = turns.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return own.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")
