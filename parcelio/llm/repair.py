"""Conversation structure repair by Wagner-Fischer alignment with the alternating grammar.

A conversation's turns are aligned to `(s?(ua)+)?`, the grammar of role
initials, in the cheapest way. Seen from their ends, all grammar strings without
the system turn are beginnings of one string `auau...`, so one Wagner-Fischer
table over the turns from last to first holds the cost of every feasible length
in its last column. Ukkonen's band keeps the cells that can beat the cost of a
greedy repair. The audits of the cheapest lengths are traced back and compared.

Long conversations are cut at calm turns, which every cheapest audit keeps. Turns
go to one task for each conversation, sorted; the task holds one byte for each
turn, not their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelio.llm.shared import ship, written

#: Costs of the edits; a turn that is cut off costs TRUNCATED more unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Conversations of more turns are cut before they are aligned.
WHOLE_TURNS = 2048
#: Alternating turns without fault of which the middle is kept by every cheapest audit.
CALM_TURNS = 8
#: What a turn is to the alignment: initial s, u, a or another; capital where the text is cut off; deleted in any case.
SYSTEM, USER, ASSISTANT, OTHER, GONE = b"suaxd"
_CUT_OFF = {SYSTEM: b"S"[0], USER: b"U"[0], ASSISTANT: b"A"[0], OTHER: b"X"[0]}
_FAR = 1 << 40
WHITE = " \t\n\x0b\x0c\r"


def _greedy(codes: bytes, wanted: bytes, end: int) -> int:
    """The cost of keeping or changing every turn that can stay, in order, and ending with `end`."""
    cost, at = 0, 0
    for c in codes:
        if c == GONE:
            cost += DELETE
            continue
        small = c | 32
        cost += TRUNCATED * (c != small) + REROLE * (small != wanted[at])
        at ^= 1
    return cost + INSERT * (wanted[at ^ 1] != end)


class _Table:
    """Costs of aligning the last i turns with the last j of the target, for all i and j of the band."""

    def __init__(self, codes: bytes, last: int, budget: int):
        """`last` is the target's last initial; no alignment dearer than `budget` is of use."""
        n = len(codes)
        back = np.frombuffer(codes, np.uint8)[::-1]
        gone = back == GONE
        cut = (back & 32 == 0) & ~gone
        # Beyond what cannot be avoided: 4 for each turn that must go, 3 for each other that is cut off.
        spare = max(0, budget - DELETE * int(gone.sum()) - TRUNCATED * int(cut.sum()))
        cheap = min(int(cut.sum()), spare)  # a turn that is cut off is deleted for 1 more
        self.low = -(cheap + (spare - cheap) // DELETE)
        self.high = spare // INSERT
        self.stay = np.concatenate([[0], np.cumsum(~gone)]).astype(np.int64)
        width = self.high - self.low + 1
        # What the j-th target initial from the end is: `last`, the other one, `last`, ...
        other = USER + ASSISTANT - last
        cost = np.full((n + 1, width), _FAR, np.int64)
        offset = np.arange(self.low, self.high + 1)
        cost[0, offset >= 0] = INSERT * offset[offset >= 0]
        for i in range(1, n + 1):
            above, j = cost[i - 1], offset + self.stay[i]
            if gone[i - 1]:  # the offset stays as it is
                row = above + DELETE
            else:
                c = int(back[i - 1])
                small, more = c | 32, TRUNCATED * (c & 32 == 0)
                change = np.where((j & 1 == 1) == (small == last), 0, REROLE) if small in (last, other) else REROLE
                row = above + change + more
                row[:-1] = np.minimum(row[:-1], above[1:] + DELETE)
            row[j < 0] = _FAR
            row = np.minimum.accumulate(row - INSERT * offset) + INSERT * offset
            row[j < 0] = _FAR
            cost[i] = row
        self.codes, self.cost, self.last, self.other, self.n = codes, cost, last, other, n

    def at(self, i: int, j: int) -> int:
        k = j - self.stay[i] - self.low
        return int(self.cost[i, k]) if j >= 0 and 0 <= k < self.cost.shape[1] else _FAR

    def lengths(self, turns: int) -> Iterator[int]:
        """Target lengths within the band when so many turns are left."""
        first = int(max(0, self.stay[turns] + self.low))
        return iter(range(first, int(self.stay[turns] + self.high) + 1))

    def trace(self, i: int, j: int) -> str:
        """The ASCII-least of the cheapest audits of the last i turns for the last j initials."""
        audit = []
        while i or j:
            now = self.at(i, j)
            if i and now == self.at(i - 1, j) + DELETE:
                audit.append("D")
                i -= 1
                continue
            if j and now == self.at(i, j - 1) + INSERT:
                audit.append("I")
                j -= 1
                continue
            kept = self.codes[self.n - i] | 32 == (self.last if j & 1 else self.other)
            audit.append("K" if kept else "R")
            i, j = i - 1, j - 1
        return "".join(audit)


def _aligned(codes: bytes, wanted: int, first: bool, last: int | None) -> tuple[int, str]:
    """Cost and audit of some turns: the first one becomes `wanted` (or, if `first`, a kept system turn goes before),
    and the last one `last`, or, if None, the conversation ends."""
    end = ASSISTANT if last is None else last
    pair = bytes([wanted, USER + ASSISTANT - wanted])
    table = _Table(codes, end, _greedy(codes, pair, end))
    n, even = len(codes), wanted != end
    fits = lambda j: (j % 2 == 0) == even
    best, audits = _FAR, []

    def offer(cost: int, audit) -> None:
        nonlocal best, audits
        if cost < best:
            best, audits = cost, []
        if cost == best < _FAR:
            audits.append(audit)

    for j in table.lengths(n):
        if fits(j):
            offer(table.at(n, j), (0, n, j))
    if first:
        for gone, c in enumerate(codes):
            if DELETE * gone > best:
                break
            if c | 32 == SYSTEM and c != GONE:
                paid = DELETE * gone + (0 if c & 32 else TRUNCATED)
                left = n - gone - 1
                for j in table.lengths(left):
                    if fits(j) and (j or last is not None):
                        offer(paid + table.at(left, j), (gone, left, j))
    found = [("D" * gone + "K" if left < n else "") + table.trace(left, j) for gone, left, j in audits]
    return best, min(found)


def _folded(codes: bytes, wanted: int, first: bool, last: int | None) -> tuple[int, str]:
    """The same result when the lengths of equal parity share a column, for parts too long for the table.

    Column 0 is the empty target, column 1 the targets that begin with `end`,
    column 2 the others but the empty one.
    """
    end = ASSISTANT if last is None else last
    other, n = USER + ASSISTANT - end, len(codes)
    begins = {1: end, 2: other}
    rows = [(0, INSERT, 2 * INSERT)]
    for c in reversed(codes):
        z, o, e = rows[-1]
        if c == GONE:
            rows.append((z + DELETE, o + DELETE, e + DELETE))
        else:
            small, more = c | 32, TRUNCATED * (c & 32 == 0)
            to_end, to_other = more + REROLE * (small != end), more + REROLE * (small != other)
            z2 = z + DELETE
            o2 = min(o + DELETE, min(z, e) + to_end)
            e2 = min(e + DELETE, o + to_other)
            rows.append((z2, o2, e2))
        z2, o2, e2 = rows[-1]
        o2 = min(o2, min(z2, e2) + INSERT)
        rows[-1] = (z2, o2, min(e2, o2 + INSERT))
    fits = [0, 2] if wanted != end else [1]

    def trace(i: int, k: int) -> str:
        audit = []
        while i or k:
            now = rows[i][k]
            c = codes[n - i] if i else GONE
            if i and now == rows[i - 1][k] + DELETE:
                audit.append("D")
                i -= 1
                continue
            before = [0, 2] if k == 1 else [1]
            inserted = [b for b in before if k and now == rows[i][b] + INSERT]
            if inserted:  # the empty target's audit deletes all, so it is ASCII-least
                audit.append("I")
                k = inserted[0]
                continue
            small, more = c | 32, TRUNCATED * (c & 32 == 0)
            step = more + REROLE * (small != begins[k])
            audit.append("K" if small == begins[k] else "R")
            i -= 1
            k = next(b for b in before if now == rows[i][b] + step)
        return "".join(audit)

    offers = [(rows[n][k], 0, n, k) for k in fits]
    if first:
        for gone, c in enumerate(codes):
            if DELETE * gone > min(o[0] for o in offers):
                break
            if c | 32 == SYSTEM and c != GONE:
                paid, left = DELETE * gone + (0 if c & 32 else TRUNCATED), n - gone - 1
                offers += [(paid + rows[left][k], gone, left, k) for k in fits if k or last is not None]
    best = min(o[0] for o in offers)
    starts = [o for o in offers if o[0] == best]
    return best, min(("D" * gone + "K" if left < n else "") + trace(left, k) for _, gone, left, k in starts)


def _calm(codes: bytes) -> list[int]:
    """Places of turns in the middle of CALM_TURNS alternating ones without fault, at least so many turns apart."""
    x = np.frombuffer(codes, np.uint8)
    clean = (x == USER) | (x == ASSISTANT)
    goes_on = np.zeros(len(x), bool)
    goes_on[1:] = clean[1:] & clean[:-1] & (x[1:] != x[:-1])
    run = np.arange(len(x)) - np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(x))))
    ends = np.flatnonzero(run >= CALM_TURNS - 1)
    found, free = [], 0
    for end in ends.tolist():
        if end >= free:
            found.append(end - CALM_TURNS // 2)
            free = end + WHOLE_TURNS // 4
    return found


@lru_cache(maxsize=1 << 14)
def _short(codes: bytes) -> tuple[int, str]:
    return _aligned(codes, USER, True, None)


def audit_of(codes: bytes) -> tuple[int, str]:
    """The least cost and the ASCII-least of the cheapest audits of a conversation, from one code for each turn."""
    if len(codes) <= WHOLE_TURNS:
        return _short(codes) if len(codes) <= 32 else _aligned(codes, USER, True, None)
    cost, audit, done, wanted = 0, [], 0, USER
    for at in [*_calm(codes), None]:
        part = codes[done:at]
        last = None if at is None else USER + ASSISTANT - codes[at]
        way = _aligned if len(part) <= WHOLE_TURNS else _folded
        more, edits = way(part, wanted, done == 0, last)
        cost += more
        audit.append(edits)
        if at is not None:
            audit.append("K")
            done, wanted = at + 1, last
    return cost, "".join(audit)


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: `conv_id`, `turn`, `role`, `text`, no null role or text.

    By `crc32("conv_id:turn") % 20` (a null is one space): 0 drops the row, 1
    empties its text, 2 removes `.`, `!` and `?`, 3 repeats it, 4 makes it a user turn.
    """
    kind = F.pmod(F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), _spaced("role").alias("role"), _spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    rows = rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


def marked(turns: DataFrame) -> DataFrame:
    """The turns with `mark` (of role and text), `blank`, `cut` (the last character ends no sentence), `later` (role and text stood in an earlier turn)."""
    mark = F.md5(F.concat(F.md5(F.col("role").cast("binary")), F.col("text")).cast("binary"))
    kept = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = turns.select(
        "conv_id", "turn", "role", "text", mark.alias("mark"), (F.length(kept) == 0).alias("blank"), (~F.substring(kept, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    # In each conversation, the first turn of each role and text; null turns come first.
    firsts = rows.groupBy("conv_id", "mark").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("at_null"))
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "first", "at_null")
    same = rows["conv_id"].eqNullSafe(F.col("c")) & (rows["mark"] == F.col("m"))
    later = F.col("turn").isNotNull() & (F.col("at_null") | (F.col("turn") > F.col("first")))
    return rows.join(firsts, same).select(*rows.columns, later.alias("later"))


#: Order of a conversation's turns; turns of one number go by a hash of role and text.
ORDER = ("conv_id", "turn", "mark")
_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _by_conversation(rows: DataFrame) -> DataFrame:
    """Each conversation in one task, in order, its header row (without mark) first."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("mark").isNotNull(), *ORDER[1:])


def _initial(role: str) -> str:
    return role[:1] or " "


class _Reading:
    """What one conversation's rows add up to, row after row."""

    def __init__(self, conv: int | None):
        self.conv, self.codes = conv, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self.turn = self.mark = self.initial = None

    def add(self, turn: int | None, initial: str, mark: str, blank: bool, cut: bool, later: bool) -> None:
        repeated = later or (self.mark == mark and self.turn == turn)
        if turn is not None and turn != self.most:
            self.distinct += 1
            self.least, self.most = (turn if self.least is None else self.least), turn
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.turn, self.mark, self.initial = turn, mark, initial
        if blank or repeated:
            self.blank += blank
            self.duplicate += not blank
            self.codes.append(GONE)
            return
        code = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial, OTHER)
        self.truncated += cut
        self.codes.append(_CUT_OFF[code] if cut else code)

    def row(self) -> tuple:
        cost, audit = audit_of(bytes(self.codes))
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _AUDIT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    reading, rows = None, []
    for batch in batches:
        for conv, turn, mark, initial, blank, cut, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "mark", "initial", "blank", "cut", "later"))):
            if mark is None:  # a header: the next conversation
                if reading:
                    rows.append(reading.row())
                reading = _Reading(conv)
            else:
                reading.add(turn, initial, mark, blank, cut, later)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows = []
    if reading:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(reading.row(), kinds)], names)


def audits(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: faults, and the cheapest repair.

    Columns: `conv_id`; `gaps`, missing turn numbers between the least and the
    greatest; `blank`, `duplicate` (role and text stood before) and `truncated`
    (no end of a sentence) turns, each turn under its first fault; `illegal`,
    neighbours whose role initials aren't su, ua or au; `cost`; `audit`, the
    initials of Keep, Rerole, Delete and Insert in order, the ASCII-least of the
    cheapest. `turns` is the outcome of `marked`; conversations of
    `conversations` without turns get zeros and an empty audit. Null turns stand
    first, turns of one number go by a hash of role and text; a null `conv_id`
    is a conversation like the others. An empty role is no legal one. A
    conversation may have any number of turns: they are read in order, a byte
    is kept for each. Empty tables give no rows; other columns are ignored.
    """
    ship(turns.sparkSession)
    ids = turns.select("conv_id").distinct() if conversations is None else conversations.select(F.col("conv_id").cast("long")).distinct()
    none = {"turn": "long", "mark": "string", "initial": "string", "blank": "boolean", "cut": "boolean", "later": "boolean"}
    heads = ids.select("conv_id", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    initial = F.when(F.length("role") == 0, " ").otherwise(F.substring("role", 1, 1))
    rows = turns.select("conv_id", "turn", "mark", initial.alias("initial"), "blank", "cut", "later")
    return _by_conversation(heads.unionAll(rows)).mapInArrow(_audits, _AUDIT)


_REPAIRED = "conv_id long, position long, edit string, turn long, role string, text string"


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _REPAIRED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    conv, audit, at, position, system = None, "", 0, 0, 0
    for batch in batches:
        rows = []

        def wanted() -> str:
            return "assistant" if (position - system) % 2 else "user"

        def inserts() -> None:
            nonlocal at, position
            while at < len(audit) and audit[at] == "I":
                rows.append((conv, position, "I", None, wanted(), ""))
                at, position = at + 1, position + 1

        for c, mark, edits, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "mark", "audit", "turn", "role", "text"))):
            if mark is None:
                conv, audit, at, position, system = c, edits, 0, 0, 0
                inserts()
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                if edit == "K" and position == 0 and role[:1] == "s":
                    system = 1
                rows.append((conv, position, edit, turn, role if edit == "K" else wanted(), text))
                position += 1
            inserts()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns: `conv_id`, `position` from 0, `edit` (K, R or I), `turn`, `role`, `text`.

    `turns` is the outcome of `marked`, `found` that of `audits`. Deleted turns
    are left out; inserted ones have no turn number and an empty text.
    """
    heads = found.select("conv_id", F.lit(None).cast("string").alias("mark"), "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = turns.select("conv_id", "mark", F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    return _by_conversation(heads.unionAll(rows)).mapInArrow(_repairs, _REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []

    def close() -> None:
        if now:
            done.append((now[0], now[1].hexdigest()))

    for batch in batches:
        for conv, position, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "position", "role", "text"))):
            if position == 0:
                close()
                now = (conv, hashlib.sha256())
            now[1].update(f"{chr(10) if position else ''}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), (pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), (pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """`conv_id` and `repaired_sha256` of its repaired turns: `role:text`, joined by new lines."""
    rows = turns.select("conv_id", "position", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Audits of the damaged conversations with the digest of each repaired one; one row per `conv_id`, without turns too."""
    ship(conversations.sparkSession)
    turns = written(marked(damaged(conversations)), "turns")
    found = written(audits(turns, conversations), "audits")
    marks = digests(repaired(turns, found)).withColumnRenamed("conv_id", "c")
    rows = found.join(marks, found["conv_id"].eqNullSafe(F.col("c")), "left").drop("c")
    return rows.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
