"""Conversation repair against a search over the grammar's states, and against plain reading of its rules."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from parcelio.llm import queries, repair


def search(codes):
    """Cheapest cost and ASCII-least audit by states: 0 start, 1 after s, 2 after u, 3 after a; up to 3 inserts in a row."""

    @lru_cache(None)
    def go(i, state, inserted):
        found = [(0, "")] if i == len(codes) and state in (0, 3) else []
        after = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
        to = {"u": 2, "a": 3}[after]

        def add(cost, edit, rest):
            if rest:
                found.append((cost + rest[0], edit + rest[1]))

        if inserted < 3:
            add(3, "I", go(i, to, inserted + 1))
        if i < len(codes):
            c = chr(codes[i])
            add(4, "D", go(i + 1, state, 0))
            if c != "d":
                more = 3 * c.isupper()
                if c.lower() == after:
                    add(more, "K", go(i + 1, to, 0))
                else:
                    add(3 + more, "R", go(i + 1, to, 0))
                if c.lower() == "s" and state == 0:
                    add(more, "K", go(i + 1, 1, 0))
        return min(found, default=None)

    return go(0, 0, 0)


def random_codes(rng, n):
    mostly = rng.choice(["ua", "uaUAsSxXd", "uuaad", "uUd", "sS", "x", "d"])
    pure = "ua" * n
    return "".join(rng.choice(mostly) if rng.random() < rng.choice([0.1, 0.5, 1]) else pure[i] for i in range(n)).encode()


def test_audits_against_a_search_over_states():
    rng = random.Random(2)
    for _ in range(4000):
        codes = random_codes(rng, rng.randint(0, 14))
        assert repair.audit_of(codes) == search(codes), codes
    for _ in range(30):
        codes = random_codes(rng, rng.randint(60, 200))
        assert repair.audit_of(codes) == search(codes), codes


def test_parts_and_folded_lengths_change_nothing(monkeypatch):
    rng = random.Random(3)
    cut = 0
    cases = [random_codes(rng, rng.randint(13, 80)) for _ in range(1500)]
    cases += [bytes(rng.choice(b"uaUAd") if rng.random() < 0.12 else b"ua"[i % 2] for i in range(120)) for _ in range(300)]
    want = [repair.audit_of(c) for c in cases]
    monkeypatch.setattr(repair, "WHOLE_TURNS", 12)
    for codes, (cost, audit) in zip(cases, want):
        cut += len(repair._calm(codes)) > 0
        assert repair.audit_of(codes) == (cost, audit), codes
    assert cut > 400


def test_very_long_conversations():
    rng = random.Random(4)
    ua = "ua" * 100_000
    mixed = bytes(rng.choice(b"uaUAsxd") if rng.random() < 0.3 else ua.encode()[i] for i in range(200_000))
    for codes in (ua.encode(), mixed, b"u" * 200_000, b"d" * 50_000):
        cost, audit = repair.audit_of(codes)
        assert len(audit) - audit.count("I") == len(codes)
    assert repair.audit_of(b"u" * 6000) == (9000, "KR" * 3000)


FIRST = {"s", "u", "a"}


def plainly(rows):
    """The contract's columns for each conversation, read row by row; ties of one turn by the operator's hash of role and text."""
    spaced = lambda v: " " if v is None else str(v)
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = []
    for conv, mine in out.items():
        key = lambda r: hashlib.md5((hashlib.md5(r[1].encode()).hexdigest() + r[2]).encode()).hexdigest()
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, key(r)))
        seen, faults, codes = set(), [], []
        for turn, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            c = role[:1] if role[:1] in FIRST else "x"
            codes.append("d" if fault in ("blank", "duplicate") else c.upper() if fault else c)
        cost, audit = search("".join(codes).encode())
        turns = [t for t, *_ in mine if t is not None]
        initials = [r[1][:1] or " " for r in mine]
        lines, left, names = [], iter(mine), {"u": "user", "a": "assistant"}
        state = ""
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            after = "a" if state == "u" else "u"
            if edit == "K":
                lines.append(f"{row[1]}:{row[2]}")
                state = row[1][0]
            else:
                lines.append(f"{names[after]}:{row[2] if row else ''}")
                state = after
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        found.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return found


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture
def run(spark, monkeypatch):
    def of(rows, more=()):
        table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *more)
        monkeypatch.setattr(queries, "_table", lambda *_: table)
        return queries.op12_conversation_repair(spark, "")

    return of


def test_query_against_plain_reading(run):
    rng = random.Random(7)
    rows = []
    for conv in [*range(150), None]:
        n = rng.choice([0, 1, 2, 5, 9, 14])
        for turn in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = "system" if turn == 0 and rng.random() < 0.4 else rng.choice([None, "", "tool", "System", "supervisor"]) if rng.random() < 0.05 else role
            text = rng.choice(["Yes.", "No!", "Why?", "Well", " \t\n", "", None, "Fine. ", "A é 日本.", "x\x85", "Ends. "])
            rows.append((conv, rng.choice([turn, turn, turn, turn, None, turn + 3, turn - 1]), role, text))
    rows += [(500, None, "user", "a."), (500, None, "user", "a."), (501, None, None, None)]
    got = sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in run(rows).collect())))
    assert got == sorted(map(str, plainly(rows)))


def test_given_rows(run):
    by_kind = {}
    for i in range(1000):
        by_kind.setdefault(zlib.crc32(f"{i}:0".encode()) % 20, i)
    rows = [(by_kind[k], 0, "assistant", "Good. Day!") for k in range(6)]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS[1:-1]) for r in run(rows).collect()}
    want = {0: (0, 0, 0, 0, 0, 0, ""), 1: (0, 1, 0, 0, 0, 4, "D"), 2: (0, 0, 0, 1, 0, 4, "D"), 3: (0, 0, 1, 0, 1, 7, "IKD"), 4: (0, 0, 0, 0, 0, 3, "KI"), 5: (0, 0, 0, 0, 0, 3, "IK")}
    assert got == {by_kind[k]: v for k, v in want.items()}


def test_empty_and_clashing_names(run):
    assert run([]).count() == 0
    got = run([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], ["1 AS mark", "2 AS cut", "3 AS `a.b`", "4 AS audit", "5 AS first", "6 AS kind"])
    assert got.count() == 1


def test_repaired_turns_are_real_rows(spark):
    table = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi?"), (1, 3, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    turns = repair.marked(table)
    found = repair.audits(turns)
    assert found.first()["audit"] == "KKIKK"
    rows = [tuple(r)[1:] for r in repair.repaired(turns, found).orderBy("position").collect()]
    assert rows == [
        (0, "K", 0, "system", "Be kind."), (1, "K", 1, "user", "Hi."), (2, "I", None, "assistant", ""),
        (3, "K", 2, "user", "Hi?"), (4, "K", 3, "assistant", "Yes."),
    ]
