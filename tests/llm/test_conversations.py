"""Conversation repair against a programme on whole strings and an enumeration of all edits."""

import hashlib
import itertools
import random
import zlib

import pytest

from chronoloom.llm import conversations as cv

SCHEMA = "conv_id long, turn int, role string, text string, audit string, kind int"
SPACE = " \t\n\v\f\r"


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def repaired(rows, edits):
    lines, state, at = [], "", 0
    for e in edits:
        if e in "KD" or e == "R":
            role, text = rows[at][1:]
            at += 1
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if state == "u" else "user"
        lines.append(role + ":" + ("" if e == "I" else text))
        state = role[:1]
    return "\n".join(lines)


def brute(rows):
    """(cost, audit): the least of all edit strings, kept whole."""
    best = {"": (0, "")}
    order = faults(rows)

    def offer(cells, key, value):
        if key not in cells or value < cells[key]:
            cells[key] = value

    def inserts(cells):
        for _ in range(3):
            for k, (c, s) in list(cells.items()):
                offer(cells, "a" if k == "u" else "u", (c + 2, s + "I"))
        return cells

    best = inserts(best)
    for (_, role, _), fault in zip(rows, order):
        cells = {}
        for k, (c, s) in best.items():
            offer(cells, k, (c + 3, s + "D"))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[k] and role[:1]:
                    offer(cells, role[:1], (c + extra, s + "K"))
                offer(cells, "a" if k == "u" else "u", (c + 2 + extra, s + "R"))
        best = inserts(cells)
    return min(v for k, v in best.items() if k in ("", "a"))


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        conv_out = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        conv_out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def expected(rows):
    want = {}
    for conv, kept in damaged(rows).items():
        found, turns = faults(kept), [t for t, _, _ in kept if t is not None]
        cost, audit = brute(kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        digest = hashlib.sha256(repaired(kept, audit).encode()).hexdigest()
        want[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return want


def random_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "sage", "é"])
            text = rng.choice(["Yes.", "No!", "why?", "cut off", "", " \t", None, f"say {rng.randrange(5)}.", "über. \n", "long " * 50 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows + rows[:40]  # repeated rows


@pytest.mark.parametrize("keep", [1, 3000, 8 << 20])
def test_audits(spark, keep):
    rows = random_rows(3)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    found = cv.conversation_audits(df, keep).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(found) == len(got) and got == expected(rows)
    assert cv.conversation_audits(df.limit(0)).collect() == []


def test_repaired_turns(spark):
    rows = random_rows(4, 30)
    lines = {}
    for r in sorted(cv.repaired_turns(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect(), key=lambda r: r.ord):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = {conv: repaired(kept, brute(kept)[1]) for conv, kept in damaged(rows).items()}
    assert {k: "\n".join(v) for k, v in lines.items()} == {k: v for k, v in want.items() if v}


def test_long_conversation(spark):
    """One conversation with most rows, whose audit is settled in pieces; its rows leave memory."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "tool"]), f"text {rng.randrange(2000)}" + rng.choice(["", ".", "!"])) for t in range(3000)] + [(8, 0, "user", "Only.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in cv.conversation_audits(df, 20_000).collect()}
    assert got == expected(rows)


def test_all_edits():
    """The programme on whole strings, which the others are held against, finds the least of all edit strings."""
    rng = random.Random(6)

    def all_edits(rows):
        order = faults(rows)
        found = []

        def walk(i, state, cost, edits):
            if cost > 3 * len(rows) + 4:
                return
            if i == len(rows) and state in ("", "a"):
                found.append((cost, edits))
            other = "a" if state == "u" else "u"
            walk(i, other, cost + 2, edits + "I")
            if i < len(rows):
                walk(i + 1, state, cost + 3, edits + "D")
                if order[i] not in ("blank", "duplicate"):
                    extra, first = int(order[i] == "truncated"), rows[i][1][:1]
                    walk(i + 1, other, cost + 2 + extra, edits + "R")
                    if first and first in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                        walk(i + 1, first, cost + extra, edits + "K")

        walk(0, "", 0, "")
        return min(found)

    for _ in range(150):
        rows = [(t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "c!", ""])) for t in range(rng.randrange(5))]
        assert all_edits(rows) == brute(rows)


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 3])
def test_collisions(monkeypatch, prime):
    """Hashes that agree by chance (nearly always, at a modulus of 3) change nothing."""
    monkeypatch.setattr(cv, "_PRIME", prime)
    rng = random.Random(8)
    for _ in range(60):
        rows = [(t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "c!", "", f"{t}."])) for t in range(rng.randrange(25))]
        programme = cv.Programme()
        for (_, role, _), fault in zip(rows, faults(rows)):
            programme.row(role[:1], fault in ("blank", "duplicate"), int(fault == "truncated"))
        cost, node = programme.best()
        assert (cost, programme.audits.letters(node)) == brute(rows)
    audits = cv.Audits()
    words = ["".join(rng.choice("DIKR") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    nodes = []
    for word in words:
        node = 0
        for letter in word:
            node = audits.child(node, letter)
        nodes.append(node)
    for a, x in zip(words, nodes):
        for b, y in zip(words, nodes):
            assert audits.less(x, y) == (a < b)
