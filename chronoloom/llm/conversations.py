"""Conversation structure repair (operator 11): the cheapest audit of each conversation, by a persistent dynamic programme.

A repair is a string of edits (Keep, Rerole, Delete, Insert) that turns the rows of a conversation, in order, into
roles whose initials read ``(s?(ua)+)?``. The programme keeps the best edit string for each state of that pattern. Strings
share their prefixes as linked nodes; a node holds its ancestors at powers of two and a rolling hash of its whole string, so
that two strings of equal cost are compared by a search for their longest common prefix in logarithmic time. A node stands for
one string only, so a hash that agrees by chance is seen from its nodes, and the search then goes by these. Two different strings
of equal cost that have used the same rows and stand in the same state are never prefixes of each other (the longer would
have more inserts), so the smaller stays the smaller whatever follows.

Spark deals rows by conversation and sorts them; a task streams them in Arrow batches. What all states have in common is settled
and leaves memory as it becomes known. SHA-256 runs over a conversation's repaired text from front to back, so one conversation is
one stream, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, spread_join, written

START, SYSTEM, USER, ASSISTANT = range(4)
#: What a kept row's role initial leads to from each state.
KEEPS = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: The one role that an insert or a new role can take in each state.
NEEDS = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
SPACE = " \t\n\v\f\r"
MARK, ROW, GONE = range(3)
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6


class Audits:
    """Strings of edits as nodes that share their prefixes; node 0 is the empty string."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.ups = [""], [0], [0], [[]]
        self.made: dict[tuple[int, str], int] = {}

    def child(self, parent: int, letter: str) -> int:
        """The node of a string and one more letter; the same string is always the same node."""
        if (parent, letter) in self.made:
            return self.made[parent, letter]
        ups, k = [parent], 0
        while k < len(self.ups[ups[k]]):
            ups.append(self.ups[ups[k]][k])
            k += 1
        self.ups.append(ups)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append(self.hashed(parent, letter))
        self.made[parent, letter] = len(self.letter) - 1
        return len(self.letter) - 1

    def hashed(self, parent: int, letter: str) -> int:
        return (self.hash[parent] * _BASE + ord(letter)) % _PRIME

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.ups[node][min(len(self.ups[node]), (self.depth[node] - depth).bit_length()) - 1]
        return node

    def fork(self, a: int, b: int) -> tuple[int, int]:
        """The first nodes below the longest common prefix on the way to ``a`` and to ``b``; both the same if one is a prefix."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, depth), self.ancestor(b, depth)
        if a == b:
            return a, b
        for key in (self.hash, range(len(self.letter))):  # by hash, and by the nodes themselves if a hash agreed by chance
            x, y = a, b
            if key[x] == key[y]:
                continue
            for k in reversed(range(len(self.ups[x]))):
                if k < len(self.ups[x]) and key[self.ups[x][k]] != key[self.ups[y][k]]:
                    x, y = self.ups[x][k], self.ups[y][k]
            if self.ups[x][0] == self.ups[y][0]:
                return x, y
        raise AssertionError("all strings begin at node 0")

    def less(self, a: int, b: int) -> bool:
        """Whether ``a`` is before ``b`` in ASCII order."""
        x, y = self.fork(a, b)
        return self.letter[x] < self.letter[y] if x != y else self.depth[a] < self.depth[b]

    def common(self, nodes: list[int]) -> int:
        """The longest common prefix of all."""
        found = nodes[0]
        for node in nodes[1:]:
            x, y = self.fork(found, node)
            found = x if x == y else self.ups[x][0]
        return found

    def letters(self, node: int, root: int = 0) -> str:
        """The string from ``root`` to ``node``."""
        out = []
        while node != root:
            out.append(self.letter[node])
            node = self.ups[node][0]
        return "".join(reversed(out))


class Programme:
    """The best (cost, node) of each state after the rows so far; ``offer`` keeps the cheaper, then the ASCII-least."""

    def __init__(self) -> None:
        self.audits = Audits()
        self.cells: list[tuple[int, int, str] | tuple[int, int] | None] = [(0, 0), None, None, None]
        self._inserts()

    def _node(self, cell) -> int:
        return self.audits.child(cell[1], cell[2]) if len(cell) == 3 else cell[1]

    def _offer(self, state: int, cell: tuple[int, int, str]) -> None:
        held = self.cells[state]
        if held is None or cell[0] < held[0] or cell[0] == held[0] and self.audits.less(self._node(cell), self._node(held)):
            self.cells[state] = cell

    def _inserts(self) -> None:
        for state in (START, SYSTEM, ASSISTANT, USER):  # an insert leads to a user, or from there to an assistant; more would only cost
            if cell := self.cells[state]:
                cell = self.cells[state] = (cell[0], self._node(cell))
                self._offer(NEEDS[state][1], (cell[0] + 2, cell[1], "I"))
        for state, cell in enumerate(self.cells):
            if cell:
                self.cells[state] = (cell[0], self._node(cell))

    def row(self, initial: str, must_go: bool, extra: int) -> None:
        before, self.cells = self.cells, [None] * 4
        for state, cell in enumerate(before):
            if cell:
                cost, node = cell
                self._offer(state, (cost + 3, node, "D"))
                if not must_go:
                    if initial in KEEPS[state]:
                        self._offer(KEEPS[state][initial], (cost + extra, node, "K"))
                    self._offer(NEEDS[state][1], (cost + 2 + extra, node, "R"))
        self._inserts()
        whole = self.cells[ASSISTANT]
        if whole:  # whatever follows can follow here too, a kept system row being deleted at 3
            for state, most in ((START, whole[0] + 3), (SYSTEM, whole[0])):
                if self.cells[state] and self.cells[state][0] > most:
                    self.cells[state] = None

    def best(self) -> tuple[int, int]:
        ends = [c for c in (self.cells[START], self.cells[ASSISTANT]) if c]
        return ends[0] if len(ends) == 1 or ends[0][0] < ends[1][0] or ends[0][0] == ends[1][0] and self.audits.less(ends[0][1], ends[1][1]) else ends[1]

    def settle(self) -> str:
        """The letters that all states have in common; they leave the programme."""
        live = [c[1] for c in self.cells if c]
        root = self.audits.common(live)
        done, tails = self.audits.letters(root), [self.audits.letters(n, root) for n in live]
        self.audits = Audits()
        nodes = []
        for tail in tails:
            node = 0
            for letter in tail:
                node = self.audits.child(node, letter)
            nodes.append(node)
        renewed = iter(nodes)
        self.cells = [c and (c[0], next(renewed)) for c in self.cells]
        return done


class Conversation:
    """One conversation's rows in order: its counts, its programme, and the rows that no settled edit has used yet."""

    def __init__(self, conv_id, emit: Callable[[str, str, str], None], keep: int):
        self.conv_id, self.emit, self.keep, self.most = conv_id, emit, keep, keep
        self.n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns: list[int] = []  # first, last and number of different ones
        self.initial: str | None = None
        self.last: tuple | None = None
        self.programme, self.audit = Programme(), []
        self.state, self.rows, self.at, self.size = START, [], 0, 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        """``again``: the same role and text have been seen at an earlier turn; rows of one turn are compared here."""
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if again or self.last == (turn, role, text) else "truncated" if bare[-1] not in ".!?" else None
        self.last = (turn, role, text)
        if fault:
            self.n[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.n["illegal"] += 1
        self.initial = initial
        if turn is not None:
            first, last, n = self.turns or (turn, None, 0)
            self.turns = [first, turn, n + (turn != last)]
        self.programme.row(initial, fault in ("blank", "duplicate"), int(fault == "truncated"))
        self.rows.append((role, text))
        self.size += len(text) + 512
        if self.size > self.most:
            self._apply(self.programme.settle())
            self.rows, self.at = self.rows[self.at :], 0
            self.size = sum(len(t) + 512 for _, t in self.rows)
            self.most = max(self.keep, 2 * self.size)

    def _apply(self, letters: str) -> None:
        self.audit.append(letters)
        for letter in letters:
            if letter != "I":
                role, text = self.rows[self.at]
                self.at += 1
            if letter == "D":
                continue
            if letter == "K":
                self.state = KEEPS[self.state][role[:1]]
            else:
                role, self.state = NEEDS[self.state]
            self.emit(letter, role, "" if letter == "I" else text)

    def end(self) -> dict:
        """The report; all edits have been emitted."""
        cost, node = self.programme.best()
        self._apply(self.programme.audits.letters(node))
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.n, "cost": cost, "audit": "".join(self.audit)}


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after damage by crc32(conv_id:turn) % 20; a dropped row is ``gone``, not absent.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user. Nulls become one space, turns stay null.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long"), plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _marks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b) of the rows whose role and text an earlier turn of their conversation has; a, b: 128 bits of all three."""
    keys = rows.where("NOT gone").select("conv_id", "turn", "a", "b").groupBy("conv_id", "turn", "a", "b").agg(F.lit(1).alias("one")).drop("one")
    turn = F.struct("turn")  # a null turn is the first
    groups = written(keys.groupBy("a", "b").agg(F.min(turn).alias("first"), F.max(turn).alias("last"), F.count("*").alias("times")).where("first <> last"))
    return spread_join(keys, groups, ["a", "b"]).where(turn > F.col("first")).select("conv_id", "turn", "a", "b")


def _streamed(rows: DataFrame, keep: int, schema: T.StructType, listed: bool) -> DataFrame:
    """One row a conversation, or with ``listed`` one row an edit that leaves a row."""
    rows = rows.withColumns({"a": F.xxhash64("conv_id", "role", "text"), "b": F.xxhash64(F.lit(1), "conv_id", "role", "text")})
    text = lambda c: F.when(~F.col("gone"), F.col(c)).alias(c)
    told = rows.select("conv_id", "turn", F.when(F.col("gone"), GONE).otherwise(ROW).alias("kind"), text("role"), text("text"), "a", "b")
    marks = _marks(rows).select("conv_id", "turn", F.lit(MARK).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "a", "b")
    dealt = told.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, seen, at = None, [], set(), None
        digest = hashlib.sha256()
        lines = 0

        def emit(letter: str, role: str, text: str) -> None:
            nonlocal lines
            if listed:
                out.append({"conv_id": now.conv_id, "ord": lines, "edit": letter, "role": role, "text": text})
            else:
                digest.update((("\n" if lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            lines += 1

        def close() -> None:
            report = now.end()
            if not listed:
                out.append(report | {"repaired_sha256": digest.hexdigest()})

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, arrow)
            out.clear()
            return made

        arrow = None
        for batch in small_batches(batches):
            arrow = arrow or pa.schema([batch.schema.field("conv_id"), *[pa.field(f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in schema.fields[1:]]])
            for conv, turn, kind, role, text, a, b in zip(*[batch.column(k).to_pylist() for k in range(7)]):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        close()
                    digest, lines, seen, at = hashlib.sha256(), 0, set(), None
                    now = Conversation(conv, emit, keep)
                if kind == GONE:
                    continue
                if at != (turn,):
                    seen, at = set(), (turn,)
                if kind == MARK:
                    seen.add((a, b))
                else:
                    now.add(turn, role, text, (a, b) in seen)
            if out:
                yield batch_of()
        if now is not None:
            close()
            if out:
                yield batch_of()

    return dealt.mapInArrow(run, schema)


def _fields(rows: DataFrame, names: dict[str, str]) -> T.StructType:
    kinds = {"long": T.LongType(), "string": T.StringType()}
    return T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(n, kinds[k]) for n, k in names.items()]])


def conversation_audits(conversations: DataFrame, keep: int = 8 << 20) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation after ``damage``.

    Rows go by turn, nulls first; rows of one turn by role, then by text. A null role or text is one space, so its text is
    blank; a null turn or conv_id is one like others (rows without a conv_id are one conversation) but counts in no gap. Repeated rows
    are duplicates of each other. Conversations of which damage leaves no row have zeros, an empty audit and the hash
    of the empty text. An empty table gives no rows; other columns are ignored. Whole texts are used; ``keep`` bounds
    the characters that wait for the states to agree (the rows of a conversation on which they never agree all wait).
    """
    names = {n: "long" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "string", "repaired_sha256": "string"}
    return _streamed(damage(conversations), keep, _fields(conversations, names), False)


def repaired_turns(conversations: DataFrame, keep: int = 8 << 20) -> DataFrame:
    """(conv_id, ord, edit, role, text): the rows of the repaired conversations, as ``conversation_audits`` digests them."""
    return _streamed(damage(conversations), keep, _fields(conversations, {"ord": "long", "edit": "string", "role": "string", "text": "string"}), True)
