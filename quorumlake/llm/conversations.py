"""Operator 12: conversation structure repair with a persistent audit.

A conversation is read once, row by row. For each state of the pattern ``(s?(ua)+)?``
(nothing yet, after system, after user, after assistant) the cheapest edits so far are
kept. Their audit, a text of edit initials, is a linked node that shares its prefix with
the other states' nodes: a node has its last initial, its parent, its depth, a rolling
hash of the whole text, and one jump to an ancestor further up, so chosen that any
ancestor is reached in logarithmic time and nodes of one depth jump alike (binary lifting
with one pointer a node). Of edits that cost the same, the least audit wins: both nodes
are brought to one depth and climb together while hashes differ, which gives the longest
common prefix; equal hashes of different nodes are verified letter by letter.

Order is kept by such choices: two audits of one state and row are never prefixes of one
another, as the shorter one would have deleted, kept or changed the same rows at less cost.

The digest of the repaired rows is carried forward too, one SHA-256 state for each state.
So a conversation's texts are never held: a task keeps four cells, the nodes (five
numbers each) and a 16-byte digest for each earlier row. A digest of all its rows chains
them, so one task has to see a conversation in order, however long it is.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)  # the state that an inserted or changed row leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\f\r"
BASE, PRIME = 911_382_323, (1 << 61) - 1


class Audit:
    """Texts that share prefixes; a text is the number of its last node, 0 the empty one."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self.parent, self.jump, self.depth, self.hash, self.letter = (array(t, [0]) for t in "qqqqb")

    def add(self, node: int, letter: str) -> int:
        jump = self.jump[node]
        alike = self.depth[node] - self.depth[jump] == self.depth[jump] - self.depth[self.jump[jump]]
        self.parent.append(node)
        self.jump.append(self.jump[jump] if alike else node)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % self.prime)
        self.letter.append(ord(letter))
        return len(self.parent) - 1

    def prefix(self, node: int, depth: int) -> int:
        """The node's ancestor at ``depth``."""
        while self.depth[node] > depth:
            node = self.jump[node] if self.depth[self.jump[node]] >= depth else self.parent[node]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth are the same text; equal hashes are verified."""
        if a == b or self.hash[a] != self.hash[b]:
            return a == b
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.prefix(a, depth), self.prefix(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        while not self.same(self.parent[x], self.parent[y]):
            if self.same(self.jump[x], self.jump[y]):
                x, y = self.parent[x], self.parent[y]
            else:
                x, y = self.jump[x], self.jump[y]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = bytearray()
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return out[::-1].decode()


class Repair:
    """One conversation: ``row`` for each row in order, then ``result``."""

    def __init__(self):
        self.audit = Audit()
        self.cells: list = [(0, 0, hashlib.sha256()), None, None, None]  # by state: cost, node, digest
        self.seen: set[bytes] = set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.low, self.high = 0, None, None
        self.last: str | None = None

    def _better(self, cells: list, state: int, cost: int, node: int, letter: str, digest, line: bytes | None, fresh: bool) -> None:
        """Offer an edit to a cell: the digest is that of the state before, to be continued by ``line``."""
        old = cells[state]
        if old is not None and old[0] < cost:
            return
        node = self.audit.add(node, letter)
        if old is not None and old[0] == cost and not self.audit.less(node, old[1]):
            return
        if line is not None:
            digest = digest.copy()
            digest.update(line if fresh else b"\n" + line)
        cells[state] = (cost, node, digest)

    def _insert(self) -> None:
        """Rows put in at this place: from any state to the next one, and on."""
        before = list(self.cells)
        for states in ((START, SYSTEM, ASSISTANT), (USER,)):
            for state in states:
                if (cell := before[state] if state != USER else self.cells[USER]) is not None:
                    to = NEXT[state]
                    self._better(self.cells, to, cell[0] + 2, cell[1], "I", cell[2], f"{ROLE[to]}:".encode(), state == START)

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial, bare = role[:1], text.rstrip(SPACE)
        if self.last is not None:
            self.counts["illegal"] += self.last + initial not in LEGAL
        self.last = initial
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        fault = "blank" if not bare else "duplicate" if key in self.seen else "truncated" if bare[-1] not in ".!?" else None
        self.seen.add(key)
        if fault:
            self.counts[fault] += 1
        if fault not in ("blank", "duplicate"):  # else what is put in before the row may as well come after it, where D stands first
            self._insert()
        cells: list = [None] * 4
        for state, cell in enumerate(self.cells):
            if cell is None:
                continue
            cost, node, digest = cell
            self._better(cells, state, cost + 3, node, "D", digest, None, False)
            if fault in ("blank", "duplicate"):
                continue
            cost += fault == "truncated"
            if (to := KEEPS.get((state, initial))) is not None:
                self._better(cells, to, cost, node, "K", digest, f"{role}:{text}".encode(), state == START)
            to = NEXT[state]
            self._better(cells, to, cost + 2, node, "R", digest, f"{ROLE[to]}:{text}".encode(), state == START)
        self.cells = cells

    def result(self) -> dict:
        self._insert()
        best = self.cells[START]
        full = self.cells[ASSISTANT]
        if best is None or full is not None and (full[0] < best[0] or full[0] == best[0] and self.audit.less(full[1], best[1])):
            best = full
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return {"gaps": int(gaps), **self.counts, "cost": best[0], "audit": self.audit.text(best[1]), "repaired_sha256": best[2].hexdigest()}


def replayed(rows: list[tuple[str, str]], audit: str) -> Iterator[tuple[int | None, str, str]]:
    """(index of the row or None, role, text) of the repaired conversation."""
    at, state = 0, START
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield None, ROLE[state], ""
            continue
        role, text = rows[at]
        if letter == "K":
            state = KEEPS[state, role[:1]]
            yield at, role, text
        elif letter == "R":
            state = NEXT[state]
            yield at, ROLE[state], text
        at += 1


def _ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, gone), conversations whole and in order; columns that ``rows`` lacks are not asked for."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), value(role_col).alias("role"), value(text_col).alias("text"), gone.alias("gone"))
    return plain.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _streamed(ordered: DataFrame, schema: str, begin, take, end) -> DataFrame:
    """``mapInArrow`` over rows that stand together by ``conv``: begin(), take(state, row), end(state) -> rows of ``schema`` without conv."""
    conv_type = ordered.schema["conv"].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(", ")]

    def task(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string()}
        types = [kinds[part.split()[1]] for part in schema.split(", ")]
        open_, state, convs, out, held = None, None, [], [], 0

        def batch(conv_kind):
            columns = [pa.array(convs, conv_kind), *(pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True))]
            return pa.RecordBatch.from_arrays(columns, ["conv", *names])

        kind = None
        for rows in batches:
            kind = rows.schema.field(0).type
            for conv, *row in zip(*(rows.column(i).to_pylist() for i in range(5)), strict=True):
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        got = end(state)
                        convs += [open_[0]] * len(got)
                        out += got
                        held += sum(len(x.get("audit") or x.get("text") or "") + 100 for x in got)
                        if held > 4 << 20:
                            yield batch(kind)
                            convs, out, held = [], [], 0
                    open_, state = (conv,), begin()
                take(state, row)
        if open_ is not None:
            got = end(state)
            convs += [open_[0]] * len(got)
            out += got
            yield batch(kind)

    return ordered.mapInArrow(task, f"conv {conv_type}, {schema}")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows stand by turn, nulls first, rows of one turn by role and text. A row's first
    fault counts: blank (no sign but space, tab and line ends), duplicate (role and text
    stood earlier), truncated (the last such sign is none of ``.!?``). Edits: keep (0),
    rerole to user or assistant (2), delete (3; the only one for blank and duplicate
    rows), insert an empty row of user or assistant (2); a truncated row that stays adds
    1. The cheapest edits to role initials ``(s?(ua)+)?`` are taken, the least audit of
    equal ones. A null role or text is one space; a null conversation is one, too; an
    empty table gives no rows. Rows with a true ``gone``, if there is such a column, only
    name their conversation. Other columns are not read.
    """

    def take(state: Repair, row: list) -> None:
        turn, role, text, gone = row
        if not gone:
            state.row(turn, role, text)

    ordered = _ordered(rows, conv_col, turn_col, role_col, text_col)
    return _streamed(ordered, REPORT, Repair, take, lambda state: [state.result()])


def rewritten(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, position, turn, role, text): the repaired conversations; inserted rows have no turn. A task holds one conversation's texts."""

    def take(state, row: list) -> None:
        turn, role, text, gone = row
        if not gone:
            state[0].row(turn, role, text)
            state[1].append((turn, role, text))

    def end(state) -> list[dict]:
        kept = replayed([(role, text) for _, role, text in state[1]], state[0].result()["audit"])
        return [{"position": i, "turn": None if at is None else state[1][at][0], "role": role, "text": text} for i, (at, role, text) in enumerate(kept)]

    ordered = _ordered(rows, conv_col, turn_col, role_col, text_col)
    return _streamed(ordered, "position long, turn long, role string, text string", lambda: (Repair(), []), take, end)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): ``conversations`` with planted faults; dropped rows stay as ``gone``."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(value("text"), "[.!?]", "")).otherwise(value("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(value("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.withColumn("kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(times).alias("_copy")).drop("_copy")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows)).withColumnRenamed("conv", "conv_id")
