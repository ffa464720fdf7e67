"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A Viterbi search over the last role written. Its survivors are leaves of a tree of backpointers whose nodes count what
refers to them. Nodes that no survivor descends from go at once; where all survivors share an ancestor, the edits down
to it are decided and emitted. So what is held of a conversation is its undecided end, not its whole length. Paths of
equal cost are told apart by the first edit in which they differ, found through jump pointers up to their last common
node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.conversations import Rows, in_order, rows_of, turns_of

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: What has been written so far: nothing, only a system turn, last a user turn, last an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT_USER, NEXT_ASSISTANT = (EMPTY, SYSTEM, ASSISTANT), (USER,)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: (state, other, most) : whatever completes ``state`` completes ``other`` at no more than ``most`` more, so a survivor of
#: ``state`` that is behind ``other`` by more than that can't win.
DOMINATED = (
    (EMPTY, ASSISTANT, DELETE_COST),
    (EMPTY, USER, DELETE_COST + INSERT_COST),
    (SYSTEM, ASSISTANT, 0),
    (SYSTEM, USER, INSERT_COST),
    (ASSISTANT, EMPTY, 0),
)


class Node:
    """An edit: the path from the root to a node is what has been done. ``refs`` counts children and survivors."""

    __slots__ = ("parent", "jump", "depth", "letter", "row", "role", "refs")

    def __init__(self, parent: Node | None, letter: str, row: tuple | None, role: str | None):
        self.parent, self.letter, self.row, self.role, self.refs = parent, letter, row, role, 0
        if parent is None:
            self.depth, self.jump = 0, self
            return
        parent.refs += 1
        self.depth = parent.depth + 1
        far = parent.jump
        self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent


class Repair:
    """The search over one conversation: ``step`` takes the rows in order, ``finish`` ends it; both give decided edits."""

    def __init__(self):
        self.root = Node(None, "", None, None)
        self.root.refs = 1
        self.best: list[tuple[int, Node] | None] = [(0, self.root), None, None, None]
        self.insert()

    def climb(self, node: Node, depth: int) -> Node:
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.parent
        return node

    def before(self, x: Node, x_letter: str, y: Node, y_letter: str) -> bool:
        """Is the path to ``x`` and then ``x_letter`` smaller than that to ``y`` and ``y_letter``?"""
        if x is y:
            return x_letter < y_letter
        depth = min(x.depth, y.depth)
        a, b = self.climb(x, depth), self.climb(y, depth)
        if a is b:  # one path goes through the other's end
            if x.depth > depth:
                return self.climb(x, depth + 1).letter < y_letter
            return x_letter < self.climb(y, depth + 1).letter
        least = self.root.depth
        while a.parent is not b.parent:
            if a.jump is not b.jump and a.jump.depth == b.jump.depth >= least:
                a, b = a.jump, b.jump
            else:
                a, b = a.parent, b.parent
        return a.letter < b.letter

    def better(self, cost: int, node: Node, letter: str, than: tuple | None) -> bool:
        return than is None or cost < than[0] or cost == than[0] and self.before(node, letter, than[1], than[2])

    def release(self, node: Node | None) -> None:
        """One reference less; nodes that nothing refers to any more go, up to one that has other children."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            node.parent, node = None, node.parent
            node.refs -= 1

    def insert(self) -> None:
        """Empty turns may be put in anywhere: one or two lead from each state to the two last ones."""
        for _ in range(2):
            for target, sources in ((USER, NEXT_USER), (ASSISTANT, NEXT_ASSISTANT)):
                for source in sources:
                    if self.best[source] is None:
                        continue
                    cost, node = self.best[source]
                    held = self.best[target]
                    # A survivor at the root ends where all paths pass, so none of the same cost is smaller.
                    than = held and (held[0], held[1].parent or self.root, held[1].letter if held[1].parent else "")
                    if self.better(cost + INSERT_COST, node, INSERT, than):
                        self.replace(target, (cost + INSERT_COST, Node(node, INSERT, None, ROLES[target])))

    def replace(self, state: int, new: tuple[int, Node]) -> None:
        new[1].refs += 1
        if self.best[state] is not None:
            self.release(self.best[state][1])
        self.best[state] = new

    def step(self, initial: str, row: tuple, forced: bool, truncated: bool) -> Iterator[Node]:
        """A row with the first letter of its role; ``forced``: it has to go; ``truncated``: staying costs more."""
        won: list[tuple | None] = [None] * 4
        stay = TRUNCATED_COST if truncated else 0
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            if self.better(cost + DELETE_COST, node, DELETE, won[state]):
                won[state] = (cost + DELETE_COST, node, DELETE)
            if forced:
                continue
            if state == EMPTY and initial == "s" and self.better(cost + stay, node, KEEP, won[SYSTEM]):
                won[SYSTEM] = (cost + stay, node, KEEP)
            target, wanted = (ASSISTANT, "a") if state == USER else (USER, "u")
            cost, letter = (cost + stay, KEEP) if initial == wanted else (cost + stay + REROLE_COST, REROLE)
            if self.better(cost, node, letter, won[target]):
                won[target] = (cost, node, letter)
        before, self.best = self.best, [None] * 4
        for state, choice in enumerate(won):
            if choice is not None:
                cost, node, letter = choice
                role = None if letter == DELETE else ROLES[state] if letter == REROLE else row[1]
                kept = row if letter != DELETE else (row[0], row[1], None, row[3])
                self.replace(state, (cost, Node(node, letter, kept, role)))
        for held in before:
            if held is not None:
                self.release(held[1])
        self.insert()
        for state, other, most in DOMINATED:
            a, b = self.best[state], self.best[other]
            if a is not None and b is not None and a[0] > b[0] + most:
                self.release(a[1])
                self.best[state] = None
        return self.decided()

    def decided(self) -> Iterator[Node]:
        """Moves the root down while only one path leads on, and gives the edits passed."""
        leaf = next(held[1] for held in self.best if held is not None)
        while self.root.refs == 1 and leaf is not self.root:
            child = self.climb(leaf, self.root.depth + 1)
            # Nodes further down may still have this one as their jump; it must not hold what came before.
            self.root.jump, self.root.row = self.root, None
            child.parent, child.jump, self.root = None, child, child
            yield child

    def finish(self) -> tuple[int, list[Node]]:
        """The cost of the cheapest whole repair and its edits that were not decided before."""
        (cost, node), *more = (held for held in (self.best[EMPTY], self.best[ASSISTANT]) if held is not None)
        for other_cost, other in more:
            if other_cost < cost or other_cost == cost and self.before(other, "", node, ""):
                cost, node = other_cost, other
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return cost, path[::-1]


EDITS = pa.schema(
    [("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("old_role", pa.string()), ("fault", pa.string()), ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64())]
)
EDIT_COLUMNS = "conv_id long, step long, edit string, turn long, old_role string, fault string, role string, text string, cost long"
SUMMARY = pa.schema(
    [("conv_id", pa.int64()), *((name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
SUMMARY_COLUMNS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_START = object()


def with_faults(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, fault``: the first that holds of ``blank`` (no character but white space),
    ``duplicate`` (role and text stood earlier in the conversation) and ``truncated`` (the last such character is no
    full stop, exclamation or question mark); null for a row without fault. Null roles and texts count as one space."""
    turns = turns_of(conversations, " ").repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(earlier, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return turns.withColumn("fault", fault)


def edits(conversations: DataFrame) -> DataFrame:
    """The repair of each conversation as one row per edit, in order: ``conv_id, step, edit, turn, old_role, fault, role,
    text, cost``. ``edit`` is K (keep), R (other role), D (delete) or I (insert an empty turn); ``role`` and ``text`` are
    what the repaired conversation has (null for D), the next three what the row had (null for I), ``cost`` is what
    the edit costs. The roles kept make ``(s?(ua)+)?``; blank and duplicate rows go, truncated ones cost more if they
    stay. Of the cheapest repairs the one whose edits are the smallest string is taken.

    Rows go by turn (nulls first), those of one turn by role and text. Nulls count as one space; a null ``conv_id`` is a
    conversation. Other columns are ignored; an empty table gives no rows. A conversation is one task's stream: its
    length costs time, not memory.
    """

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, search, step, out = _START, None, 0, Rows(EDITS)

        def put(node: Node) -> None:
            nonlocal step
            turn, old, text, fault = node.row or (None, None, "", None)
            cost = {KEEP: 0, REROLE: REROLE_COST, DELETE: DELETE_COST, INSERT: INSERT_COST}[node.letter]
            cost += TRUNCATED_COST if fault == "truncated" and node.letter in (KEEP, REROLE) else 0
            out.put((own, step, node.letter, turn, old, fault, node.role, text, cost), len(text or ""))
            step += 1

        for conv_id, turn, role, text, fault in rows_of(batches):
            if conv_id != own or own is _START:
                if search:
                    for node in search.finish()[1]:
                        put(node)
                own, search, step = conv_id, Repair(), 0
            forced = fault == "blank" or fault == "duplicate"
            for node in search.step(role[:1], (turn, role, text, fault), forced, fault == "truncated"):
                put(node)
            if out.full:
                yield out.batch()
        if search:
            for node in search.finish()[1]:
                put(node)
        yield out.batch()

    # Of equal rows of one turn that without the fault comes first.
    order = ["conv_id", "turn", "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False))]
    return with_faults(conversations).sortWithinPartitions(*order).mapInArrow(repair, EDIT_COLUMNS)


def summaries(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``edits``, read in their order: turns missing between the first and the last
    (``gaps``), rows by fault, neighbouring rows with roles that may not follow each other (``illegal``), the cost, the
    edits as a string and the digest of the repaired conversation (``role:text``, joined by line feeds)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = _START, Rows(SUMMARY)

        def done() -> None:
            gaps = last_turn - first_turn + 1 - turns if turns else 0
            out.put((own, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, total, "".join(audit), sha.hexdigest()))

        for conv_id, _, edit, turn, old, fault, role, text, cost in rows_of(batches):
            if conv_id != own or own is _START:
                if own is not _START:
                    done()
                own, faults, illegal, total, audit, sha, written = conv_id, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0, [], hashlib.sha256(), False
                first_turn = last_turn = last_role = None
                turns = 0
            total += cost
            audit.append(edit)
            if role is not None:
                sha.update(f"{chr(10) * written}{role}:{text}".encode())
                written = True
            if edit == INSERT:
                continue
            if fault is not None:
                faults[fault] += 1
            if last_role is not None and last_role[:1] + old[:1] not in ("su", "ua", "au"):
                illegal += 1
            last_role = old
            if turn is not None and turn != last_turn:
                first_turn, last_turn, turns = turn if first_turn is None else first_turn, turn, turns + 1
            if out.full:
                yield out.batch()
        if own is not _START:
            done()
        yield out.batch()

    return repaired.mapInArrow(read, SUMMARY_COLUMNS)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` (a null is one space), modulo 20: 0 drops the row, 1 empties its
    text, 2 takes full stops, exclamation and question marks out of it, 3 repeats the row, 4 makes its role ``user``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    damage: Column = F.crc32(F.encode(key, "UTF-8")) % 20
    rows = turns_of(conversations, " ").withColumn("damage", damage).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``summaries`` of the damaged conversations, with a row for each that lost all its rows: zeros, no edits, the digest
    of the empty text."""
    found = summaries(edits(damaged(conversations))).alias("f")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("e")
    joined = every.join(found, F.expr("e.conv_id <=> f.conv_id"), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    columns = [n for n in SUMMARY.names if n != "conv_id"]
    return joined.select("e.conv_id", *(F.coalesce(F.col(f"f.{n}"), none.get(n, F.lit(0).cast("long"))).alias(n) for n in columns))
