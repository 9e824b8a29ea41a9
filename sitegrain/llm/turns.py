"""Conversation structure repair by a dynamic program over persistent edit strings.

The turns of a conversation are read in order. Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert an empty
user or assistant turn 5; a truncated turn that stays costs 5 more; blank and duplicate turns must go. The cheapest
edits whose role initials read ``(s?(ua)+)?`` win, among these the ASCII-least string of their initials (D, I, K, R).

States of the program are the places in that pattern. Each holds its best edit string as a node whose ancestors are
its prefixes, so strings share what they have in common. Nodes carry binary-lifting ancestors and rolling hashes; equal
costs are settled by a search for the longest common prefix. Where hashes agree, the nodes must be one and the same:
equal strings always are one node, so a collision shows and counts as a difference.

Where all states share a prefix it is final: its turns leave and its nodes are freed. A task thus reads conversations
as a sorted stream and holds only what is undecided, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

_OPEN, _SYSTEM, _USER, _REPLY = range(4)  # nothing yet; after s; after u; after a
_AFTER = {(_OPEN, "s"): _SYSTEM, (_OPEN, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _REPLY, (_REPLY, "u"): _USER}
_NEXT = {_OPEN: "u", _SYSTEM: "u", _USER: "a", _REPLY: "u"}  # the role that a new or rerouted turn takes
_NAMES = {"u": "user", "a": "assistant"}
_BASE, _MODULUS = 911_382_323, (1 << 61) - 1


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults drawn by crc32 of ``conv_id:turn``: a test bed for the repair.

    0 drops the turn, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats it, 4 sets its role to user. Nulls
    read as one blank. Other columns stay.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.withColumn("__fault", fault).filter("__fault <> 0")
    left = F.when(F.col("__fault") == 1, F.lit("")).when(F.col("__fault") == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    rows = rows.withColumn("text", left).withColumn("role", F.when(F.col("__fault") == 4, F.lit("user")).otherwise(text("role")))
    times = F.when(F.col("__fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("__times", F.explode(times)).drop("__times", "__fault")


# -- the program


class Node:
    """An edit string: its last edit and, through ``up``, its prefixes 1, 2, 4, ... edits shorter."""

    __slots__ = ("edit", "depth", "digest", "up")

    def __init__(self, edit: str, parent: Node | None) -> None:
        self.edit, self.up = edit, []
        self.depth = 0 if parent is None else parent.depth + 1
        self.digest = 0 if parent is None else (parent.digest * _BASE + ord(edit)) % _MODULUS
        while parent is not None:
            k = len(self.up)
            self.up.append(parent)
            parent = parent.up[k] if k < len(parent.up) else None

    def lifted(self, steps: int) -> Node:
        node, k = self, 0
        while steps:
            if steps & 1:
                node = node.up[k]
            steps, k = steps >> 1, k + 1
        return node


def _same(a: Node, b: Node) -> bool:
    return a.digest == b.digest and a is b


def fork(a: Node, b: Node) -> tuple[Node, Node]:
    """The shortest prefixes of two strings of one length that differ, or twice the string if they do not."""
    if _same(a, b):
        return a, b
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and not _same(a.up[k], b.up[k]):
            a, b = a.up[k], b.up[k]
    return a, b


def precedes(a: Node, b: Node) -> bool:
    """Whether edit string ``a`` is ASCII-less than ``b``."""
    depth = min(a.depth, b.depth)
    x, y = fork(a.lifted(a.depth - depth), b.lifted(b.depth - depth))
    return a.depth < b.depth if x is y else x.edit < y.edit


def shared(nodes: list[Node]) -> Node:
    """The longest common prefix of some strings."""
    a, *rest = nodes
    for b in rest:
        depth = min(a.depth, b.depth)
        x, y = fork(a.lifted(a.depth - depth), b.lifted(b.depth - depth))
        a = x if x is y else x.up[0]
    return a


Best = dict[int, tuple[int, Node]]  # cost and edits of each state that can be reached


class Program:
    """Best edits of the turns read so far for every state."""

    def __init__(self) -> None:
        self.best: Best = {}
        self._reach(self.best, {}, _OPEN, 0, Node("", None))
        self._insert(self.best, {})

    def _reach(self, best: Best, made: dict, state: int, cost: int, parent: Node, edit: str = "") -> None:
        """Offer one more way into a state; equal strings of one step are one node."""
        have = best.get(state)
        if have is not None and have[0] < cost:
            return
        node = parent
        if edit:
            node = made.get((id(parent), edit)) or made.setdefault((id(parent), edit), Node(edit, parent))
        if have is None or cost < have[0] or (node is not have[1] and precedes(node, have[1])):
            best[state] = cost, node

    def _insert(self, best: Best, made: dict) -> None:
        # Two new turns reach every state that new turns can reach; more cost without need.
        for _ in range(2):
            for state, (cost, node) in list(best.items()):
                self._reach(best, made, _AFTER[state, _NEXT[state]], cost + INSERT, node, "I")

    def read(self, initial: str, gone: bool, truncated: bool) -> None:
        """One more turn: initial of its role, whether it must go, whether its text breaks off."""
        best: Best = {}
        made: dict = {}
        stay = TRUNCATED if truncated else 0
        for state, (cost, node) in self.best.items():
            self._reach(best, made, state, cost + DELETE, node, "D")
            if not gone:
                if (state, initial) in _AFTER:
                    self._reach(best, made, _AFTER[state, initial], cost + stay, node, "K")
                self._reach(best, made, _AFTER[state, _NEXT[state]], cost + stay + REROLE, node, "R")
        self._insert(best, made)
        # What may follow "nothing yet" may follow a reply too, if a kept system turn is deleted instead; what may
        # follow a system turn may follow a reply. So these two fall away where they cost more.
        for state, spare in ((_OPEN, DELETE), (_SYSTEM, 0)):
            if state in best and best[state][0] > best[_REPLY][0] + spare:
                del best[state]
        self.best = best

    def final(self) -> tuple[int, Node]:
        """Cost and edits of the best legal end."""
        ends = [self.best[s] for s in (_OPEN, _REPLY) if s in self.best]
        cost = min(c for c, _ in ends)
        nodes = [n for c, n in ends if c == cost]
        return cost, nodes[0] if len(nodes) == 1 or precedes(*nodes) else nodes[1]

    def settled(self) -> str:
        """The edits that all states share; they leave, and the nodes behind them with them."""
        root = shared([n for _, n in self.best.values()])
        edits = path(root)
        copies = {id(root): Node("", None)}
        best = {}
        for state, (cost, node) in self.best.items():
            chain = []
            while id(node) not in copies:
                chain.append(node)
                node = node.up[0]
            for old in reversed(chain):
                copies[id(old)] = Node(old.edit, copies[id(old.up[0])])
            best[state] = cost, copies[id(chain[0])] if chain else copies[id(node)]
        self.best = best
        return edits


def path(node: Node) -> str:
    out = []
    while node.up:
        out.append(node.edit)
        node = node.up[0]
    return "".join(reversed(out))


@dataclass
class Repair:
    """One conversation while its turns are read: counts, edits and the turns that are settled."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    audit: list[str] = field(default_factory=list)
    cost: int = 0
    program: Program = field(default_factory=Program)
    waiting: list[tuple[str, str] | None] = field(default_factory=list)
    state: int = _OPEN
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0
    step: int = 256  # turns between two looks at what is settled

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def read(self, turn: int | None, role: str, text: str, duplicate: bool) -> Iterator[tuple[str, str]]:
        """Take the next turn in order; turns that are settled by now come out as (role, text)."""
        if turn is not None:
            self.low, self.turns = (turn if self.low is None else self.low), self.turns + (turn != self.high)
            self.high = turn
        initial, left = role[:1], text.rstrip(BLANKS)
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        blank = not left
        repeat = not blank and duplicate
        broken = not blank and not repeat and left[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeat, self.truncated + broken
        self.program.read(initial, blank or repeat, broken)
        self.waiting.append(None if blank or repeat else (role, text))
        if len(self.waiting) >= self.step:
            yield from self._leave(self.program.settled())
            self.step = max(256, 2 * len(self.waiting))

    def close(self) -> Iterator[tuple[str, str]]:
        self.cost, node = self.program.final()
        yield from self._leave(path(node))

    def _leave(self, edits: str) -> Iterator[tuple[str, str]]:
        self.audit.append(edits)
        at = 0
        for edit in edits:
            turn = None
            if edit != "I":
                turn, at = self.waiting[at], at + 1
            if edit == "D":
                continue
            initial = turn[0][:1] if edit == "K" else _NEXT[self.state]
            self.state = _AFTER[self.state, initial]
            yield turn if edit == "K" else (_NAMES[initial], turn[1] if turn else "")
        del self.waiting[:at]


# -- conversations on Spark

_REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)
_TURNS = "conv_id bigint, position bigint, role string, text string"


def _in_order(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Turns by conversation and order, each conversation headed by a row of its own (``kind`` 0).

    Texts move once. What is a duplicate is found on digests beside them: the first place of every (role, text) is a
    row that stands right before that place (``kind`` 1; turns are ``kind`` 2).
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), filled("role").alias("role"), filled("text").alias("text"))
    rows = rows.withColumn("digest", F.md5("text"))
    key = ["conv_id", "role", "digest"]
    first = rows.groupBy(*key).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("f"))
    none = lambda t: F.lit(None).cast(t)
    stream = (
        rows.select("conv_id", "turn", "role", "text", "digest", F.lit(2).alias("kind"))
        .union(first.select("conv_id", "f.turn", "role", none("string"), "digest", F.lit(1)))
        .union(conversations.select(F.col("conv_id").cast("bigint")).distinct().select("conv_id", none("bigint"), none("string"), none("string"), none("string"), F.lit(0)))
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest"), F.col("kind")]
    return stream.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "kind")


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, repair, settled turns or None at its end) in order."""
    at, open_, fresh = None, None, False
    for batch in batches:
        for conv, turn, role, text, kind in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind"))):
            if open_ is None or conv != at:
                if open_ is not None:
                    yield at, open_, open_.close()
                    yield at, open_, None
                at, open_, fresh = conv, Repair(), False
            if kind == 2:
                yield at, open_, open_.read(turn, role, text, not fresh)
            fresh = kind == 1
    if open_ is not None:
        yield at, open_, open_.close()
        yield at, open_, None


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, position, role, text``: the turns of every conversation after the cheapest repair, from position 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        position = 0
        pack = lambda: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "position", "role", "text"]
        )
        for conv, _, turns in _streamed(batches):
            if turns is None:
                position = 0
                continue
            for role, text in turns:
                out.append((conv, position, role, text))
                position += 1
            if len(out) >= 4096:
                yield pack()
                out = []
        if out:
            yield pack()

    return _in_order(rows, rows).mapInArrow(run, _TURNS)


def repairs(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair and the digest of what the repair leaves.

    ``gaps`` counts the turn numbers missing between smallest and largest; ``illegal`` counts neighbours whose role
    initials are none of su, ua, au. ``conversations`` may name conversations that have no rows left.

    Defined cases: null role and text read as one blank (so a null text is blank, and a null role can only be
    rerouted or deleted); null turns come first and count for no gap; turns with one number are ordered by role, then
    by the digest of the text; repeated rows are duplicates; rows without conv_id are one conversation; a conversation
    without rows has no faults and an empty audit. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first, out = hashlib.sha256(), True, []
        columns = [c.split()[0] for c in _REPORT.split(", ")]
        types = [pa.int64()] * 7 + [pa.string()] * 2
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=columns)
        for conv, r, turns in _streamed(batches):
            if turns is not None:
                for role, text in turns:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
                continue
            out.append((conv, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, "".join(r.audit), digest.hexdigest()))
            digest, first = hashlib.sha256(), True
            if len(out) >= 1024:
                yield pack()
                out = []
        if out:
            yield pack()

    return _in_order(rows, rows if conversations is None else conversations).mapInArrow(run, _REPORT)
