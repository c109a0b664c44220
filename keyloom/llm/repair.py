"""Repair of conversation structure by a Viterbi search over edits, with survivors that coalesce.

The rows of a conversation pass once, in order. After each row there is one survivor for each state of the grammar: the cheapest edits
that lead there, ties to the least string of initials. Survivors are leaves of a backpointer tree whose nodes count their references: a
branch that no survivor needs is dropped with its texts, and edits that all survivors share are emitted at once. Two survivors of equal
cost are compared where their branches part, so a tie is decided by the whole unresolved suffixes, however long. Chains of the tree are
one node, so a comparison looks at a few nodes only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, in_slices

USER, ASSISTANT = "user", "assistant"
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. The first and the last may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: How much a state may cost beyond that after an assistant before nothing that follows can make up for it.
HOPELESS = {START: DELETE, AFTER_S: 0}
LEGAL = {"su", "ua", "au"}


class Node:
    """A chain of edits, each (initial, role, text, fault), below a parent."""

    __slots__ = ("edits", "kids", "parent", "survivors")

    def __init__(self, parent: Node | None, edits: list[tuple]):
        self.parent, self.edits, self.kids, self.survivors = parent, deque(edits), [], 0
        if parent is not None:
            parent.kids.append(self)


def _path(node: Node) -> list[Node]:
    path = []
    while node is not None:
        path.append(node)
        node = node.parent
    return path[::-1]


def _before(one: tuple, other: tuple) -> bool:
    """Whether candidate (cost, node, edits) is cheaper, or as cheap with the lesser initials."""
    if one[0] != other[0]:
        return one[0] < other[0]
    a, b = _path(one[1]), _path(other[1])
    same = 0
    while same < min(len(a), len(b)) and a[same] is b[same]:
        same += 1
    left = chain(chain.from_iterable(n.edits for n in a[same:]), one[2])
    right = chain(chain.from_iterable(n.edits for n in b[same:]), other[2])
    for x, y in zip(left, right):
        if x[0] != y[0]:
            return x[0] < y[0]
    return False


class Search:
    """The cheapest edits of one conversation; ``emit`` gets each edit, in order, as soon as it is certain."""

    def __init__(self, emit: Callable[[tuple], None]):
        self.emit, self.root, self.held = emit, Node(None, []), 0
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.root.survivors = 1
        self._settle(self._inserted({START: (0, self.root, ())}))

    def _inserted(self, found: dict[int, tuple]) -> dict[int, tuple]:
        """Candidates after the turns that may be put in here."""
        for state, before, role in ((AFTER_U, (START, AFTER_S, AFTER_A), USER), (AFTER_A, (AFTER_U,), ASSISTANT)):
            for b in before:
                if b in found:
                    cost, node, edits = found[b]
                    self._offer(found, state, (cost + INSERT, node, (*edits, ("I", role, "", ""))))
        return found

    @staticmethod
    def _offer(found: dict[int, tuple], state: int, candidate: tuple) -> None:
        if state not in found or _before(candidate, found[state]):
            found[state] = candidate

    def row(self, role: str, text: str, fault: str) -> None:
        found: dict[int, tuple] = {}
        extra = TRUNCATED if fault == "truncated" else 0
        initial, must_go = role[:1], fault in ("blank", "duplicate")
        for state, (cost, node) in self.best.items():
            self._offer(found, state, (cost + DELETE, node, (("D", role, text, fault),)))
            if must_go:
                continue
            if state == START and initial == "s":
                self._offer(found, AFTER_S, (cost + extra, node, (("K", role, text, fault),)))
            to, wanted = (AFTER_A, ASSISTANT) if state == AFTER_U else (AFTER_U, USER)
            edit = ("K", role, text, fault) if initial == wanted[0] else ("R", wanted, text, fault)
            self._offer(found, to, (cost + extra + (REROLE if edit[0] == "R" else 0), node, (edit,)))
        self._settle(self._inserted(found))

    def _settle(self, found: dict[int, tuple]) -> None:
        """Make the candidates the survivors, drop what none of them needs, emit what all of them share."""
        if AFTER_A in found:
            for state, most in HOPELESS.items():
                if state in found and found[state][0] > found[AFTER_A][0] + most:
                    del found[state]
        old = [node for _, node in self.best.values()]
        made, now = {}, {}
        for state, (cost, node, edits) in found.items():
            for edit in edits:  # survivors that go on alike share the node
                key = (id(node), edit[0])
                if key not in made:
                    made[key] = Node(node, [edit])
                node = made[key]
            now[state] = (cost, node)
            node.survivors += 1
        self.best = now
        for node in old:
            node.survivors -= 1
        for node in [*old, *made.values()]:
            self._tidy(node)
        while len(self.root.kids) == 1 and not self.root.survivors:
            self.root = self.root.kids[0]
            self.root.parent = None
            while self.root.edits:
                self.emit(self.root.edits.popleft())
        self.held = max(self.held, sum(len(n.edits) for n in self._nodes()))

    def _tidy(self, node: Node) -> None:
        while node.parent is not None and not node.survivors and len(node.kids) < 2:
            parent = node.parent
            if node not in parent.kids:
                return  # gone already
            if not node.kids:
                parent.kids.remove(node)
                node = parent
                continue
            kid = node.kids[0]
            if len(kid.edits) < len(node.edits):  # the shorter chain moves
                node.edits.extend(kid.edits)
                kid.edits = node.edits
            else:
                kid.edits.extendleft(reversed(node.edits))
            kid.parent = parent
            parent.kids[parent.kids.index(node)] = kid
            node.kids = []
            return

    def _nodes(self) -> Iterator[Node]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            todo += node.kids
            yield node

    def end(self) -> int:
        """Emit the rest and return the cost."""
        ends = {s: (c, n, ()) for s, (c, n) in self.best.items() if s in (START, AFTER_A)}
        best = ends.get(START) or ends[AFTER_A]
        if START in ends and AFTER_A in ends and _before(ends[AFTER_A], best):
            best = ends[AFTER_A]
        for edit in chain.from_iterable(n.edits for n in _path(best[1])):
            self.emit(edit)
        return best[0]


def fault_of(text: str, seen: bool) -> str:
    told = text.rstrip(SPACES)
    return "blank" if not told else "duplicate" if seen else "truncated" if told[-1] not in ".!?" else ""


class Report:
    """What is known of one conversation; subclasses say what becomes of its edits."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.illegal, self.last_role = conv_id, {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, 0, None
        self.least = self.most = None
        self.turns, self.search = 0, Search(self.edit)

    def edit(self, edit: tuple) -> None:
        raise NotImplementedError

    def ready(self) -> list[dict]:
        """Rows of the result that are certain before the conversation ends."""
        return []

    def results(self) -> Iterator[dict]:
        raise NotImplementedError

    def row(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.last_role is not None and self.last_role[:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.last_role = role
        fault = fault_of(text, seen)
        self.counts[fault] += 1
        self.search.row(role, text, fault)

    def summary(self, cost: int) -> dict:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.counts["blank"], "duplicate": self.counts["duplicate"],
                "truncated": self.counts["truncated"], "illegal": self.illegal, "cost": cost}


def over_conversations(turns: DataFrame, report: type[Report], schema: str) -> DataFrame:
    """``report`` of each conversation of ``turns`` (conv_id, turn, role, text, copies).

    Where a role and text are first met is found by an aggregate of hashes, and comes along as a mark before the row, so that no task
    remembers what a conversation has said. The texts are shuffled once; a conversation passes one task row by row and is never held.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies").withColumn(
        "said", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    present = rows.filter("copies > 0")
    first = present.groupBy("conv_id", "role", "said").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("at"))
    nothing = F.lit(None).cast("string")
    marks = first.select("conv_id", F.lit(1).alias("kind"), F.col("at.turn").alias("turn"), "role", nothing.alias("text"), "said", F.lit(1).alias("copies"))
    conversations = rows.select("conv_id").distinct().select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"), F.lit(None).cast("binary").alias("said"),
        F.lit(1).alias("copies"))
    told = present.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "text", "said", "copies")
    dealt = conversations.union(marks).union(told).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("kind") != 0, F.col("turn").asc_nulls_first(), "role", "said", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, mark = None, [], None
        for batch in batches:
            for part in in_slices(iter([batch])):
                for conv_id, kind, turn, role, text, said, copies in zip(*(c.to_pylist() for c in part.columns)):
                    if kind == 0:
                        if held is not None:
                            kept += held.results()
                        held, mark = report(conv_id), None
                    elif kind == 1:
                        mark = (turn, role, said)
                    else:
                        for _ in range(copies):
                            held.row(turn, role, text, mark != (turn, role, said))
                            mark = None
                            kept += held.ready()
                    if len(kept) >= 500:
                        yield pa.RecordBatch.from_pylist(kept, schema=arrow)
                        kept = []
        if held is not None:
            kept += held.results()
        if kept:
            yield pa.RecordBatch.from_pylist(kept, schema=arrow)

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in schema.split(", "))])
    return dealt.mapInArrow(run, schema)


class EditRows(Report):
    """One row for each edit."""

    def __init__(self, conv_id):
        self.out, self.place = [], 0
        super().__init__(conv_id)

    def edit(self, edit: tuple) -> None:
        self.place += 1
        initial, role, text, fault = edit
        self.out.append({"conv_id": self.conv_id, "place": self.place, "edit": initial, "role": role, "text": text, "fault": fault})

    def ready(self) -> list[dict]:
        out, self.out = self.out, []
        return out

    def results(self) -> Iterator[dict]:
        self.search.end()
        yield from self.ready()


def repair(conversations: DataFrame) -> DataFrame:
    """The cheapest edits that give each conversation the roles ``(s?(ua)+)?`` (initials; system, user, assistant): a row for each edit with conv_id,
    place (from 1), edit (K keep, R rerole, D delete, I insert), role, text (after the edit; of a deleted row what it was) and fault (blank,
    duplicate, truncated or empty). Keeping costs 0, reroling 2, inserting an empty turn 2, deleting 3, and a truncated row that stays 1; blank
    rows and those whose role and text came before must go. Among edits of equal cost the least string of initials counts.

    Rows are taken by turn, null turns first, those of a turn by role and then by a hash of the text. A null role or text counts as one
    space. Rows without a conv_id are one conversation. Repeated rows are rows, each after the first a duplicate. Texts of any length are
    read whole. Other columns are not read. A conversation of which no row may stay has deletions only; an empty table gives an empty result.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(1).alias("copies"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return over_conversations(turns.withColumn("conv_id", F.col("conv_id").cast("long")) if kind == "int" else turns, EditRows,
                              f"conv_id {'string' if kind == 'string' else 'long'}, place long, edit string, role string, text string, fault string")
