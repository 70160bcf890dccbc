"""Conversation structure repair: the cheapest edits that make turns alternate, by a Viterbi search that emits as it goes.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. Each row is kept, given
another role or deleted, and turns with empty text may be inserted anywhere. The states are what came last: nothing, system, user or assistant
(``NOTHING`` to ``ASSISTANT``). After each row every state has one survivor, the cheapest way to it and among equally cheap ones that
of the least audit (the initials of its edits). Two audits that have taken the same rows never begin with one another, as both end with
the edit of a row, so their order stays whatever follows. A tie is thus decided by the complete suffixes of both ways since their last
common edit, and the order among survivors is kept as a rank, so that no suffix is read twice.

Ways are a tree of backpointers that counts who refers to an edit. An edit that no survivor builds on goes. Once all survivors
share an ancestor, the edits up to it are final and are emitted with their rows; only rows after it are held. A survivor goes too if another
is at least as good however the conversation goes on (``BEHIND``), else the way that deletes everything would never end.

Rows come as a stream, sorted by conversation and turn: a conversation of any length, with any share of all rows, passes through a
task in bounded memory as long as its ways meet; its audit and digest need its rows in order, in one place. Where a role and text were seen first
comes from counts combined before they are joined, so no conversation's texts are kept to be looked up.

Results: turns are ordered by number, null first, then by role and text; null role or text is one space. Rows of a null conv_id are
one conversation. Repeated rows are duplicates. A conversation whose rows are all absent has an empty result, an empty table too.
Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What edits cost, and white space and ends of sentences.
KEEP, RENAME, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
SPACE, STOPS = " \t\n\x0b\f\r", (".", "!", "?")

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NOTHING, ASSISTANT)
_NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: BEHIND[p][q]: how much more than from p the rest can cost from q at most, since q can follow the plan of p after that.
BEHIND = (
    (0, 6, 7, 4),
    (0, 0, 3, 0),
    (3, 3, 0, 3),
    (0, 6, 3, 0),
)


def wanted(state: int) -> str:
    """The role that may follow a state, but for a first system turn."""
    return "assistant" if state == USER else "user"


def inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = _NEXT[state, wanted(state)[0]]
    return state


def _ways(initial: str, must_go: bool, unfinished: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) over one row and the insertions before it: the best for each pair of states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in range(4):
        for times in range(3):
            at = inserted(state, times)
            edits = [("D", DELETE, at)]
            if not must_go:
                more = UNFINISHED if unfinished else 0
                edits.append(("R", RENAME + more, inserted(at, 1)))
                if (at, initial) in _NEXT:
                    edits.append(("K", KEEP + more, _NEXT[at, initial]))
            for letter, cost, to in edits:
                found = (times * INSERT + cost, "I" * times + letter)
                best[state, to] = min(found, best.get((state, to), found))
    return [(state, to, *found) for (state, to), found in best.items()]


class Edit:
    """A node of the tree: the edit of one row on one way, and the edits that go on from it."""

    __slots__ = ("before", "audit", "after")

    def __init__(self, before: Edit | None, audit: str) -> None:
        self.before, self.audit, self.after = before, audit, set()


class Repairer:
    """One conversation's rows in, final edits out: ``emit(edit letter, role, text)`` for each turn that is settled."""

    _table: dict[tuple, list] = {}

    def __init__(self, emit: Callable[[str, str, str], None]) -> None:
        self._emit = emit
        self._root = Edit(None, "")
        #: State: (cost, rank of the audit, last edit).
        self._ways = {NOTHING: (0, 0, self._root)}
        self._held: deque[tuple[str, str]] = deque()
        self._state = NOTHING
        self.cost = 0
        self.most_held = 0

    def add(self, role: str, text: str, must_go: bool, unfinished: bool) -> None:
        kind = (role[:1], must_go, unfinished)
        if kind not in self._table:
            if len(self._table) > 1000:
                self._table.clear()
            self._table[kind] = _ways(*kind)
        best: dict[int, tuple] = {}
        for state, to, cost, audit in self._table[kind]:
            if state in self._ways:
                so_far, rank, edit = self._ways[state]
                found = (so_far + cost, rank, audit, edit)
                if to not in best or found[:3] < best[to][:3]:
                    best[to] = found
        order = sorted(best, key=lambda s: best[s][1:3])
        ranks = {state: rank for rank, state in enumerate(order)}
        before = self._ways
        self._ways = {}
        for state, (cost, _, audit, edit) in best.items():
            if not any(self._beaten(best, ranks, state, other) for other in best):
                now = Edit(edit, audit)
                edit.after.add(now)
                self._ways[state] = (cost, ranks[state], now)
        for _, _, edit in before.values():
            self._release(edit)
        self._held.append((role, text))
        self.most_held = max(self.most_held, len(self._held))
        self._settle()

    @staticmethod
    def _beaten(best: dict, ranks: dict, state: int, other: int) -> bool:
        behind = best[state][0] - best[other][0] - BEHIND[state][other]
        return state != other and (behind > 0 or behind == 0 and ranks[other] < ranks[state])

    def _release(self, edit: Edit) -> None:
        while edit is not self._root and not edit.after:
            edit.before.after.discard(edit)
            edit = edit.before

    def _settle(self) -> None:
        """Emit from the root as long as all survivors come from one edit."""
        while len(self._root.after) == 1:
            self._root = self._root.after.pop()
            self._root.before = None
            self._out(self._root.audit)
            if any(edit is self._root for _, _, edit in self._ways.values()):
                return

    def _out(self, audit: str) -> None:
        for letter in audit:
            if letter == "I":
                self._emit("I", wanted(self._state), "")
                self._state = inserted(self._state, 1)
                continue
            role, text = self._held.popleft()
            if letter == "K":
                self._state = _NEXT[self._state, role[:1]]
            elif letter == "R":
                role, self._state = wanted(self._state), inserted(self._state, 1)
            self._emit(letter, role, text)

    def finish(self) -> None:
        """Choose among complete audits, insertions at the end included, and emit what is left."""
        ends = []
        for state, (cost, _, edit) in self._ways.items():
            path = []
            while edit is not self._root:
                path.append(edit.audit)
                edit = edit.before
            for times in range(3):
                if inserted(state, times) in FINAL:
                    ends.append((cost + times * INSERT, "".join(reversed(path)) + "I" * times))
        self.cost, audit = min(ends)
        self._out(audit)


class Conversation:
    """Figures of one conversation, row by row in order."""

    def __init__(self, keep: list | None) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self._turn = self._said = None
        self._audit: list[str] = []
        self._digest, self._written, self._keep = hashlib.sha256(), 0, keep
        self.repairer = Repairer(self._edit)

    def _edit(self, letter: str, role: str, text: str) -> None:
        self._audit.append(letter)
        if letter != "D":
            self._digest.update(("\n" * bool(self._written) + f"{role}:{text}").encode())
            if self._keep is not None:
                self._keep.append((self._written, letter, role, text))
            self._written += 1

    def add(self, turn: int | None, role: str, text: str, later: bool, repeated: bool, bare: bool, stopped: bool) -> None:
        same = self.rows and turn == self._turn and (role, text) == self._said
        if turn is not None and turn != self.most:
            self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.rows:
            self.illegal += self._said[0][:1] + role[:1] not in ("su", "ua", "au")
        copy = not bare and (later or bool(repeated and same))
        cut = not bare and not copy and not stopped
        self.blank += bare
        self.duplicate += copy
        self.truncated += cut
        self._turn, self._said = turn, (role, text)
        self.rows += 1
        self.repairer.add(role, text, bare or copy, cut)

    def figures(self) -> tuple:
        self.repairer.finish()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.repairer.cost, "".join(self._audit),
                self._digest.hexdigest())


def damaged(df: DataFrame) -> DataFrame:
    """Rows with known faults, by a checksum of ``conv_id:turn``: dropped (``absent``), emptied, without stops, repeated, by the user."""
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(place) % 20
    role, text = _filled("role"), _filled("text")
    return df.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, "".join(STOPS), "")).otherwise(text).alias("text"),
        (fault == 0).alias("absent"),
        F.explode(F.array_repeat(F.lit(True), F.when(fault == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _filled(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _marked(df: DataFrame) -> DataFrame:
    """Present and absent rows in order within each task, with what the search must know about their texts."""
    absent = F.col("absent") if "absent" in df.columns else F.lit(False)
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"),
                     absent.alias("absent"))
    said = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"),
                             F.concat("role", "text")))
    rows = rows.withColumns({
        "said": said, "place": F.struct(F.col("turn").isNotNull(), "turn"), "bare": core == "",
        "stopped": F.right(core, F.lit(1)).isin(*STOPS)})
    # Of what a conversation says more than once, where it comes first: combined before the exchange, and few.
    present = rows.where(~F.col("absent"))
    first = present.groupBy("said").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    found = rows.join(first.select("said", "first"), "said", "left").select(
        "conv_id", "turn", "role", "text", "absent", F.coalesce(F.col("first") < F.col("place"), F.lit(False)).alias("later"),
        F.col("first").isNotNull().alias("repeated"), "bare", "stopped")
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], keep: bool):
    """(conv_id, conversation, whether it is over, turns settled since) along a sorted stream."""
    now, conversation, turns = None, None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in batch.schema.names]
        for conv_id, turn, role, text, absent, *marks in zip(*columns):
            if conversation is None or conv_id != now:
                if conversation is not None:
                    yield now, conversation, True, turns
                now, turns = conv_id, [] if keep else None
                conversation = Conversation(turns)
            if not absent:
                conversation.add(turn, role, text, *marks)
        if conversation is not None:
            yield now, conversation, False, turns
    if conversation is not None:
        yield now, conversation, True, turns


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_BATCH = 1000


def repair_report(df: DataFrame) -> DataFrame:
    """Per conversation: turn numbers missing, first faults of its rows, illegal neighbours, and ``cost``, ``audit`` and
    ``repaired_sha256`` of its cheapest repair. A column ``absent`` marks rows that are gone."""
    marked = _marked(df)
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches):
        source, rows = None, []

        def out():
            ids, figures = pa.array([r[0] for r in rows], source), list(zip(*(r[1] for r in rows)))
            texts = [pa.array(c, pa.string()) for c in figures[6:]]
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in figures[:6]), *texts],
                                              ["conv_id", *_FIGURES, "audit", "repaired_sha256"])

        def typed():
            nonlocal source
            for batch in batches:
                source = batch.schema.field("conv_id").type
                yield batch

        for conv_id, conversation, over, _ in _conversations(typed(), False):
            if over:
                rows.append((conv_id, conversation.figures()))
                if len(rows) == _BATCH:
                    yield out()
                    rows = []
        if rows:
            yield out()

    return marked.mapInArrow(
        run, f"conv_id {kind}, {', '.join(f'{c} long' for c in _FIGURES)}, audit string, repaired_sha256 string")


def repaired_turns(df: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``position`` from 0, ``edit`` (K, R or I), ``role`` and ``text``."""
    marked = _marked(df)
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches):
        source = None

        def typed():
            nonlocal source
            for batch in batches:
                source = batch.schema.field("conv_id").type
                yield batch

        for conv_id, conversation, over, turns in _conversations(typed(), True):
            if over:
                conversation.figures()
            if turns:
                columns = list(zip(*turns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv_id] * len(turns), source), pa.array(columns[0], pa.int64()),
                     *(pa.array(c, pa.string()) for c in columns[1:])], ["conv_id", "position", "edit", "role", "text"])
                turns.clear()

    return marked.mapInArrow(run, f"conv_id {kind}, position long, edit string, role string, text string")
