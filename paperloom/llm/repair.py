"""Repair of the structure of conversations by a forward Viterbi search over a role grammar.

A repaired conversation has role initials ``(s?(ua)+)?``. Its grammar has four states:
nothing yet, after s, after u, after a. The rows of a conversation come in order, and each
is kept, given another role, or deleted; turns of empty text may be inserted anywhere. Each
state carries the cheapest (cost, audit) that leads to it, and after each row the layer is
closed by insertions, two at most, as more never lead anywhere cheaper. Costs follow from
the audit's letters, so one of two audits of equal cost at one state is never the start of
the other, and the least audit stays the least whatever follows.

Rows are sorted by conversation inside Spark and pass through a task one by one. Of a
conversation a task holds the four audits from where they differ, and the rows of that part
alone; what all four agree on is final and leaves. So a very long conversation is one task's
work, in order, as the hash of its whole text asks for anyway, but never in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The grammar's states by name; START and A may end a conversation.
START, S, U, A = range(4)
#: Which state each initial leads to.
MOVES = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
ROLES = {U: "user", A: "assistant"}
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\v\f\r"
#: Letters of audits that are held before those that all states agree on leave.
SETTLE = 64
#: Rows of output that are sent together.
ROWS = 1000


class Repair:
    """One conversation, row by row. ``take`` and ``close`` give the repaired turns that are final: (edit, role, text); a deleted row's too."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns = self.first = self.last = None
        self.before = self.initial = None
        self.audit: list[str] = []
        self.at = START
        self.held: list[tuple[str, str]] = []
        self.layer: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self._insert()

    def _insert(self) -> None:
        for here, then in ((START, U), (S, U), (U, A), (A, U)):
            if self.layer[here] is not None:
                cost, audit = self.layer[here]
                self._offer(self.layer, then, cost + INSERT, audit + "I")
        # Whatever follows START or S can follow A, with a kept system row deleted: beyond that they can't win, and leave.
        most = self.layer[A][0]
        for state, more in ((START, DELETE), (S, 0)):
            if self.layer[state] is not None and self.layer[state][0] > most + more:
                self.layer[state] = None

    @staticmethod
    def _offer(layer: list, state: int, cost: int, audit: str) -> None:
        if layer[state] is None or (cost, audit) < layer[state]:
            layer[state] = (cost, audit)

    def take(self, turn: int | None, role: str, text: str, later: bool) -> list[tuple[str, str, str]]:
        """``later``: its role and text were there at an earlier turn."""
        if turn is not None and turn != self.last:
            self.turns = (self.turns or 0) + 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        stripped = text.strip(SPACE)
        again = later or self.before == (turn, role, text)
        self.before, self.initial = (turn, role, text), initial
        gone, more = False, 0
        if not stripped:
            self.blank += 1
            gone = True
        elif again:
            self.duplicate += 1
            gone = True
        elif stripped[-1] not in ".!?":
            self.truncated += 1
            more = TRUNCATED
        self.held.append((role, text))
        layer: list = [None] * 4
        for state, best in enumerate(self.layer):
            if best is None:
                continue
            cost, audit = best
            self._offer(layer, state, cost + DELETE, audit + "D")
            if gone:
                continue
            if initial in MOVES[state]:
                self._offer(layer, MOVES[state][initial], cost + more, audit + "K")
            for then in MOVES[state].values():
                if then in ROLES:
                    self._offer(layer, then, cost + RETITLE + more, audit + "R")
        self.layer = layer
        self._insert()
        return self._settle(commonprefix([x[1] for x in layer if x])) if max(len(x[1]) for x in self.layer if x) > SETTLE else []

    def _settle(self, edits: str) -> list[tuple[str, str, str]]:
        self.layer = [x and (x[0], x[1][len(edits) :]) for x in self.layer]
        self.audit.append(edits)
        out, row = [], 0
        for edit in edits:
            role, text = "", ""
            if edit != "I":
                role, text = self.held[row]
                row += 1
            if edit == "K":
                self.at = MOVES[self.at][role[:1]]
            elif edit != "D":
                self.at = next(s for s in MOVES[self.at].values() if s in ROLES)
                role = ROLES[self.at]
            out.append((edit, role, text))
        del self.held[:row]
        return out

    def close(self) -> tuple[int, list[tuple[str, str, str]]]:
        """The cost of the whole and the last turns."""
        cost, audit = min(x for x in (self.layer[START], self.layer[A]) if x is not None)
        return cost, self._settle(audit)

    @property
    def gaps(self) -> int:
        return 0 if self.turns is None else self.last - self.first + 1 - self.turns


def ordered_turns(turns: DataFrame, missing: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, copies, later), sorted by conversation, in partitions that hold conversations whole.

    ``missing`` names a boolean column: such rows only say that their conversation exists.
    ``copies`` may be a column of ``turns``: the row is there so many times.
    """
    here = ~F.coalesce(F.col(missing), F.lit(False)) if missing else F.lit(True)
    copies = F.when(here, F.col("copies") if "copies" in turns.columns else F.lit(1)).otherwise(0).cast("int")
    blank = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), copies.alias("copies"))
    # 128 bits for conversation, role and text.
    one = [F.col("conv_id").isNull(), "conv_id", "role", "text"]
    rows = rows.withColumns({"d1": F.xxhash64(*one), "d2": F.xxhash64(F.lit(11), F.reverse("text"), *one)})
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.filter("copies > 0").groupBy("d1", "d2").agg(F.sum("copies").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    again = broadcast_if_small(stored(again.filter("first <> last").select("d1", "d2", "first"), "again"))
    later = F.coalesce(place > F.col("first"), F.lit(False))
    marked = rows.join(again, ["d1", "d2"], "left").select("conv_id", "turn", "role", "text", "copies", later.alias("later"))
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its repair, final turns, cost): cost is None but for the last of a conversation."""
    now, repair = None, None
    for batch in batches:
        for conv, turn, role, text, copies, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "later")), strict=True):
            if repair is None or conv != now:
                if repair is not None:
                    cost, out = repair.close()
                    yield now, repair, out, cost
                now, repair = conv, Repair()
            for _ in range(copies):
                if out := repair.take(turn, role, text, later):
                    yield conv, repair, out, None
    if repair is not None:
        cost, out = repair.close()
        yield now, repair, out, cost


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def repair_conversations(turns: DataFrame, missing: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row per conversation.

    Rows go by turn, null first, then role and text. A row's fault is the first of: blank (no
    character but space and tab to carriage return), duplicate (role and text were there
    before), truncated (the last such character is none of ``.!?``). ``illegal`` counts
    neighbours whose role initials aren't su, ua or au; ``gaps`` the turn numbers that are
    missing between the least and the largest. Keeping a row costs 0 (K), another role of
    user or assistant 3 (R), deleting it 4 (D; blank and duplicate rows must go), inserting
    an empty user or assistant turn 3 (I); a truncated row that stays adds 3. ``audit`` has
    the letters of the cheapest edits, the least by ASCII among equals. The digest is of
    the lines ``role:text`` of the repaired turns.

    Null roles and texts are one space, so null texts are blank; roles other than
    system, user and assistant count by their first letter. A null conv_id is a conversation
    of its own. An empty role has no place in the grammar. A conversation all of whose rows are ``missing`` has zeros, an empty
    audit and the digest of nothing. Rows with ``copies`` > 1 repeat at once. An empty table
    gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, digest, begun = [], sha256(), False
        names = ["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

        for conv, repair, out, cost in _walked(batches):
            for edit, role, text in out:
                if edit != "D":
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
            if cost is not None:
                rows.append((conv, *(getattr(repair, k) for k in _COUNTS), cost, "".join(repair.audit), digest.hexdigest()))
                digest, begun = sha256(), False
                if len(rows) >= ROWS:
                    yield sent()
                    rows = []
        yield sent()

    schema = f"conv_id long, {', '.join(f'{k} long' for k in _COUNTS)}, cost long, audit string, repaired_sha256 string"
    return ordered_turns(turns, missing).mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, missing: str | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the edits of ``repair_conversations`` one by one, deleted rows included; place counts from 0.

    Without the rows of edit D these are the repaired conversations. Edge cases are as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, place = [], 0
        kinds = {"conv_id": pa.int64(), "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

        for conv, _, out, cost in _walked(batches):
            for edit in out:
                rows.append((conv, place, *edit))
                place += 1
            if len(rows) >= ROWS:
                yield sent()
                rows = []
            if cost is not None:
                place = 0
        yield sent()

    return ordered_turns(turns, missing).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` as (conv_id, turn, role, text, copies, dropped) with faults by the CRC-32 of ``conv_id:turn`` (null: a space) modulo 20.

    0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it a user's.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
        (fault == 0).alias("dropped"),
    )
