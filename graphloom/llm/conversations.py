"""Repair of conversation structure: the cheapest edits that make the roles alternate, found by Dijkstra's search.

A node of the search is (turns consumed, state of the grammar (s?(ua)+)?), never built but as it is reached. The
priority is (cost, audit), where the audit spells the edits; the first accepting end node taken from the queue holds
the cheapest edits and among them the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.scratch import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
#: A row's code is 4 * fault + role.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: States: nothing yet, after the system's turn, after the user's, after the assistant's. What each wants next, and where that leads.
WANTS, NEXT, ACCEPTS = (USER, USER, ASSISTANT, USER), (2, 2, 3, 2), (0, 3)
NAMES = {USER: "user", ASSISTANT: "assistant"}


class Audit:
    """A string that grows by a letter and shares all before it; two are compared in logarithmic time by jumping back to where they part.

    The grammar leaves one way to read a string of edits, so that each string is grown once and is its object.
    """

    __slots__ = ("before", "jump", "length", "letter")

    def __init__(self, before: Audit | None = None, letter: str = ""):
        self.letter = letter
        if before is None:
            self.before = self.jump = self
            self.length = 0
        else:
            self.before, self.length, far = before, before.length + 1, before.jump
            self.jump = far.jump if before.length - far.length == far.length - far.jump.length else before

    def __lt__(self, other: Audit) -> bool:
        a, b = self, other
        while a.length > b.length:
            a = a.jump if a.jump.length >= b.length else a.before
        while b.length > a.length:
            b = b.jump if b.jump.length >= a.length else b.before
        if a is b:  # one begins with the other
            return self.length < other.length
        while a.before is not b.before:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.before, b.before)
        return a.letter < b.letter

    def __str__(self) -> str:
        out, a = [], self
        while a.length:
            out.append(a.letter)
            a = a.before
        return "".join(reversed(out))


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a conversation of such rows."""
    n, done, queue = len(codes), bytearray(4 * (len(codes) + 1)), [(0, Audit(), 0, 0)]
    while True:
        cost, audit, i, state = heappop(queue)
        if done[4 * i + state]:
            continue
        done[4 * i + state] = 1
        if i == n and state in ACCEPTS:
            return cost, str(audit)
        heappush(queue, (cost + INSERT, Audit(audit, "I"), i, NEXT[state]))
        if i == n:
            continue
        heappush(queue, (cost + DELETE, Audit(audit, "D"), i + 1, state))
        fault, role = divmod(codes[i], 4)
        if fault in (BLANK, DUPLICATE):
            continue
        more = TRUNCATED if fault == CUT else 0
        if role == WANTS[state]:
            heappush(queue, (cost + KEEP + more, Audit(audit, "K"), i + 1, NEXT[state]))
        else:
            if role == SYSTEM and state == 0:
                heappush(queue, (cost + KEEP + more, Audit(audit, "K"), i + 1, 1))
            heappush(queue, (cost + REROLE + more, Audit(audit, "R"), i + 1, NEXT[state]))


@lru_cache(maxsize=4096)
def _known(codes: bytes) -> tuple[int, str]:
    """The same for short conversations, which are of few kinds."""
    return cheapest(codes)


def _illegal(codes: bytes) -> int:
    roles = [c % 4 for c in codes]
    return sum((a, b) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)) for a, b in zip(roles, roles[1:]))


def _rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    return base.withColumn("same", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))))


ORDER = ["turn", "role", "same"]  # nulls first


def find_edits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation of rows.

    Rows go by turn, nulls first, then by role and a 128-bit hash of role and text, by which rows are equal; a null
    role or text is one space. Texts don't leave the tasks that read them: a row becomes one byte, its
    role and first fault, which is all that the search needs; a conversation's bytes meet in one task.
    A null conversation id is a conversation of its own. No rows give no rows; other columns are not looked at.
    """
    base = _rows(rows, conv_col, turn_col, role_col, text_col)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    role = F.element_at(F.create_map(*[F.lit(x) for p in (("s", SYSTEM), ("u", USER), ("a", ASSISTANT)) for x in p]), F.substring("role", 1, 1))
    narrow = base.select("conv", "turn", "role", "same", F.coalesce(role, F.lit(OTHER)).alias("initial"), (last == "").alias("empty"), last.isin(".", "!", "?").alias("ended"))
    met = narrow.repartition("conv").withColumn("again", F.row_number().over(Window.partitionBy("conv", "same").orderBy("turn")) > 1)
    fault = F.when(F.col("empty"), BLANK).when(F.col("again"), DUPLICATE).when(~F.col("ended"), CUT).otherwise(SOUND)
    coded = met.sortWithinPartitions("conv", *ORDER).select("conv", "turn", (fault * 4 + F.col("initial")).alias("code"))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, codes, low, high, turns, kind = object(), bytearray(), None, None, 0, None

        def judged() -> tuple:
            seq = bytes(codes)
            cost, audit = _known(seq) if len(seq) <= 64 else cheapest(seq)
            faults = [c // 4 for c in seq]
            return conv, high - low + 1 - turns if turns else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), _illegal(seq), cost, audit

        def table(done: list[tuple]) -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=["conv", *names, "audit"])

        for b in batches:
            kind, done = b.column(0).type, []
            for c, turn, code in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv:
                    if codes:
                        done.append(judged())
                    conv, codes, low, high, turns = c, bytearray(), None, None, 0
                codes.append(code)
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
            if done:
                yield table(done)
        if codes:
            yield table([judged()])

    return coded.mapInArrow(run, f"conv {dict(base.dtypes)['conv']}, {', '.join(f'{n} long' for n in names)}, audit string")


def repaired(rows: DataFrame, edits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, position, role, text) of the conversations after their edits, in order within partitions, positions from 0.

    A conversation's audit comes first in its partition and its rows stream past it, so that a task holds one
    batch and one audit, however long the conversation is.
    """
    base = _rows(rows, conv_col, turn_col, role_col, text_col)
    kind = dict(base.dtypes)["conv"]
    told = edits.select("conv", F.lit(None).cast("long"), F.lit(""), F.col("audit"), F.lit(None).cast("binary"), F.lit(0))
    both = base.withColumn("is_row", F.lit(1)).union(told)
    ordered = both.repartition("conv").sortWithinPartitions("conv", "is_row", *ORDER).select("conv", "is_row", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, position, pending = None, "", 0, 0, 0, False

        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])

            def emit(role: str, text: str) -> None:
                nonlocal position
                for x, y in zip(out, (conv, position, role, text), strict=True):
                    x.append(y)
                position += 1

            def inserts() -> None:
                nonlocal at, state
                while at < len(audit) and audit[at] == "I":
                    emit(NAMES[WANTS[state]], "")
                    at, state = at + 1, NEXT[state]

            for c, is_row, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not is_row:
                    conv, audit, at, state, position = c, text, 0, 0, 0
                    inserts()
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    emit(role if edit == "K" else NAMES[WANTS[state]], text)
                    state = 1 if edit == "K" and state == 0 and role[:1] == "s" else NEXT[state]
                inserts()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["conv", "position", "role", "text"])

    return ordered.mapInArrow(run, f"conv {kind}, position long, role string, text string")


def text_digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of `role:text` of repaired turns, joined by newlines; turns as repaired gives them."""
    kind = dict(turns.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h, of = None, None, None

        def table(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], of), pa.array([d[1] for d in done], pa.string())], names=["conv", "sha256"])

        for b in batches:
            of, done = b.column(0).type, []
            for c, position, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if position == 0:
                    if h is not None:
                        done.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if done:
                yield table(done)
        if h is not None:
            yield table([(conv, h.hexdigest())])

    return turns.mapInArrow(run, f"conv {kind}, sha256 string")


def repair_report(rows: DataFrame, conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """find_edits and the digest of what they give, for each of conversations(conv_col); one without rows has zeros, an empty audit and the digest of nothing."""
    cols = (conv_col, turn_col, role_col, text_col)
    edits = materialize(find_edits(rows, *cols), "edits")
    digests = text_digests(repaired(rows, edits, *cols))
    e, d, ids = edits.alias("e"), digests.alias("d"), conversations.select(conv_col).distinct().alias("i")
    both = ids.join(e, F.col(f"i.{conv_col}").eqNullSafe(F.col("e.conv")), "left").join(d, F.col(f"i.{conv_col}").eqNullSafe(F.col("d.conv")), "left")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select(F.col(f"i.{conv_col}").alias(conv_col), *[F.coalesce(F.col(f"e.{c}"), F.lit(0)).cast("long").alias(c) for c in longs], F.coalesce("e.audit", F.lit("")).alias("audit"), F.coalesce("d.sha256", F.lit(nothing)).alias("repaired_sha256"))
