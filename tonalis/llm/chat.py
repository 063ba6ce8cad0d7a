"""Repairing the roles of conversations at least cost, and rendering them.

A legal conversation is one optional system turn, then user and assistant turns
in alternation, the user first.  Dynamic programming over that automaton decides
for every turn whether it is kept, relabelled, or merged into the turn before,
and where empty turns are inserted, at the least total cost.

The programme's steps are (min, +) products of small matrices, which are
associative.  A conversation of any length is cut into blocks of at most
``BLOCK`` turns, each block's matrix is computed where the block lies, and the
product of a conversation's blocks in one partition is its matrix there.  The
driver joins the matrices of conversations that go beyond a partition, at most
two a partition; the states between blocks within a partition are found by a task
for each such conversation and partition; and each block is then traced back alone
between its known first and last states.  No conversation is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, rows, saved

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START = 0
INFINITE = float("inf")
#: Turns that are held together.
BLOCK = 4096
#: Code points of a text by which turns of one number are ordered before its hash is.
TIE = 64
#: Names that other tools give the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}


@dataclass(frozen=True)
class Costs:
    """What repairs cost, and the roles that a conversation may end with."""

    merge: float = 1.0
    relabel: float = 2.0
    insert: float = 3.0
    ends: tuple[str, ...] = ("user", "assistant")


def follows(state: int, role: int) -> bool:
    """Whether a turn of ``role`` (1 to 3) may follow ``state``."""
    return (state, role) in {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}


def role_number(role: str | None) -> int:
    """1 to 3, or 0 for a role that is none of the known."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def _moves(costs: Costs) -> list[list[list[tuple[int, float, str, tuple[int, ...]]]]]:
    """For each role (0: unknown) and state: (next state, cost, action, inserted roles), cheapest for each next state."""
    out = []
    for given in range(4):
        by_state = []
        for state in range(4):
            best: dict[int, tuple[int, float, str, tuple[int, ...]]] = {}
            for role in (1, 2, 3):
                change = 0.0 if role == given else costs.relabel
                name = "kept" if role == given else "relabelled"
                options = []
                if state == role:
                    options.append((role, change + costs.merge, "merged", ()))
                if follows(state, role):
                    options.append((role, change, name, ()))
                options += [(role, change + costs.insert, name, (x,)) for x in (1, 2, 3) if follows(state, x) and follows(x, role)]
                options += [(role, change + 2 * costs.insert, name, (x, y)) for x in (1, 2, 3) for y in (1, 2, 3) if follows(state, x) and follows(x, y) and follows(y, role)]
                if options:
                    best[role] = min(options, key=lambda o: (o[1], o[2], o[3]))
            by_state.append(list(best.values()))
        out.append(by_state)
    return out


def block_matrix(roles: list[int], costs: Costs) -> list[float]:
    """Least cost from each state before the block to each after it, 16 values by rows."""
    moves = _moves(costs)
    out = []
    for start in range(4):
        now = {start: 0.0}
        for r in roles:
            then: dict[int, float] = {}
            for s, c in now.items():
                for t, cost, _, _ in moves[r][s]:
                    if c + cost < then.get(t, INFINITE):
                        then[t] = c + cost
            now = then
        out += [now.get(s, INFINITE) for s in range(4)]
    return out


def trace(roles: list[int], start: int, end: int | None, costs: Costs) -> list[tuple[int, str, tuple[int, ...]]]:
    """(role, action, roles inserted before) of each turn on a cheapest way from ``start`` to ``end`` (None: to a legal end)."""
    moves = _moves(costs)
    now: dict[int, float] = {start: 0.0}
    back: list[dict[int, tuple[int, str, tuple[int, ...]]]] = []
    for r in roles:
        then, how = {}, {}
        for s, c in sorted(now.items()):
            for t, cost, action, inserted in moves[r][s]:
                if c + cost < then.get(t, INFINITE):
                    then[t], how[t] = c + cost, (s, action, inserted)
        now = then
        back.append(how)
    at = end if end is not None else legal_end(now, costs)
    out = []
    for how in reversed(back):
        before, action, inserted = how[at]
        out.append((at, action, inserted))
        at = before
    return out[::-1]


def closing(state: int, costs: Costs) -> tuple[int, ...] | None:
    """The fewest empty turns that lead from ``state`` to a legal end; None where none do."""
    legal = {ROLES.index(r) + 1 for r in costs.ends}
    ways: list[tuple[int, ...]] = [()]
    for _ in range(len(ROLES) + 1):
        for way in ways:
            if (way[-1] if way else state) in legal:
                return way
        ways = [(*way, x) for way in ways for x in (1, 2, 3) if follows(way[-1] if way else state, x)]
    return None


def legal_end(now: dict[int, float], costs: Costs) -> int:
    """The cheapest last state, the empty turns counted that it still needs to a legal end."""
    needs = {s: closing(s, costs) for s in sorted(now)}
    return min((s for s in needs if needs[s] is not None), key=lambda s: now[s] + costs.insert * len(needs[s] or ()))


def product(a: list[float], b: list[float]) -> list[float]:
    """The (min, +) product of two 4 x 4 matrices."""
    return [min(a[4 * i + k] + b[4 * k + j] for k in range(4)) for i in range(4) for j in range(4)]


PIECES = "conv_id long, place long, turn long, role string, action string, piece string"
_BLOCKS = "conv_id long, turn long, role int, text string, part int, blk int, seq long, matrix array<double>, whole array<double>"
_STATES = "conv_id long, part int, blk int, before int, after int, final boolean"


def repair(df: DataFrame, costs: Costs = Costs(), head: str = "<|{role}|>\n", close: str = "<|end|>\n", partitions: int | None = None) -> DataFrame:
    """The repaired and rendered turns of conversations (``conv_id``, ``turn``, ``role``, ``text``).

    One row for each input row and each inserted empty turn; a conversation's
    pieces joined in the order of ``place`` are its rendering.  ``action`` is
    kept, relabelled, merged or inserted.  Turns are ordered by number, equal
    numbers by role, then by the first ``TIE`` code points of the text, then by a
    hash of all of it; nulls come first; null texts count as empty; unknown and
    null roles are relabelled; rows with a null ``conv_id`` form one conversation
    of that id.  Repeated rows are turns of their own.  An empty table gives no
    rows.  Other columns are ignored.

    Turns are dealt in order to ``partitions`` ranges (unset: as many as the
    session shuffles to).  The driver holds two matrices of 16 numbers a partition
    at most, so some 10^5 partitions are no burden.
    """
    if any(r not in ROLES for r in costs.ends) or not costs.ends:
        raise ValueError(f"ends are of {', '.join(ROLES)}")
    spark = df.sparkSession
    plain = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    tied = plain.select("*", F.substring("text", 1, TIE).alias("tie"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    key = ["conv_id", "turn", "role", "tie", "hash", "row"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, blk = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        whole: list[float] | None = None

        def block(last: bool) -> pa.RecordBatch:
            nonlocal seq, blk, whole
            matrix = block_matrix([h[2] for h in held], costs)
            whole = product(whole, matrix) if whole else matrix
            n = len(held)
            conv, turn, role, text = (list(x) for x in zip(*held, strict=True))
            none = [None] * (n - 1)
            out = rows(_BLOCKS, conv_id=conv, turn=turn, role=role, text=text, part=[part] * n, blk=[blk] * n, seq=range(seq, seq + n), matrix=[*none, matrix], whole=[*none, whole if last else None])
            held.clear()
            seq, blk = seq + n, 0 if last else blk + 1
            whole = None if last else whole
            return out

        for batch in batches:
            for conv, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if held and held[0][0] != conv:
                    yield block(True)
                elif len(held) == BLOCK:
                    yield block(False)
                held.append((conv, turn, role_number(role), text or ""))
        if held:
            yield block(True)

    dealt = tied.repartitionByRange(partitions, *key) if partitions else tied.repartitionByRange(*key)
    ordered = dealt.sortWithinPartitions(*key).select("conv_id", "turn", "role", "text")
    held = saved(map_batches(ordered, blocks, _BLOCKS), "chat-blocks")
    ends = held.where("whole IS NOT NULL").select("conv_id", "part", "whole")
    several = ends.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("long_id"))
    spans: dict[int | None, list[tuple[int, list[float]]]] = {}
    for r in ends.join(several, ends["conv_id"].eqNullSafe(F.col("long_id"))).select("conv_id", "part", "whole").collect():
        spans.setdefault(r["conv_id"], []).append((r["part"], r["whole"]))
    between = {(conv, part): state for conv, parts in spans.items() for part, *state in joined(sorted(parts), costs)}
    sent = spark.sparkContext.broadcast(between)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, found in zip(*(batch[c].to_pylist() for c in ("conv_id", "part", "found")), strict=True):
                start, end, _ = sent.value.get((conv, part), (START, None, True))
                steps = joined(sorted((f["blk"], f["matrix"]) for f in found), costs, start, end)
                blk, before, after, final = (list(x) for x in zip(*steps, strict=True))
                yield rows(_STATES, conv_id=[conv] * len(blk), part=[part] * len(blk), blk=blk, before=before, after=after, final=final)

    # one row for each conversation and partition, of as many matrices as the partition has blocks of it
    inner = held.where("matrix IS NOT NULL").groupBy("conv_id", "part").agg(F.collect_list(F.struct("blk", "matrix")).alias("found")).where(F.size("found") > 1)
    states = map_batches(inner, within, _STATES).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("blk").alias("b"), "before", "after", "final")
    known = held.drop("matrix", "whole").join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("blk") == F.col("b")), "left").drop("c", "p", "b")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []

        def pieces() -> pa.RecordBatch:
            conv, _, _, _, part, _, _, before, after, final = block[0]
            start, end, last = sent.value.get((conv, part), (START, None, True))
            if before is not None:  # one of several blocks here; only the final one may close the conversation
                start, end, last = before, after, last and final
            out: list[tuple] = []
            first = start == START
            steps = trace([b[2] for b in block], start, end, costs)
            role = start
            for (_, turn, _, text, _, _, seq, *_), (role, action, inserted) in zip(block, steps, strict=True):
                place = (part << 40) + seq * 8
                for k, x in enumerate(inserted):
                    out.append((conv, place + k, None, ROLES[x - 1], "inserted", ("" if first else close) + head.format(role=ROLES[x - 1])))
                    first = False
                if action == "merged":
                    piece = "\n" + text
                else:
                    piece = ("" if first else close) + head.format(role=ROLES[role - 1]) + text
                first = False
                out.append((conv, place + 3, turn, ROLES[role - 1], action, piece))
            if last:
                for k, x in enumerate(closing(role, costs) or ()):
                    out.append((conv, place + 4 + k, None, ROLES[x - 1], "inserted", close + head.format(role=ROLES[x - 1])))
                out[-1] = (*out[-1][:5], out[-1][5] + close)
            block.clear()
            c, p, t, r, a, s = (list(x) for x in zip(*out, strict=True))
            return rows(PIECES, conv_id=c, place=p, turn=t, role=r, action=a, piece=s)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "part", "blk", "seq", "before", "after", "final")), strict=True):
                if block and (block[0][0], block[0][4], block[0][5]) != (row[0], row[4], row[5]):
                    yield pieces()
                block.append(row)
        if block:
            yield pieces()

    return map_batches(known.repartition("conv_id", "part", "blk").sortWithinPartitions("conv_id", "part", "blk", "seq"), render, PIECES)


def joined(parts: list[tuple[int, list[float]]], costs: Costs, start: int = START, end: int | None = None) -> list[tuple[int, int, int, bool]]:
    """(part, state before, state after, whether it is the last) of each block in order, on a cheapest way from ``start`` to ``end`` (None: to a legal end)."""
    now, back = {start: 0.0}, []
    for _, matrix in parts:
        then, how = {}, {}
        for s, c in sorted(now.items()):
            for t in range(4):
                if c + matrix[4 * s + t] < then.get(t, INFINITE):
                    then[t], how[t] = c + matrix[4 * s + t], s
        now = then
        back.append(how)
    at = legal_end(now, costs) if end is None else end
    out = []
    for i in range(len(parts) - 1, -1, -1):
        before = back[i][at]
        out.append((parts[i][0], before, at, i == len(parts) - 1))
        at = before
    return out[::-1]


def conversations(pieces: DataFrame) -> DataFrame:
    """Whole renderings, ``conv_id`` and ``rendered``, for conversations that fit a row.

    ``pieces`` are those of ``repair``; an empty table gives no rows, and pieces
    of a null ``conv_id`` are one conversation.
    """
    ordered = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("rendered"))
