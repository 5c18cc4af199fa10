"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation beginning with the user, ending with the assistant.  Each source
turn may keep its role, be relabelled, be merged into the turn before, or be
preceded by an inserted empty turn; dynamic programming over the automaton of
legal turns finds the cheapest repair, and the repaired turns are rendered.

A conversation of any length is cut into segments of bounded turns and bytes:
rows are sorted by range, so that one conversation may span many partitions, and
each segment is summed up by a small matrix of least costs between automaton
states.  Matrices, not texts, are chained in two levels: those of a partition
become one, and a conversation has as many of these as it spans partitions.  The
states between partitions give those between segments; then segments are
repaired and rendered on their own.

The result has a row for each source turn: rendered pieces in order of turns
make up the conversation.  Ties are broken by the order of actions: keep, merge,
relabel, insert.

Defined results: null and empty texts are empty turns; null or unknown roles
cost as much to relabel as any; turns with equal numbers are ordered by role and
text, repeated rows stay; rows with a null conversation are one conversation;
null turns come first; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs: merge, relabel, insert an empty turn (fixed values).
MERGE, RELABEL, INSERT = 2, 3, 4
#: Turns of a segment at most, and bytes of text from which on it ends.
SEGMENT, SEGMENT_BYTES = 512, 4 << 20
#: A rendered turn (fixed format).
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
_INF = 1 << 40
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _moves() -> dict[int, list[tuple[int, int, int, str, tuple[int, ...]]]]:
    """For each source role (3 for unknown): moves (from, to, cost, action, inserted states), in order of preference."""
    out = {}
    for role in range(4):
        found = []
        own = role + 1
        for s in range(4):
            for t in _NEXT[s]:
                found.append((s, t, 0 if t == own else RELABEL, "keep" if t == own else "relabel", ()))
                for u in _NEXT[t]:  # one empty turn before
                    found.append((s, u, INSERT + (0 if u == own else RELABEL), "insert" if u == own else "insert_relabel", (t,)))
            if s != START:
                found.append((s, s, MERGE + (0 if s == own else RELABEL), "merge" if s == own else "merge_relabel", ()))
        rank = ["keep", "merge", "relabel", "insert", "merge_relabel", "insert_relabel"]
        out[role] = sorted(found, key=lambda m: (m[2], rank.index(m[3])))
    return out


MOVES = _moves()
#: Cost of ending in a state: after a user or system turn empty turns follow.
ENDING = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}


def code(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else 3


def matrix(roles: list[int]) -> np.ndarray:
    """Least costs from each state to each state over a segment."""
    out = np.full((4, 4), _INF, np.int64)
    np.fill_diagonal(out, 0)
    for role in roles:
        step = np.full((4, 4), _INF, np.int64)
        for s, t, cost, _, _ in MOVES[role]:
            step[s, t] = min(step[s, t], cost)
        out = np.minimum((out[:, :, None] + step[None]).min(axis=1), _INF)
    return out


def product(mats: list[np.ndarray]) -> np.ndarray:
    """Least costs over segments in a row."""
    out = mats[0]
    for m in mats[1:]:
        out = np.minimum((out[:, :, None] + m[None]).min(axis=1), _INF)
    return out


def states(mats: list[np.ndarray], first: int = START, last: int | None = None) -> list[tuple[int, int]]:
    """The states before and after each segment of a cheapest path; without ``last`` to the cheapest ending."""
    forward = [np.where(np.arange(4) == first, 0, _INF)]
    for m in mats:
        forward.append((forward[-1][:, None] + m).min(axis=0))
    state = min(range(4), key=lambda s: (forward[-1][s] + ENDING[s], s)) if last is None else last
    out = []
    for k in range(len(mats) - 1, -1, -1):
        before = int(np.argmin(forward[k] + mats[k][:, state]))
        out.append((before, state))
        state = before
    return out[::-1]


def repair(roles: list[int], first: int = START, last: int | None = None) -> list[tuple]:
    """The moves of a cheapest path from state ``first`` to ``last``; without ``last`` to the cheapest ending."""
    costs, back = [_INF] * 4, []
    costs[first] = 0
    for role in roles:
        new, via = [_INF] * 4, [None] * 4
        for m in MOVES[role]:
            if costs[m[0]] + m[2] < new[m[1]]:
                new[m[1]], via[m[1]] = costs[m[0]] + m[2], m
        costs = new
        back.append(via)
    state = min(range(4), key=lambda s: (costs[s] + ENDING[s], s)) if last is None else last
    out = []
    for via in reversed(back):
        out.append(via[state])
        state = via[state][0]
    return out[::-1]


def render(moves: list[tuple], texts: list[str | None], first: int, final: bool) -> list[str]:
    """The rendered piece of every source turn; ``final`` closes the conversation."""
    out, empty = [], lambda s: OPEN.format(role=ROLES[s - 1]) + CLOSE
    for (s, t, _, action, inserted), text in zip(moves, texts, strict=True):
        if action.startswith("merge"):
            piece = "\n" + (text or "")
        else:
            piece = (CLOSE if s != START else "") + "".join(empty(x) for x in inserted) + OPEN.format(role=ROLES[t - 1]) + (text or "")
        out.append(piece)
    if final and out:
        end = moves[-1][1]
        out[-1] += CLOSE + {SYSTEM: empty(USER) + empty(ASSISTANT), USER: empty(ASSISTANT), ASSISTANT: ""}[end]
    return out


_SEGMENTS = "conv_id long, part int, node long, serial long, turns array<long>, roles array<string>, texts array<string>, costs array<long>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conversation, turn, role, text) as segments with their costs."""
    part, serial = TaskContext.get().partitionId(), 0
    held, now, size, node = [], None, 0, 0  # node: the conversation's first segment of this partition

    def row():
        turns, roles, texts = (list(x) for x in zip(*held, strict=True))
        costs = matrix([code(r) for r in roles]).ravel()
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int64()), pa.array([part], pa.int32()), pa.array([node]), pa.array([serial], pa.int64()), pa.array([turns], pa.list_(pa.int64())), pa.array([roles], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string())), pa.array([costs.tolist()])],
            ["conv_id", "part", "node", "serial", "turns", "roles", "texts", "costs"],
        )

    for b in batches:
        for row_ in zip(*b.columns, strict=True):
            conv, turn, role, text = (x.as_py() for x in row_)
            if held and (conv != now or len(held) == SEGMENT or size >= SEGMENT_BYTES):
                yield row()
                held, size, serial = [], 0, serial + 1
                node = node if conv == now else serial
            now = conv
            held.append((turn, role, text))
            size += len(text or "")
    if held:
        yield row()


def _matrices(parts: list[dict]) -> list[np.ndarray]:
    return [np.array(x["costs"], np.int64).reshape(4, 4) for x in parts]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's segments of one partition as one matrix."""
    for b in batches:
        costs = [product(_matrices(parts)).ravel().tolist() for parts in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "part", "node", "costs"])


_ENDS = "part int, serial long, first int, last int, final boolean"


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "serial", "first", "last", "final"])


def _between_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after each partition of a conversation, and whether it is the last one."""
    for b in batches:
        out = []
        for parts in b.column(0).to_pylist():
            found = states(_matrices(parts))
            out += [(x["part"], x["node"], first, last, x is parts[-1]) for x, (first, last) in zip(parts, found, strict=True)]
        yield _ends(out)


def _between_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after each segment, and whether it is its conversation's last one."""
    for b in batches:
        out = []
        for x in b.to_pylist():
            found = states(_matrices(x["parts"]), x["first"], x["last"])
            out += [(x["part"], y["serial"], first, last, x["final"] and y is x["parts"][-1]) for y, (first, last) in zip(x["parts"], found, strict=True)]
        yield _ends(out)


_RESULT = "conv_id long, turn long, position long, role string, repaired_role string, action string, inserted int, rendered string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.to_pylist():
            moves = repair([code(r) for r in x["roles"]], x["first"], x["last"])
            pieces = render(moves, x["texts"], x["first"], x["final"])
            n = len(moves)
            position = [(x["part"] << 40) + (x["serial"] << 10) + k for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["conv_id"]] * n, pa.int64()), pa.array(x["turns"], pa.int64()), pa.array(position, pa.int64()), pa.array(x["roles"], pa.string()), pa.array([ROLES[m[1] - 1] for m in moves]), pa.array([m[3] for m in moves]), pa.array([len(m[4]) for m in moves], pa.int32()), pa.array(pieces)],
                ["conv_id", "turn", "position", "role", "repaired_role", "action", "inserted", "rendered"],
            )


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each source turn: its repaired role, the action, the empty turns before it, and its rendered piece; ``position`` orders a conversation's pieces."""
    rows = turns.select(F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    keys = ["conv_id", "turn", "role", F.xxhash64("text")]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text")
    segments = stored(ordered.mapInArrow(_segments, _SEGMENTS), "segments")
    inner = segments.groupBy("conv_id", "part", "node").agg(F.array_sort(F.collect_list(F.struct("serial", "costs"))).alias("parts"))
    summed = inner.mapInArrow(_summed, "conv_id long, part int, node long, costs array<long>")
    chains = summed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "node", "costs"))).alias("parts"))
    outer = chains.select("parts").mapInArrow(_between_partitions, _ENDS).withColumnRenamed("serial", "node")
    ends = inner.join(outer, ["part", "node"]).select("part", "parts", "first", "last", "final").mapInArrow(_between_segments, _ENDS)
    return segments.drop("costs", "node").join(ends, ["part", "serial"]).mapInArrow(_repaired, _RESULT)
