"""Conversations with legal turns: repaired at the least cost, and rendered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import small_batches, stored
from tallymill.session import checkpointed, shared_folder

ROLES = ("system", "user", "assistant")
# States of the automaton: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# Turns that may follow a state: a system turn only comes first, then user and assistant
# take turns, and a conversation ends with the assistant.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
LAST = ASSISTANT
# Costs. Turns with an unknown or null role are relabelled at the price of any other.
MERGE, RELABEL, INSERT = 2, 3, 4
# Rendering.
OPEN, CLOSE, JOIN = "<|im_start|>{role}\n", "<|im_end|>\n", "\n\n"

PIECES = "conv_id long, piece long, turn_no long, role string, action string, cost long, rendered string"
_FAR = 1 << 40


def _paths() -> dict[int, dict[int, tuple[int, tuple[int, ...]]]]:
    """State before -> state after -> (empty turns, their roles): the shortest way by
    inserted empty turns."""
    found = {}
    for state in range(STATES):
        reached, edge = {state: (0, ())}, [state]
        while edge:
            after = []
            for s in edge:
                for t in NEXT[s]:
                    if t not in reached:
                        reached[t] = (reached[s][0] + 1, (*reached[s][1], t))
                        after.append(t)
            edge = after
        found[state] = reached
    return found


WAYS = _paths()


def options(role: int | None) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """What may happen at a turn of this role (None: unknown): (state before, state after,
    cost, action, inserted roles). In order of preference for equal costs."""
    found = []
    for before in range(STATES):
        for after in (SYSTEM, USER, ASSISTANT):
            label = 0 if role == after else RELABEL
            if before == after:
                found.append((before, after, MERGE + label, "merge" if not label else "relabel+merge", ()))
            for via, (n, inserted) in WAYS[before].items():
                if after in NEXT[via]:
                    name = ("keep" if not label else "relabel") if not n else ("insert" if not label else "insert+relabel")
                    found.append((before, after, n * INSERT + label, name, inserted))
    return sorted(found, key=lambda o: (o[1], o[2], o[0], o[3]))


_OPTIONS = {role: options(role) for role in (None, SYSTEM, USER, ASSISTANT)}


def step(costs: list[tuple], role: int | None) -> tuple[list[tuple], list[tuple | None]]:
    """One turn of the dynamic program. `costs` has (cost, turns, pieces) so far per state;
    returns the same after the turn and the option taken into each state."""
    best: list[tuple] = [(_FAR, 0, 0)] * STATES
    taken: list[tuple | None] = [None] * STATES
    for option in _OPTIONS[role]:
        before, after, cost, action, inserted = option
        c, turns, pieces = costs[before]
        if c + cost < best[after][0]:
            best[after] = (c + cost, turns + len(inserted) + ("merge" not in action), pieces + len(inserted) + 1)
            taken[after] = option
    return best, taken


def ending(state: int) -> tuple[int, tuple[int, ...]]:
    """(cost, inserted roles) to end in this state."""
    n, inserted = WAYS[state].get(LAST, (_FAR, ()))
    return n * INSERT, inserted


def start_costs(state: int) -> list[tuple]:
    return [(0, 0, 0) if s == state else (_FAR, 0, 0) for s in range(STATES)]


def _code(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else None


def best_end(costs: list[tuple]) -> int:
    return min(range(STATES), key=lambda s: (costs[s][0] + ending(s)[0], s))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(whether a new conversation begins, row) of the sorted rows of a partition."""
    last: object = _groups
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
        for conv, role, text in zip(*columns, strict=True):
            yield conv != last or last is _groups, conv, role, text
            last = conv


EDGES = "part int, place int, conv_id long, n long, costs array<long>, turns array<long>, pieces array<long>"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of a partition, which may go on in another one:
    the best (cost, turns, pieces) from each state before to each state after its rows here."""
    part, place, first, current = TaskContext.get().partitionId(), -1, None, None
    for new, conv, role, _ in _groups(batches):
        if new:
            if place == 0:
                first = current
            place += 1
            current = [conv, 0, [start_costs(s) for s in range(STATES)]]
        current[1] += 1
        current[2] = [step(costs, _code(role))[0] for costs in current[2]]
    rows = [(0, first)] if first else []
    rows += [(place, current)] if current else []
    columns = [[part] * len(rows), [p for p, _ in rows], [r[0] for _, r in rows], [r[1] for _, r in rows]]
    columns += [[[costs[e][k] for costs in r[2] for e in range(STATES)] for _, r in rows] for k in range(3)]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in EDGES.split(", ")])


def join_edges(edges: list) -> dict[tuple[int, int], tuple[int, int, int, int, bool]]:
    """For rows of EDGES in order: (part, place) -> (state before, state after, turns before,
    pieces before, whether the conversation ends there), for the whole conversation's best way."""
    found = {}
    k = 0
    while k < len(edges):
        end = k + 1
        while end < len(edges) and edges[end].conv_id == edges[k].conv_id and edges[end].part != edges[end - 1].part:
            end += 1
        run = edges[k:end]
        costs, back = start_costs(START), []
        for r in run:
            after, origin = [(_FAR, 0, 0)] * STATES, [0] * STATES
            for s in range(STATES):
                for e in range(STATES):
                    c, t, p = (x[s * STATES + e] for x in (r.costs, r.turns, r.pieces))
                    if costs[s][0] + c < after[e][0]:
                        after[e], origin[e] = (costs[s][0] + c, costs[s][1] + t, costs[s][2] + p), s
            back.append(origin)
            costs = after
        state, states = best_end(costs), []
        for origin in reversed(back):
            states.append((origin[state], state))
            state = origin[state]
        turns = pieces = 0
        for r, (before, after) in zip(run, reversed(states), strict=True):
            found[r.part, r.place] = (before, after, turns, pieces, r is run[-1])
            turns += r.turns[before * STATES + after]
            pieces += r.pieces[before * STATES + after]
        k = end
    return found


def _repair(known: dict[tuple[int, int], tuple[int, int, int, int, bool]]):
    names = [f.split()[0] for f in PIECES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def pieces(conv, rows: list[tuple], where: tuple | None) -> Iterator[tuple]:
        before, after, turn, piece, ends = where or (START, None, 0, 0, True)
        costs, taken = start_costs(before), []
        for role, _ in rows:
            costs, options_taken = step(costs, role)
            taken.append(options_taken)
        state = best_end(costs) if after is None else after
        last, way = state, []
        for options_taken in reversed(taken):
            way.append(options_taken[state])
            state = options_taken[state][0]
        begun = before != START
        for (_, text), (_, role, cost, action, inserted) in zip(rows, reversed(way), strict=True):
            for empty in inserted:
                yield conv, piece, turn, ROLES[empty - 1], "empty", INSERT, (CLOSE if begun else "") + OPEN.format(role=ROLES[empty - 1])
                begun, turn, piece = True, turn + 1, piece + 1
            joined = "merge" in action
            turn -= joined
            head = JOIN if joined else (CLOSE if begun else "") + OPEN.format(role=ROLES[role - 1])
            yield conv, piece, turn, ROLES[role - 1], action.removeprefix("insert+").replace("insert", "keep"), cost - INSERT * len(inserted), head + (text or "")
            begun, turn, piece = True, turn + 1, piece + 1
        if ends:
            for empty in ending(last)[1]:
                yield conv, piece, turn, ROLES[empty - 1], "empty", INSERT, CLOSE + OPEN.format(role=ROLES[empty - 1])
                turn, piece = turn + 1, piece + 1
            yield conv, piece, turn - 1, ROLES[LAST - 1], "end", 0, CLOSE

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), -1
        conv, rows, done = None, [], []
        for new, this, role, text in _groups(batches):
            if new:
                if place >= 0:
                    done += pieces(conv, rows, known.get((part, place)))
                conv, rows, place = this, [], place + 1
                if len(done) > 5000:
                    yield out(done)
                    done = []
            rows.append((_code(role), text))
        if place >= 0:
            done += pieces(conv, rows, known.get((part, place)))
        if done:
            yield out(done)

    return run


def repair(turns: DataFrame) -> DataFrame:
    """Repaired and rendered conversations of `turns` (conv_id, turn, role, text, any other
    columns), in pieces: (conv_id, piece, turn_no, role, action, cost, rendered). The pieces
    of a conversation, joined by `piece`, are its rendered text; turn_no counts its legal
    turns. A piece is a given turn (keep, relabel, merge with the turn before, or both), an
    empty turn, or the end. The costs of a conversation's pieces add up to the least of all
    ways to make it legal; of equal ways the one with the smaller states wins.

    Rows are ordered by conv_id, turn, role and text over range partitions, so a long
    conversation is spread over several of them and none is gathered. A turn is a step from
    the costs of the states before to those after; what lies in one partition is summed up
    as the costs from each state to each state. Only these sums for the first and the last
    conversation of each partition go to the driver, where they fix the states at the seams;
    then each partition finds its own best way between them.

    - Null and unknown roles are relabelled; a null text is empty; turns with equal numbers
      come by role and text; a null turn number comes first; null conv_ids are one conversation.
    - Repeated rows are repeated turns. An empty table gives an empty table.
    """
    shared_folder(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "row"]
    rows = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text"))
    with small_batches(turns.sparkSession, 5000):
        edges = rows.select("conv_id", "role", F.lit("").alias("text")).mapInArrow(_edges, EDGES).collect()
    known = join_edges(sorted(edges, key=lambda r: (r.part, r.place)))
    return stored(rows.mapInArrow(_repair(known), PIECES), "conversations")


def whole(pieces: DataFrame) -> DataFrame:
    """(conv_id, cost, text): each conversation as one text, for conversations that fit into
    a row."""
    held = F.array_sort(F.collect_list(F.struct("piece", "rendered")))
    return pieces.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(held, lambda p: p["rendered"]), "").alias("text"))
