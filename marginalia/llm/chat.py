"""Chat formatting with minimum-cost role repair.

Turns of a conversation must be accepted by an automaton: an optional system turn, then user and
assistant in turn, an assistant last. For every input turn a dynamic program over the automaton's
states chooses to keep it, to merge it into the turn before, or to relabel it, with empty turns
inserted where the automaton needs them, at the least total cost.

Costs add along paths, so a stretch of turns is a small matrix (least cost from state to state), and
stretches combine. Turns are sorted into range partitions, in which a conversation of any length may
lie across several. Of the conversations that do, at most two a partition, the driver gets matrices and
fixes the states at the borders; all else is decided and rendered where the turns are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import checkpointed, cleared, row_schema, with_columns

#: States of the automaton: nothing yet, and after a turn of each role. Fixed values.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (START, ASSISTANT)
COSTS = {"keep": 0, "merge": 1, "relabel": 2, "insert": 3}


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The empty turns to insert so that from a state a role may follow; the shortest, if any."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for s in NEXT:
        seen, front = {s: ()}, [s]
        while front:
            later = []
            for a in front:
                for r in NEXT[a]:
                    if (s, r) not in out:
                        out[s, r] = seen[a]
                    if r not in seen:
                        seen[r] = (*seen[a], r)
                        later.append(r)
            front = later
    return out


_INSERT = _paths()


def choices(role: str | None, costs: dict[str, int] = COSTS) -> list[tuple[int, int, int, str, tuple[int, ...], int]]:
    """(state, next state, cost, action, inserted, role) of an input turn, the preferred first where costs tie."""
    own = ROLES.index(role) if role in ROLES[1:] else None
    out = []
    for s in range(4):
        for r in (SYSTEM, USER, ASSISTANT):
            change = 0 if r == own else costs["relabel"]
            if s == r:
                out.append((s, r, costs["merge"] + change, "merge" if r == own else "relabel+merge", (), r))
            if (s, r) in _INSERT:
                gap = _INSERT[s, r]
                name = ("keep" if r == own else "relabel") if not gap else ("insert" if r == own else "relabel+insert")
                out.append((s, r, costs["keep"] + change + costs["insert"] * len(gap), name, gap, r))
    return sorted(out, key=lambda c: c[2])


_CHOICES: dict[str | None, list] = {}


def _of(role: str | None) -> list:
    role = role if role in ROLES[1:] else None
    if role not in _CHOICES:
        _CHOICES[role] = choices(role)
    return _CHOICES[role]


def _ending(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty turns of ending in a state."""
    if state in FINAL:
        return 0, ()
    gap = (*_INSERT[state, ASSISTANT], ASSISTANT)
    return COSTS["insert"] * len(gap), gap


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state to each other over these turns."""
    best = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for role in roles:
        step = np.full((4, 4), np.inf)
        for s, t, cost, *_ in _of(role):
            step[s, t] = min(step[s, t], cost)
        best = (best[:, :, None] + step[None, :, :]).min(1)
    return best


def repair(roles: list[str | None], start: int = START, end: int | None = None) -> tuple[float, list[tuple[str, tuple[int, ...], int]], tuple[int, ...]]:
    """Cost, (action, inserted before, role) of each turn, and the empty turns at the end.

    Without end the conversation may end in any state, at the cost of completing it; with end, the
    turns must lead to that state and nothing is added.
    """
    cost = [np.inf] * 4
    cost[start] = 0
    back: list[list] = []
    for role in roles:
        new, by = [np.inf] * 4, [None] * 4
        for c in _of(role):
            if cost[c[0]] + c[2] < new[c[1]]:
                new[c[1]], by[c[1]] = cost[c[0]] + c[2], c
        cost = new
        back.append(by)
    tail: tuple[int, ...] = ()
    if end is None:
        end = min(range(4), key=lambda s: (cost[s] + _ending(s)[0], s))
        tail = _ending(end)[1]
        cost[end] += _ending(end)[0]
    steps, state = [], end
    for by in reversed(back):
        c = by[state]
        steps.append((c[3], c[4], c[5]))
        state = c[0]
    return cost[end], steps[::-1], tail


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int | None, list[pa.RecordBatch]]]:
    """Conversations of a partition in order, each as pieces of batches."""
    key, held = None, []
    for batch in batches:
        ids = batch.column("ch_conv").to_pylist()
        a = 0
        for b in range(1, len(ids) + 1):
            if b == len(ids) or ids[b] != ids[a]:
                if held and ids[a] != key:
                    yield key, held
                    held = []
                key = ids[a]
                held.append(batch.slice(a, b - a))
                a = b
    if held:
        yield key, held


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", open_: str = "<|{role}|>\n", close: str = "<|end|>\n"
) -> DataFrame:
    """turns with new_role, action, n_inserted, cost (the turn's share), place (from 1 in its conversation) and rendered.

    The rendered pieces of a conversation, put together by place, are the repaired chat: every turn is
    open_, its text, close; a merged turn follows the one before after a newline. An empty turn has an
    empty text. Turns are ordered by turn number, then role, then text, nulls first; rows that repeat
    are turns each. A null or unknown role must be relabelled; a null text is empty; turns with a null
    conversation are one conversation. An empty table stays empty. Columns of the new names give way.

    Of the choices with the least total cost the one is taken whose last states come first in the order
    nothing, system, user, assistant, and of equal actions the first in the order of choices.
    """
    turns, back = cleared(turns, ("new_role", "action", "n_inserted", "cost", "place", "rendered"), (conv_col, turn_col, role_col, text_col), "ch_")
    spark = turns.sparkSession
    keys = {"ch_conv": F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))}
    order = ["ch_conv", turn_col, role_col, text_col]
    placed = turns.withColumns(keys).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(placed.withColumn("ch_part", F.spark_partition_id()))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for key, pieces in _runs(batches, []):
            roles = [r for p in pieces for r in p.column(role_col).to_pylist()]
            row = key, pieces[0].column("ch_part")[0].as_py(), roles
            first, last = first or row, row
        for key, part, roles in ([first] if first is last else [first, last]) if first else []:
            yield pa.RecordBatch.from_pydict({"conv": [key], "part": [part], "costs": [matrix(roles).ravel().tolist()], "n": [len(roles)]})

    met: dict[str, list[tuple[int, np.ndarray, int]]] = {}
    for row in placed.select("ch_conv", "ch_part", role_col).mapInArrow(borders, "conv string, part bigint, costs array<double>, n bigint").collect():
        met.setdefault(row["conv"], []).append((row["part"], np.array(row["costs"]).reshape(4, 4), row["n"]))
    fixed: dict[tuple[str, int], tuple[int, int | None, int, int]] = {}
    for conv, parts in met.items():
        if len(parts) > 1:
            parts.sort(key=lambda p: p[0])
            cost, came = np.where(np.arange(4) == START, 0.0, np.inf), []
            for _, m, _ in parts:
                both = cost[:, None] + m
                came.append(both.argmin(0))
                cost = both.min(0)
            end = min(range(4), key=lambda s: (cost[s] + _ending(s)[0], s))
            state, last, before = end, True, sum(n for _, _, n in parts)
            for (part, _, n), by in zip(reversed(parts), reversed(came), strict=True):
                before -= n
                fixed[conv, part] = int(by[state]), None if last else int(state), int(end), before
                state, last = int(by[state]), False
    sent = spark.sparkContext.broadcast(fixed)

    def header(r: int) -> str:
        return open_.format(role=ROLES[r])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pieces in _runs(batches, []):
            roles = [r for p in pieces for r in p.column(role_col).to_pylist()]
            start, end, goal, before = sent.value.get((key, pieces[0].column("ch_part")[0].as_py()), (START, None, None, 0))
            if end is None and goal is not None:
                _, steps, _ = repair(roles, start, goal)
                tail = _ending(goal)[1]
            else:
                _, steps, tail = repair(roles, start, end)
            inside = end is not None
            at, opened = 0, start
            for p in pieces:
                rendered, actions, news, gaps, costs = [], [], [], [], []
                for text in p.column(text_col).to_pylist():
                    action, gap, r = steps[at]
                    merged = action.endswith("merge")
                    if merged:
                        head = "\n"
                    else:
                        head = (close if opened != START else "") + "".join(header(g) + close for g in gap) + header(r)
                    opened = r
                    at += 1
                    last = at == len(steps) and not inside
                    rendered.append(head + (text or "") + (close + "".join(header(g) + close for g in tail) if last else ""))
                    actions.append(action)
                    news.append(ROLES[r])
                    gaps.append(len(gap) + (len(tail) if last else 0))
                    costs.append(sum(COSTS[a] for a in action.split("+") if a != "insert") + COSTS["insert"] * gaps[-1])
                yield with_columns(p, ("ch_conv", "ch_part"), new_role=pa.array(news), action=pa.array(actions), n_inserted=pa.array(gaps, pa.int32()), cost=pa.array(costs, pa.int32()), place=pa.array(range(before + at - len(costs) + 1, before + at + 1), pa.int64()), rendered=pa.array(rendered))

    return back(placed.mapInArrow(render, row_schema(turns, "new_role string, action string, n_inserted int, cost int, place bigint, rendered string")))
