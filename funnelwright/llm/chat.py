"""Operator 5: minimum-cost role repair of conversations, then rendering.

The legal automaton: an optional system turn first, then user and assistant in turn, the assistant last. For each turn
a dynamic programme chooses to keep it, to merge it into the turn before, to relabel it, or to insert an empty turn
before it; an empty assistant turn may be inserted at the end. A step is a 4 x 4 matrix of costs between automaton
states, and the cost of a piece of a conversation is the (min, +) product of its steps, so pieces can be solved apart.

Turns are dealt by range of (conversation, turn, role, text), so that a conversation of any size spreads over tasks and
equal turn numbers have a fixed order. Each task repairs the conversations that lie wholly inside its range; of the
first and last one it keeps the turns and the piece's matrix. Those pieces are joined per conversation, one matrix
each, which gives every piece its entry and exit state, and are then repaired like whole ones.

Costs: merge 1, relabel 3, relabel and merge 4, each inserted turn 2. Ties fall by the order keep, merge, relabel to
user, assistant, system, relabelled merge, with fewer insertions first.

Rendering gives each turn its own piece of the conversation: the end mark of the turn before, the header and the text
(a merged turn: a line end and the text); the last piece closes the conversation. ``<|`` inside a text becomes ``< |``.

Defined results: null roles and roles other than the three have no legal place and are relabelled; null texts are
empty; null turn numbers come first; turns of a null conversation form one conversation; repeated rows stay; an empty
table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from funnelwright.llm.common import shuffle_width, stored

ROLES = ("user", "assistant", "system")
START, USER, ASSISTANT, SYSTEM = 0, 1, 2, 3
NEXT = {START: (USER, SYSTEM), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
END = ASSISTANT
MERGE, RELABEL, BLEND, INSERT = 1, 3, 4, 2
INF = float("inf")


def _options(role: str | None) -> list[list[tuple]]:
    """For each state: (cost, rank, state after, inserted states, action), best first for each state after."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    out = []
    for s in range(4):
        best: dict[int, tuple] = {}

        def offer(cost, rank, to, inserted, action):
            if to not in best or (cost, rank) < best[to][:2]:
                best[to] = (cost, rank, to, inserted, action)

        paths = [(t, ()) for t in NEXT[s]] + [(u, (t,)) for t in NEXT[s] for u in NEXT[t]] + [(v, (t, u)) for t in NEXT[s] for u in NEXT[t] for v in NEXT[u]]
        for to, inserted in paths:
            cost = INSERT * len(inserted)
            if to == own:
                offer(cost, (0, len(inserted)), to, inserted, "keep")
            else:
                offer(cost + RELABEL, (2, to, len(inserted)), to, inserted, "relabel")
        if s != START:
            offer(MERGE if own == s else BLEND, (1 if own == s else 3, 0), s, (), "merge" if own == s else "relabel and merge")
        out.append(list(best.values()))
    return out


OPTIONS = {r: _options(r) for r in (*ROLES, None)}
# What ending in a state costs: an empty assistant turn after user, user and assistant after system; nothing at all is legal.
CLOSING = {START: (0, ()), ASSISTANT: (0, ()), USER: (INSERT, (ASSISTANT,)), SYSTEM: (2 * INSERT, (USER, ASSISTANT))}


def forward(roles: list[str | None], start: list[float]) -> list[list[tuple]]:
    """Costs of each state after each turn, with the state before and the option taken."""
    now, steps = start, []
    for role in roles:
        options = OPTIONS[role if role in ROLES else None]
        nxt: list[tuple] = [(INF,)] * 4
        for s in range(4):
            if now[s] < INF:
                for o in options[s]:
                    found = (now[s] + o[0], o[1], s)
                    if found < nxt[o[2]][:3]:
                        nxt[o[2]] = (*found, o)
        steps.append(nxt)
        now = [x[0] for x in nxt]
    return steps


def matrix(roles: list[str | None]) -> list[float]:
    """Costs of a piece from each state to each state."""
    out = []
    for s in range(4):
        out += [x[0] for x in forward(roles, [0.0 if t == s else INF for t in range(4)])[-1]]
    return out


def repair(turns: list[tuple], entry: int, leave: int | None, closes: bool) -> list[tuple]:
    """Rows (turn, action, role before, role after, inserted roles, cost, rendered) for the (turn, role, text) of a piece.

    ``leave`` is the state the piece must end in; None lets the closing cost decide.
    """
    steps = forward([r for _, r, _ in turns], [0.0 if s == entry else INF for s in range(4)])
    state = leave if leave is not None else min((s for s in range(4)), key=lambda s: (steps[-1][s][0] + CLOSING[s][0], s))
    last, chosen = state, []
    for nxt in reversed(steps):
        chosen.append(nxt[state][3])
        state = nxt[state][2]
    chosen.reverse()
    out, at = [], entry
    for k, ((turn, role, text), (cost, _, to, inserted, action)) in enumerate(zip(turns, chosen)):
        piece, opened = [], at != START
        for s in (*inserted, *(() if action.endswith("merge") else (to,))):
            piece.append(("<|end|>\n" if opened else "") + f"<|{ROLES[s - 1]}|>\n")
            opened = True
        body = (text or "").replace("<|", "< |")
        piece.append(("\n" if action.endswith("merge") else "") + body)
        ends = [ROLES[s - 1] for s in CLOSING[last][1]] if closes and k + 1 == len(turns) else []
        if closes and k + 1 == len(turns):
            piece += [f"<|end|>\n<|{r}|>\n" for r in ends] + ["<|end|>\n"]
            cost += INSERT * len(ends)
        out.append((turn, action, role, ROLES[to - 1], [ROLES[s - 1] for s in inserted] + ends, cost, "".join(piece)))
        at = to
    return out


REPAIRED = "conv_id long, part int, step int, turn long, action string, role_before string, role string, inserted array<string>, cost int, rendered string"
PASSED = REPAIRED + ", pending boolean, text string, matrix array<double>"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.float64())]
_NAMES = [x.split()[0] for x in PASSED.split(", ")]


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per input turn, in the order of (conv_id, part, step): what became of it, and its rendered piece."""

    def run(batches):
        part = TaskContext.get().partitionId()

        def whole(conv, turns):
            return [(conv, part, k, t, a, b, r, i, int(c), x, False, None, None) for k, (t, a, b, r, i, c, x) in enumerate(repair(turns, START, None, True))]

        def pending(conv, turns):
            m = matrix([r for _, r, _ in turns])
            return [(conv, part, k, t, None, r, None, None, None, None, True, x, m if k == 0 else None) for k, (t, r, x) in enumerate(turns)]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

        conv, turns, number, rows = None, [], 0, []
        for batch in batches:
            for c, t, r, x in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if turns and c != conv:
                    rows += (pending if number == 0 else whole)(conv, turns)
                    turns, number = [], number + 1
                conv = c
                turns.append((t, r, x))
            if len(rows) > 2000:
                yield batch_of(rows)
                rows = []
        if turns:
            rows += pending(conv, turns)
        if rows:
            yield batch_of(rows)

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry and exit state of each piece of a conversation, from one matrix per piece."""
        pdf = pdf.sort_values("part")
        cost, back = [0.0, INF, INF, INF], []
        for m in pdf["matrix"]:
            step = [min((cost[s] + m[4 * s + t], s) for s in range(4)) for t in range(4)]
            back.append([s for _, s in step])
            cost = [c for c, _ in step]
        at = min(range(4), key=lambda s: (cost[s] + CLOSING[s][0], s))
        leave, entry = [], []
        for b in reversed(back):
            leave.append(at)
            at = b[at]
            entry.append(at)
        out = pdf[["conv_id", "part"]].assign(entry=entry[::-1], leave=leave[::-1])
        out["closes"] = [k + 1 == len(out) for k in range(len(out))]
        return out

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        one = pdf.iloc[0]
        turns = [(None if pd.isna(t) else int(t), r, x) for t, r, x in zip(pdf["turn"], pdf["role_before"], pdf["text"])]
        rows = repair(turns, int(one["entry"]), int(one["leave"]), bool(one["closes"]))
        conv = None if pd.isna(one["conv_id"]) else int(one["conv_id"])
        out = pd.DataFrame([(conv, one["part"], k, *r) for k, r in enumerate(rows)], columns=_NAMES[:10])
        return out.astype({"conv_id": "Int64", "turn": "Int64", "cost": "int32"})

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    ordered = turns.repartitionByRange(shuffle_width(conversations.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = stored(ordered.mapInArrow(run, PASSED), "turns")
    open_rows = rows.where("pending")
    # At most two pieces per partition.
    pieces = open_rows.where("matrix is not null").select("conv_id", "part", "matrix")
    known = pieces.groupBy("conv_id").applyInPandas(states, "conv_id long, part int, entry int, leave int, closes boolean")
    same = (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("part") == F.col("p"))
    joined = open_rows.join(known.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "entry", "leave", "closes"), same).drop("c", "p")
    done = joined.select("conv_id", "part", "step", "turn", "role_before", "text", "entry", "leave", "closes").groupBy("conv_id", "part").applyInPandas(finish, REPAIRED)
    return rows.where("not pending").select(*_NAMES[:10]).unionByName(done)
