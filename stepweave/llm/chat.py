"""Chat formatting with minimum-cost role repair.

Legal conversations: at most one system turn at the start, then user and assistant in turn, an assistant
turn last. Dynamic programming over this automaton chooses per turn to keep or relabel it, to merge it into the
turn before it, and where to insert empty turns. A chunk of turns acts on the costs of the four states as a matrix under
(min, +), so a conversation of any length is cut into chunks: each chunk's matrix is found alone, matrices are chained per
conversation (16 numbers for ``CHUNK`` turns) into the costs before each chunk, best paths are traced back over chunks, and
each chunk then decodes alone what the whole conversation would have. Only roles go through Python; texts are joined to the
decisions. Marks of turns within a text are escaped by a backslash, which ``unescaped`` takes back. Ties go to the first of: going on, merging; then the role order system, user, assistant.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, text_or_empty, written

ROLES = ("system", "user", "assistant")
#: Costs. RELABEL: between user and assistant; to or from system; of a role that is none of the three.
MERGE, INSERT, RELABEL, RELABEL_SYSTEM, RELABEL_UNKNOWN = 2, 4, 3, 5, 1
CHUNK = 4096
NEVER = 1 << 40
STATES = ("", *ROLES)
LEGAL = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
BEGIN, END = "<|{role}|>\n", "<|end|>\n"
DECIDED = "pid long, idx long, action string, repaired_role string, inserted string, inserted_after string, head string, tail string"
#: <| in a text, after any backslashes that an earlier escape may have put between.
_MARK = r"<(\\*)\|"


@lru_cache
def _bridge(state: str, role: str) -> tuple[str, ...] | None:
    """The fewest empty turns that lead from a state to where a turn of this role may follow; None if none do."""
    paths = [(state, ())]
    for _ in range(3):
        for s, path in paths:
            if role in LEGAL[s]:
                return path
        paths = [(r, (*path, r)) for s, path in paths for r in LEGAL[s]]
    return None


def _ending(state: str) -> tuple[str, ...]:
    return {"": (), "assistant": (), "user": ("assistant",), "system": ("user", "assistant")}[state]


def _relabel(role: str | None, to: str) -> int:
    return 0 if role == to else RELABEL_UNKNOWN if role not in ROLES else RELABEL_SYSTEM if "system" in (role, to) else RELABEL


@lru_cache(1024)
def _moves(role: str | None) -> tuple[tuple[tuple[int, bool], ...], ...]:
    """[state][next state]: cost and whether it merges."""
    out = []
    for s in STATES:
        row = [(NEVER, False)]
        for to in ROLES:
            own, path = (NEVER, False), _bridge(s, to)
            if path is not None:
                own = (INSERT * len(path) + _relabel(role, to), False)
            if s == to and MERGE + _relabel(role, to) < own[0]:
                own = (MERGE + _relabel(role, to), True)
            row.append(own)
        out.append(tuple(row))
    return tuple(out)


def _known(role) -> str | None:
    return role if role in ROLES else None


def matrix(roles: list[str | None]) -> list[list[int]]:
    """[state before][state after]: least cost of a run of turns."""
    out = []
    for s in range(4):
        costs = [NEVER] * 4
        costs[s] = 0
        for role in roles:
            moves = _moves(_known(role))
            costs = [NEVER, *[min(costs[a] + moves[a][b][0] for a in range(4)) for b in range(1, 4)]]
        out.append(costs)
    return out


START_COSTS = (0, NEVER, NEVER, NEVER)


def forward(matrices: list[list[list[int]]]) -> tuple[list[list[int]], int]:
    """Least costs of the states before each run, and the state after the last run that ends best."""
    costs, before = list(START_COSTS), []
    for m in matrices:
        before.append(costs)
        costs = [min(costs[a] + m[a][b] for a in range(4)) for b in range(4)]
    return before, min(range(4), key=lambda s: costs[s] + INSERT * len(_ending(STATES[s])))


def trace(roles: list[str | None], costs, leave: int) -> list[int]:
    """States before each turn and after the last, on the best path from states of these costs to ``leave``."""
    costs, back = list(costs), []
    for role in roles:
        moves = _moves(_known(role))
        options = [[NEVER] * 4, *[[costs[a] + moves[a][b][0] for a in range(4)] for b in range(1, 4)]]
        back.append([min(range(4), key=o.__getitem__) for o in options])
        costs = [min(o) for o in options]
    states = [leave]
    for b in reversed(back):
        states.append(b[states[-1]])
    return states[::-1]


def decode(roles: list[str | None], costs, leave: int) -> list[tuple[str, str, bool, tuple[str, ...]]]:
    """(action, role, merged, empty turns before it) of each turn on that path."""
    out, states = [], trace(roles, costs, leave)
    for role, a, b in zip(roles, states, states[1:], strict=False):
        merged = _moves(_known(role))[a][b][1]
        new = role != STATES[b]
        out.append(("relabel+merge" if new and merged else "merge" if merged else "relabel" if new else "keep", STATES[b], merged, () if merged else _bridge(STATES[a], STATES[b])))
    return out


def repair(roles: list[str | None]) -> tuple[int, list[tuple[str, str, bool, tuple[str, ...]]], tuple[str, ...]]:
    """Of one conversation: the least cost, each turn's decision, and the empty turns after the last."""
    m = matrix(roles)
    _, leave = forward([m])
    ending = _ending(STATES[leave])
    return m[0][leave] + INSERT * len(ending), decode(roles, START_COSTS, leave), ending


def _runs(chunk: pd.DataFrame):
    """Slices of a chunk by conversation; its rows are in order."""
    keys = chunk["conv_key"].to_numpy()
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    return zip(bounds[:-1], bounds[1:], strict=True)


def _end_matrices(chunk: pd.DataFrame) -> pd.DataFrame:
    chunk = chunk.sort_values("idx")
    runs = list(_runs(chunk))
    rows = []
    for k in dict.fromkeys((0, len(runs) - 1)):
        a, b = runs[k]
        m = matrix(_roles(chunk.iloc[a:b]))
        rows.append((int(chunk["pid"].iat[0]), int(chunk["chunk"].iat[0]), chunk["conv_key"].iat[a], [x for row in m for x in row]))
    return pd.DataFrame(rows, columns=["pid", "chunk", "conv_key", "m"])


def _costed(parts: pd.DataFrame) -> pd.DataFrame:
    """The runs of one conversation with the costs before each."""
    parts = parts.sort_values(["pid", "chunk"])
    before, leave = forward([np.asarray(m).reshape(4, 4).tolist() for m in parts["m"]])
    n = len(parts)
    return pd.DataFrame({"pid": parts["pid"], "chunk": parts["chunk"], "conv_key": parts["conv_key"], "costs": before, "leave": leave, "first": [k == 0 for k in range(n)], "last": [k == n - 1 for k in range(n)]})


def _traced(chunk: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The runs with the state that each begins in, for each state that it may be left in."""
    chunk = chunk.sort_values("idx")
    runs = {chunk["conv_key"].iat[a]: _roles(chunk.iloc[a:b]) for a, b in _runs(chunk)}
    return ends.assign(back=[[trace(runs[r.conv_key], r.costs, s)[0] for s in range(4)] for r in ends.itertuples()])


def _left(parts: pd.DataFrame) -> pd.DataFrame:
    """The runs of one conversation with the state that each is left in."""
    parts = parts.sort_values(["pid", "chunk"])
    leave = [int(parts["leave"].iat[-1])]
    for back in reversed(parts["back"].tolist()[1:]):
        leave.append(int(back[leave[-1]]))
    return parts.assign(leave=leave[::-1])[["pid", "chunk", "conv_key", "costs", "leave", "first", "last"]]


def _roles(rows: pd.DataFrame) -> list[str | None]:
    return [None if x is None or x != x else x for x in rows["role"].tolist()]


def _decided(chunk: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    chunk = chunk.sort_values("idx")
    known = {r.conv_key: r for r in ends.itertuples()}
    out = []
    begin = {r: BEGIN.format(role=r) for r in ROLES}
    for a, b in _runs(chunk):
        own = chunk.iloc[a:b]
        roles = _roles(own)
        at = known[own["conv_key"].iat[0]] if own["conv_key"].iat[0] in known else None
        costs, leave = (at.costs, at.leave) if at is not None else (START_COSTS, forward([matrix(roles)])[1])
        first, last = (at.first, at.last) if at is not None else (True, True)
        rows = decode(roles, costs, leave)
        for k, (action, role, merged, before) in enumerate(rows):
            head = "\n" if merged else ("" if first and k == 0 else END) + "".join(begin[r] + END for r in before) + begin[role]
            ends_here = last and k == len(rows) - 1
            after = _ending(STATES[leave]) if ends_here else ()
            tail = END + "".join(begin[r] + END for r in after) if ends_here else ""
            out.append((own["pid"].iat[k], own["idx"].iat[k], action, role, ",".join(before), ",".join(after), head, tail))
    return pd.DataFrame(out, columns=[c.split()[0] for c in DECIDED.split(", ")])


def unescaped(piece: str) -> str:
    """A text as it was before its marks were escaped."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", piece)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, action, repaired_role, inserted, inserted_after, piece), a row per row of turns(conv_id, turn, role, text); the pieces of a conversation, joined in order of place, are its rendering.

    Turns are ordered by turn (nulls first), role and text. A null text is empty; a null or other role is relabelled; rows with
    a null conv_id form one conversation; repeated rows are turns of their own. An empty table gives no rows. Extra columns are
    not kept.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text_or_empty().alias("text"))
    own = own.withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("tie", F.xxhash64("text"))
    order = ["conv_key", "turn", "role", "tie"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by range, so that a conversation of very many turns lies in several partitions, in order
    rows = own.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie")
    rows = rows.withColumn("pid", F.spark_partition_id().cast("long")).withColumn("idx", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = written(rows.withColumn("chunk", F.floor(F.col("idx") / CHUNK).cast("long")), "turns")
    light = rows.select("pid", "chunk", "idx", "conv_key", "role")
    parts = light.groupBy("pid", "chunk").applyInPandas(_end_matrices, "pid long, chunk long, conv_key string, m array<long>")
    run = "pid long, chunk long, conv_key string, costs array<long>, leave int, first boolean, last boolean"
    costed = parts.groupBy("conv_key").applyInPandas(_costed, run)
    traced = light.groupBy("pid", "chunk").cogroup(costed.groupBy("pid", "chunk")).applyInPandas(_traced, run + ", back array<int>")
    ends = written(traced.groupBy("conv_key").applyInPandas(_left, run), "ends")
    decided = light.groupBy("pid", "chunk").cogroup(ends.groupBy("pid", "chunk")).applyInPandas(_decided, DECIDED)
    piece = F.concat("head", F.regexp_replace("text", _MARK, "<\\\\$1|"), "tail")
    place = F.shiftleft("pid", 33).bitwiseOR(F.col("idx"))
    return rows.join(decided, ["pid", "idx"]).select("conv_id", "turn", "role", "text", place.alias("place"), "action", "repaired_role", "inserted", "inserted_after", piece.alias("piece"))


def op6_role_repair(spark, sf_dir: str) -> DataFrame:
    """Every turn's repair and its piece of the rendering."""
    out = format_chats(load(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "place", "role", "action", "repaired_role", "inserted", "inserted_after", "piece")
