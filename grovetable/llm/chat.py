"""Minimum-cost repair of conversation roles, and rendering.

A legal conversation is one system turn or none, then user and assistant in turn, assistant last.
Every message either opens a turn or is merged into the one before, under its own role or
another, and empty turns may be put in between. Dynamic programming over the automaton of
legal turns finds the cheapest repair. Steps of the program are (min, +) matrices, which multiply in any grouping:
a conversation is cut into blocks, every block becomes one small matrix, the blocks' matrices say in
which states the best path enters and leaves each block, and blocks are then solved side by side. So no task
holds a whole conversation, however long.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_key, settle

ROLES = ("", "system", "user", "assistant")  # state 0: nothing said yet
FOLLOWS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: Relabelling says that someone else spoke, so it costs most.
RELABEL, MERGE, INSERT = 4, 1, 2
#: Cost of ending in each state: what must still be put in.
CLOSING = {0: ((), 0), 1: ((2, 3), 2 * INSERT), 2: ((3,), INSERT), 3: ((), 0)}
FAR = 1 << 40
BLOCK = 1024


def moves(role: str | None) -> list[tuple[int, int, int, int, bool]]:
    """Every legal (from state, to state, cost, inserted state, merged) for a message with this role, preferred ones first."""
    said = ROLES.index(role) if role in ROLES[1:] else -1
    out = []
    for p in range(4):
        for q in (1, 2, 3):
            base = 0 if q == said else RELABEL
            if q in FOLLOWS[p]:
                out.append((p, q, base, 0, False))
            if q == p:
                out.append((p, q, base + MERGE, 0, True))
            for m in FOLLOWS[p]:
                if q in FOLLOWS[m]:
                    out.append((p, q, base + INSERT, m, False))
    return sorted(out, key=lambda x: (x[2], x[4], x[3], x[1]))


MOVES = {r: moves(r) for r in (*ROLES[1:], None)}


def known_role(role) -> str | None:
    r = role.strip().lower() if isinstance(role, str) else None
    return r if r in MOVES else None


def solve(roles: list, entry: int) -> tuple[list[int], list[dict]]:
    """Costs of ending in each state from ``entry``, and the best move into each state after each message."""
    cost, back = [FAR] * 4, []
    cost[entry] = 0
    for role in roles:
        new, best = [FAR] * 4, {}
        for move in MOVES[role]:
            p, q, c, _, _ = move
            if cost[p] + c < new[q]:
                new[q], best[q] = cost[p] + c, move
        cost = new
        back.append(best)
    return cost, back


def finish(cost: list[int]) -> int:
    """The best state to end in."""
    return min(range(4), key=lambda s: (cost[s] + CLOSING[s][1], -s))


def _matrices(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for key, part in pdf.sort_values("pos").groupby("key", sort=False):
        roles = [known_role(r) for r in part["role"]]
        matrix = [c for p in range(4) for c in solve(roles, p)[0]]
        out.append((key, int(part["block"].iloc[0]), matrix, 0, finish(matrix[:4])))
    return pd.DataFrame(out, columns=["key", "block", "matrix", "entry", "leave"])


def _joints(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block").reset_index(drop=True)
    cost, backs = [0, FAR, FAR, FAR], []
    for matrix in pdf["matrix"]:
        options = [[cost[p] + int(matrix[4 * p + q]) for p in range(4)] for q in range(4)]
        backs.append([min(range(4), key=o.__getitem__) for o in options])
        cost = [min(o) for o in options]
    state, entries, leaves = finish(cost), [], []
    for back in reversed(backs):
        leaves.append(state)
        state = back[state]
        entries.append(state)
    return pdf.assign(entry=entries[::-1], leave=leaves[::-1], ends=[False] * (len(pdf) - 1) + [True])[["key", "block", "entry", "leave", "ends"]]


_PIECES = "key string, pos long, turn long, role string, repaired_role string, action string, inserted_before string, inserted_after string, cost int, rendered string"


def _traced(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for key, part in pdf.sort_values("pos").groupby("key", sort=False):
        roles = [known_role(r) for r in part["role"]]
        state, path = int(part["leave"].iloc[0]), []
        for best in reversed(solve(roles, int(part["entry"].iloc[0]))[1]):
            path.append(best[state])
            state = best[state][0]
        last = len(path) - 1 if bool(part["ends"].iloc[0]) else -1
        for i, (row, (p, q, cost, m, merged), role) in enumerate(zip(part.itertuples(), reversed(path), roles)):
            text = row.text if isinstance(row.text, str) else ""
            after = CLOSING[q][0] if i == last else ()
            head = "\n" if merged else ("<|end|>\n" if p else "") + (f"<|{ROLES[m]}|>\n<|end|>\n" if m else "") + f"<|{ROLES[q]}|>\n"
            tail = "<|end|>\n" + "".join(f"<|{ROLES[a]}|>\n<|end|>\n" for a in after) if i == last else ""
            action = "+".join(a for a, on in (("relabel", ROLES[q] != role), ("merge", merged), ("insert", bool(m or after))) if on) or "keep"
            out.append((key, row.pos, row.turn, row.role, ROLES[q], action, ROLES[m] or None, ",".join(ROLES[a] for a in after) or None, cost + INSERT * len(after), head + text + tail))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")]).astype({"turn": "Int64"})


def repair_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``turns`` (conv_id, turn, role, text) with its repaired role and its piece of the rendering.

    Messages are ordered by turn (null first), then by a hash of role and text. Roles are read without
    case and outer blanks; an unknown or null role must be relabelled. Null text renders as empty; a null conv_id is one
    conversation; repeated rows are messages of their own; an empty table gives no rows; other columns are ignored.

    Returns conv_id, pos (order over all), turn, role, repaired_role, action (keep, or relabel, merge and insert
    joined by +), inserted_before and inserted_after (roles of empty turns), cost, rendered. A
    conversation's rendering is its pieces in order of pos.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), group_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["key", "turn", "tie"]
    laid = own.withColumn("tie", F.xxhash64("role", "text")).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = settle(laid.drop("tie").withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.floor(F.col("pos") / block).cast("long")), "chat-laid")

    small = laid.select("key", "block", "pos", "role")
    parts = settle(small.groupBy("block").applyInPandas(_matrices, "key string, block long, matrix array<long>, entry int, leave int"), "chat-blocks")
    split = parts.groupBy("key").count().filter("count > 1").select("key")
    long_ones = parts.join(split, "key", "left_semi").groupBy("key").applyInPandas(_joints, "key string, block long, entry int, leave int, ends boolean")
    short_ones = parts.join(split, "key", "left_anti").select("key", "block", "entry", "leave", F.lit(True).alias("ends"))
    joints = short_ones.union(long_ones)
    traced = laid.join(joints, ["key", "block"]).groupBy("block").applyInPandas(_traced, _PIECES)
    conv = F.when(F.col("key") == "1", F.lit(None)).otherwise(F.substring("key", 2, 20)).cast("long")
    return traced.select(conv.alias("conv_id"), "pos", "turn", "role", "repaired_role", "action", "inserted_before", "inserted_after", "cost", "rendered")


def render_conversations(pieces: DataFrame) -> DataFrame:
    """conv_id and its whole rendering, for conversations that fit a row."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "rendered"))), lambda x: x["rendered"])
    return pieces.groupBy("conv_id").agg(F.array_join(ordered, "").alias("rendered"))
