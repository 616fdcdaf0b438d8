"""Chat formatting: cheapest role repair over a legal-turn automaton, then rendering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import stored
from adledger.session import durable

ROLES = ("system", "user", "assistant")
#: State 0 is the start, state i + 1 follows a turn of ROLES[i]. NEXT[s] are the roles legal there.
NEXT = (("system", "user"), ("user",), ("assistant",), ("user",))
MERGE, RELABEL, INSERT = 2, 4, 3
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
FAR = 1 << 60


@lru_cache(maxsize=None)
def moves(role: str | None) -> tuple[tuple[tuple[int, tuple[str, ...], str, str] | None, ...], ...]:
    """Cheapest way from each state to each state with a turn of ``role``: (cost, roles of
    empty turns inserted before, action, role given), or None.

    The turn is kept or relabelled to a role legal there, or merged into the turn before.
    A role that is not one of ROLES can only be relabelled. Ties go to fewer insertions,
    then keep, merge, relabel, then the order of ROLES.
    """
    best: list[list[tuple | None]] = [[None] * 4 for _ in range(4)]

    def offer(s: int, t: int, cost: int, inserted: tuple[str, ...], action: str, given: str) -> None:
        key = (cost, len(inserted), ("keep", "merge", "relabel", "relabel+merge").index(action), ROLES.index(given))
        if best[s][t] is None or key < best[s][t][0]:
            best[s][t] = (key, (cost, inserted, action, given))

    def walk(s: int, at: int, inserted: tuple[str, ...]) -> None:
        for given in NEXT[at]:
            same = given == role
            offer(s, ROLES.index(given) + 1, INSERT * len(inserted) + (0 if same else RELABEL), inserted, "keep" if same else "relabel", given)
            if len(inserted) < 2:
                walk(s, ROLES.index(given) + 1, (*inserted, given))

    for s in range(4):
        walk(s, s, ())
        if s:
            given = ROLES[s - 1]
            same = given == role
            offer(s, s, MERGE + (0 if same else RELABEL), (), "merge" if same else "relabel+merge", given)
    return tuple(tuple(None if b is None else b[1] for b in row) for row in best)


def closing(state: int, needs_reply: bool) -> tuple[int, tuple[str, ...]]:
    """Cost and empty turns to end in ``state``: an unanswered user turn gets a reply."""
    return (INSERT, ("assistant",)) if needs_reply and state == 2 else (0, ())


def summary(roles: list[str | None]) -> list[int]:
    """4 x 4 costs of a run of turns from each state to each; such matrices compose."""
    total = [[0 if s == t else FAR for t in range(4)] for s in range(4)]
    for role in roles:
        step = moves(role)
        total = [[min((row[m] + step[m][t][0] for m in range(4) if row[m] < FAR and step[m][t] is not None), default=FAR)
                  for t in range(4)] for row in total]
    return [c for row in total for c in row]


def plan(roles: list[str | None], start: int, end: int | None, needs_reply: bool) -> list[tuple[int, tuple[int, tuple[str, ...], str, str]]]:
    """(state before, move) per turn of a cheapest path from ``start`` to ``end``, or to any state
    with its closing cost; ties go to the lower state, seen from the end."""
    costs = [[FAR] * 4]
    costs[0][start] = 0
    for role in roles:
        step = moves(role)
        costs.append([min((costs[-1][m] + step[m][t][0] for m in range(4) if costs[-1][m] < FAR and step[m][t] is not None), default=FAR)
                      for t in range(4)])
    state = end if end is not None else min(range(4), key=lambda t: (costs[-1][t] + closing(t, needs_reply)[0], t))
    out = []
    for i in range(len(roles) - 1, -1, -1):
        step = moves(roles[i])
        before = next(m for m in range(4) if costs[i][m] < FAR and step[m][state] is not None and costs[i][m] + step[m][state][0] == costs[i + 1][state])
        out.append((before, step[before][state]))
        state = before
    return out[::-1]


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[-1][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _chain(segments: DataFrame, needs_reply: bool) -> DataFrame:
    """Entry and exit state of each part of the conversations that lie in several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _runs(batches, ("conv_id",)):
            if len(rows) == 1:
                continue
            costs = [[0, FAR, FAR, FAR]]
            for r in rows:
                c = r["costs"]
                costs.append([min(min(costs[-1][m] + c[4 * m + t] for m in range(4)), FAR) for t in range(4)])
            state = min(range(4), key=lambda t: (costs[-1][t] + closing(t, needs_reply)[0], t))
            for i in range(len(rows) - 1, -1, -1):
                c = rows[i]["costs"]
                before = next(m for m in range(4) if costs[i][m] + c[4 * m + state] == costs[i + 1][state])
                out.append({"conv_id": rows[i]["conv_id"], "part": rows[i]["part"], "entry": before, "leave": state, "last": i == len(rows) - 1})
                state = before
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())]))

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        run, "conv_id bigint, part int, entry int, leave int, last boolean")


def render(turns: DataFrame, needs_reply: bool = True) -> DataFrame:
    """One row per turn: conv_id, turn, place, action, role, inserted (roles of empty turns put before
    it), cost, rendered.

    The rendered pieces of a conversation in the order of ``place``, concatenated, are its
    rendering: a kept or relabelled turn closes the one before and opens its own, a merged
    one continues on a new line, the last one adds a missing reply and closes.

    Turns are range-partitioned by conversation and turn, so a conversation that holds a
    third of all rows is spread over tasks. Each part gives its 4 x 4 cost matrix; only
    matrices of conversations cut by a part boundary, at most two a part, are chained, and
    every part is then decoded by itself. Equal turn numbers are ordered by the hash of
    role and text; null conv_ids are one conversation, a null turn comes first, a null text
    is empty, and null or unknown roles are relabelled. No rows give no rows.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.lower(F.trim("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "_tie"]
    ranged = rows.withColumn("_tie", F.xxhash64("role", "text")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"),
                                  F.monotonically_increasing_id().alias("place")), "turns")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [{"conv_id": g[0]["conv_id"], "part": g[0]["part"], "costs": summary([r["role"] for r in g])} for g in _runs(batches, ("conv_id", "part"))]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("costs", pa.list_(pa.int64()))]))

    bounds = placed.groupBy("part").agg(F.min_by("conv_id", "place").alias("first"), F.max_by("conv_id", "place").alias("final"))
    edge = placed.select("conv_id", "part", "place", "role").join(F.broadcast(bounds), "part").where(
        F.col("conv_id").eqNullSafe(F.col("first")) | F.col("conv_id").eqNullSafe(F.col("final"))).drop("first", "final")
    segments = edge.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(summed, "conv_id bigint, part int, costs array<bigint>")
    states = durable(_chain(segments, needs_reply))
    schema = "conv_id bigint, turn bigint, place bigint, action string, role string, inserted array<string>, cost int, rendered string"

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("action", pa.string()), ("role", pa.string()),
                            ("inserted", pa.list_(pa.string())), ("cost", pa.int32()), ("rendered", pa.string())])
        out: list[dict] = []
        for g in _runs(batches, ("conv_id", "part")):
            entry, leave = g[0]["entry"] or 0, g[0]["leave"]
            ends = g[0]["last"] is not False
            steps = plan([r["role"] for r in g], entry, leave, needs_reply)
            for i, (row, (before, (cost, inserted, action, given))) in enumerate(zip(g, steps, strict=True)):
                text = ""
                live = before
                for role in inserted:
                    text += (CLOSE if live else "") + OPEN.format(role=role)
                    live = ROLES.index(role) + 1
                text += "\n" + row["text"] if "merge" in action else (CLOSE if live else "") + OPEN.format(role=given) + row["text"]
                if ends and i == len(g) - 1:
                    more, tail = closing(ROLES.index(given) + 1, needs_reply)
                    cost += more
                    text += "".join(CLOSE + OPEN.format(role=r) for r in tail) + CLOSE
                out.append({"conv_id": row["conv_id"], "turn": row["turn"], "place": row["place"], "action": action, "role": given,
                            "inserted": list(inserted), "cost": cost, "rendered": text})
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out = []
        yield pa.RecordBatch.from_pylist(out, fields)

    told = placed.join(F.broadcast(states.withColumnRenamed("conv_id", "_c").withColumnRenamed("part", "_p")),  # two rows a part at most
                       F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left").drop("_c", "_p")
    return told.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(decoded, schema)


def conversation_texts(rendered: DataFrame) -> DataFrame:
    """(conv_id, text): whole renderings, for tables whose conversations each fit in a cell."""
    pieces = F.sort_array(F.collect_list(F.struct("place", "rendered")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["rendered"]), "").alias("text"))
