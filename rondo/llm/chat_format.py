"""Chat formatting: conversations are repaired at least cost by dynamic programming over an automaton of legal turns, then rendered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table

ROLES = ["system", "user", "assistant"]
START = 3  # states are the role of the last turn put out, or START
LEGAL = {(START, 0), (START, 1), (0, 1), (1, 2), (2, 1)}  # the system first if at all, then user and assistant in turn
#: Costs of repairs (parameters in whole numbers, so that sums compare exactly).
MERGE, RELABEL, UNKNOWN, INSERT = 2, 10, 5, 8
OPEN, CLOSE, GLUE = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
FAR = 1 << 40
Move = tuple[int, str, int, tuple[int, ...]]  # cost, action, role given, roles of empty turns put in before


def _moves() -> list[list[list[Move | None]]]:
    """The cheapest repair of a turn by role (3: any other), state before and state after."""
    fills: dict[tuple[int, int], tuple[int, ...]] = {(s, s): () for s in range(4)}
    for _ in range(3):
        for (s, t), path in list(fills.items()):
            for a, b in sorted(LEGAL):
                if a == t and ((s, b) not in fills or len(fills[s, b]) > len(path) + 1):
                    fills[s, b] = (*path, b)
    table: list[list[list[Move | None]]] = [[[None] * 4 for _ in range(4)] for _ in range(4)]
    for role in range(4):
        change = [0 if to == role else UNKNOWN if role == 3 else RELABEL for to in range(3)]
        for before in range(4):
            options: list[tuple[int, Move]] = []
            if before != START:
                options.append((before, (MERGE + change[before], "merge", before, ())))
            for (s, last), path in fills.items():
                for a, b in LEGAL:
                    if s == before and a == last:
                        action = "keep" if b == role else "relabel"
                        options.append((b, (INSERT * len(path) + change[b], action, b, path)))
            for after, move in options:
                if table[role][before][after] is None or move < table[role][before][after]:
                    table[role][before][after] = move
    return table


MOVES = _moves()
COST = np.array([[[m[0] if m else FAR for m in row] for row in table] for table in MOVES], dtype=np.int64)


BEGIN = np.array([FAR, FAR, FAR, 0], dtype=np.int64)
CODE = {r: i for i, r in enumerate(ROLES)}
BITS = 4 ** np.arange(4)
WAYS_FIELDS = "part long, pos long, conv_id long, turn long, role string, text string, run long, ways int"
EDGE_FIELDS = "part long, run long, runs long, conv_id long, costs array<long>"
EDGES = pa.schema([("part", pa.int64()), ("run", pa.int64()), ("runs", pa.int64()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.int64()))])
ENTERED = pa.schema([("part", pa.int64()), ("run", pa.int64()), ("states", pa.list_(pa.int64()))])
TURN_FIELDS = "part long, pos long, conv_id long, turn long, role string, text string, new_role string, action string, inserted array<string>, piece string"
TURNS = pa.schema([
    ("part", pa.int64()), ("pos", pa.int64()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.list_(pa.string())), ("piece", pa.string()),
])


def _marked(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple | pa.RecordBatch]:
    """Rows of sorted parts as part, number of the run of one conversation in its part, and the columns (conv_id first); after each batch the batch."""
    at, run = None, 0
    for rows in batches:
        for part, *values in zip(*[rows.column(c).to_pylist() for c in ("part", *columns)], strict=True):
            if at is None or at[0] != part:
                run = 0
            elif at[1] != values[0]:
                run += 1
            at = part, values[0]
            yield part, run, values
        yield rows


def _edges_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the first and the last conversation of a part: cost from each state at its first turn to each state at its last. One matrix is held, and a part's first."""
    part, run, conv, first, matrix = None, 0, None, None, None

    def done() -> pa.RecordBatch:
        rows = [{"part": part, "run": k, "runs": run + 1, "conv_id": c, "costs": m.ravel().tolist()} for k, c, m in ([(0, *first)] if first else []) + [(run, conv, matrix)]]
        return pa.RecordBatch.from_pylist(rows, EDGES)

    for mark in _marked(batches, ["conv_id", "role"]):
        if isinstance(mark, pa.RecordBatch):
            continue
        now, number, (conv_id, role) = mark
        if now != part:
            if part is not None:
                yield done()
            part, first, matrix = now, None, None
        elif number != run:
            first = first or (conv, matrix)
            matrix = None
        if matrix is None:
            matrix = np.where(np.eye(4, dtype=bool), 0, FAR)
        run, conv = number, conv_id
        matrix = np.minimum((matrix[:, :, None] + COST[CODE.get(role, 3)][None]).min(1), FAR)
    if part is not None:
        yield done()


def _step(costs: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of each state after a turn and the state before it on the way there; of equal costs the smallest."""
    through = costs[:, None] + COST[code]
    return np.minimum(through.min(0), FAR), through.argmin(0)


def _entering(given: dict[tuple[int, int], list[int]]):
    """For runs that go on in the next part: the state they were entered in for every state they may end in, carried along the turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, costs, origin = None, BEGIN, np.arange(4)
        for mark in _marked(batches, ["conv_id", "role"]):
            if isinstance(mark, pa.RecordBatch):
                continue
            part, number, (_, role) = mark
            if (part, number) != key:
                if key in given:
                    yield pa.RecordBatch.from_pylist([{"part": key[0], "run": key[1], "states": origin.tolist()}], ENTERED)
                key = part, number
                costs, origin = np.array(given.get(key, BEGIN), dtype=np.int64), np.arange(4)
            if key in given:
                costs, back = _step(costs, CODE.get(role, 3))
                origin = origin[back]
        if key in given:
            yield pa.RecordBatch.from_pylist([{"part": key[0], "run": key[1], "states": origin.tolist()}], ENTERED)

    return run


def _forward(given: dict[tuple[int, int], list[int]]):
    """Adds to every turn the state before it on the cheapest way to each state after it, two bits each, and the cheapest state so far (``ways``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, costs, runs, ways = None, BEGIN, [], []
        for mark in _marked(batches, ["conv_id", "role"]):
            if isinstance(mark, pa.RecordBatch):
                columns = [*(mark.column(c) for c in ("part", "pos", "conv_id", "turn", "role", "text")), pa.array(runs, pa.int64()), pa.array(ways, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "pos", "conv_id", "turn", "role", "text", "run", "ways"])
                runs, ways = [], []
                continue
            part, number, (_, role) = mark
            if (part, number) != key:
                key = part, number
                costs = np.array(given.get(key, BEGIN), dtype=np.int64)
            costs, back = _step(costs, CODE.get(role, 3))
            runs.append(number)
            ways.append(int(back @ BITS) | int(costs.argmin()) << 8)

    return run


def _backward(ends: dict[tuple[int, int], int]):
    """Repairs of turns that come last one first: the state after a turn is known, its ways tell the state before. Nothing but that state is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, 0
        for rows in batches:
            out = []
            for part, pos, number, ways, *turn in zip(*[rows.column(c).to_pylist() for c in ("part", "pos", "run", "ways", "conv_id", "turn", "role", "text")], strict=True):
                closing = ""
                if (part, number) != key:
                    key = part, number
                    state = ends.get(key, ways >> 8)
                    closing = "" if key in ends else CLOSE
                before = ways >> 2 * state & 3
                _, act, role, fills = MOVES[CODE.get(turn[2], 3)][before][state]
                piece = GLUE if act == "merge" else (CLOSE if before != START else "") + "".join(OPEN.format(ROLES[f]) + CLOSE for f in fills) + OPEN.format(ROLES[role])
                out.append((part, pos, *turn, ROLES[role], act, [ROLES[f] for f in fills], piece + (turn[3] or "") + closing))
                state = before
            if out:
                yield _turns(out)

    return run


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TURNS, strict=True)], schema=TURNS)


def _parts(numbered: DataFrame, *columns: str) -> DataFrame:
    """The columns, every part in one task in its order; only what a step needs is shuffled."""
    return numbered.select("part", "pos", *columns).repartition("part").sortWithinPartitions("part", "pos")


def _chain(edges: list, numbered: DataFrame) -> tuple[dict, dict]:
    """Costs at the start of every run that goes on from the part before, and end states of every run that goes on in the next one.

    ``edges`` has two rows a part at most, so this list grows with the number of parts and not with the data.
    """
    given, goes_on = {}, []
    for prev, row in zip(edges, edges[1:], strict=False):
        if prev.part != row.part and prev.conv_id == row.conv_id and prev.run == prev.runs - 1:
            start = np.array(given.get((prev.part, prev.run), BEGIN))
            given[row.part, row.run] = np.minimum((start[:, None] + np.array(prev.costs).reshape(4, 4)).min(0), FAR).tolist()
            goes_on.append((prev, row))
    if not goes_on:
        return {}, {}
    entered = {(r.part, r.run): r.states for r in _parts(numbered, "conv_id", "role").mapInArrow(_entering(given), "part long, run long, states array<long>").collect()}
    costs = {(r.part, r.run): np.array(r.costs).reshape(4, 4) for r in edges}
    ends: dict[tuple[int, int], int] = {}
    for prev, row in reversed(goes_on):
        here = row.part, row.run
        end = ends[here] if here in ends else int((np.array(given[here])[:, None] + costs[here]).min(0).argmin())
        ends[prev.part, prev.run] = entered[here][end]
    return given, ends


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Conversations made legal at least cost, a row per turn: conv_id, turn, role, text, new_role, action (keep, relabel, merge), inserted (roles of
    empty turns put in before it) and piece. The pieces of a conversation joined in order are its rendered chat.

    Turns are ordered by turn, role, text (NULLs first), so ties have one order. A turn may be kept, given another role, merged into the turn before, or
    preceded by empty turns; costs are the module's constants, and of equal costs the smallest states from the end win. Roles that are NULL or
    unknown are always relabelled or merged. NULL texts render as empty; rows with a NULL conv_id form one conversation; an empty table gives none.

    Rows are range-partitioned in that order, so a long conversation spreads over parts. The cheapest way through a part is a matrix of
    least costs between states; matrices of the runs at the parts' edges are chained, and each part then repairs its runs alone. Parts are streamed: going forward every turn
    gets the cheapest way to each state after it, going back from the end these are followed; a task holds one batch and one vector of costs, however long a conversation is.
    Texts are rendered as they are, also where they hold the template's own marks.
    """
    spark = turns.sparkSession
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    columns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = columns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    numbered = persist_table(dealt.select("conv_id", "turn", "role", "text", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("pos")), spark)
    edges = _parts(numbered, "conv_id", "role").mapInArrow(_edges_of_parts, EDGE_FIELDS).orderBy("part", "run").collect()
    given, ends = _chain(edges, numbered)
    ways = _parts(numbered, "conv_id", "turn", "role", "text").mapInArrow(_forward(given), WAYS_FIELDS)
    return ways.sortWithinPartitions("part", F.desc("pos")).mapInArrow(_backward(ends), TURN_FIELDS).sortWithinPartitions("part", "pos").drop("part", "pos")
