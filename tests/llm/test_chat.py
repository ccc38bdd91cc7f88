"""Role repair against exhaustive search."""

import random
from collections import defaultdict

import pyarrow as pa

from rondo.llm import chat_format
from rondo.llm.chat_format import INSERT, LEGAL, MERGE, RELABEL, ROLES, START, UNKNOWN, repair_conversations

CODE = {r: i for i, r in enumerate(ROLES)}
SCHEMA = "conv_id long, turn long, role string, text string"


def change(role, to):
    code = CODE.get(role, 3)
    return 0 if to == code else UNKNOWN if code == 3 else RELABEL


def cheapest(roles):
    best = [10**9]

    def walk(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = cost
            return
        if state != START:
            walk(i + 1, state, cost + MERGE + change(roles[i], state))

        def fill(s, n):
            for t in range(3):
                if (s, t) in LEGAL:
                    walk(i + 1, t, cost + n * INSERT + change(roles[i], t))
                    if n < 3:
                        fill(t, n + 1)

        fill(state, 0)

    walk(0, START, 0)
    return best[0]


def test_repairs_are_legal_and_cheapest_in_any_partitioning(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool"]), rng.choice(["x", "y", None])) for c in range(150) for t in range(rng.randint(1, 6))]
    rows += [(1000, t, rng.choice(["system", "user", "assistant", None]), f"z{t}") for t in range(1500)]  # spans many parts
    rows += [(None, 0, "user", "n"), (5, None, "assistant", "q"), (5, None, "assistant", "q")]
    frame = spark.createDataFrame(rows, SCHEMA)
    first = lambda v: (v is not None, v or 0)
    order = lambda r: (first(r.conv_id), first(r.turn), (r.role is not None, r.role or ""), (r.text is not None, r.text or ""))
    results = []
    for parts in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            results.append(sorted(repair_conversations(frame).collect(), key=order))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert results[0] == results[1] and len(results[0]) == len(rows)
    chats = defaultdict(list)
    for r in results[0]:
        chats[r.conv_id].append(r)
    for turns in chats.values():
        sequence, cost, state = [], 0, START
        for r in turns:
            cost += INSERT * len(r.inserted) + MERGE * (r.action == "merge") + change(r.role, CODE[r.new_role])
            sequence += [*r.inserted, *([] if r.action == "merge" else [r.new_role])]
        for role in sequence:
            assert (state, CODE[role]) in LEGAL
            state = CODE[role]
        chat = "".join(r.piece for r in turns)
        assert [p.split("\n")[0] for p in chat.split("<|im_start|>")[1:]] == sequence and chat.count("<|im_end|>") == len(sequence)
        if len(turns) < 9:
            assert cost == cheapest([r.role for r in turns])


def test_ways_followed_back_match_a_whole_table():
    """Two streams over batches of any size against the plain dynamic program with all its rows; part 1 is entered in known costs and left in a given state."""
    rng = random.Random(8)
    for roles in (["system", "user", "assistant", "user", "assistant", None], [None, "tool"], ["assistant"], ["system", "user"]):
        turns = [{"part": p, "pos": 1000 * p + k, "conv_id": k // 90, "turn": k, "role": rng.choice(roles), "text": f"t{k}"} for p in (0, 1) for k in range(400)]
        given, ends = {(1, 0): [30, 7, 9, chat_format.FAR]}, {(1, 2): 1}
        schema = pa.schema([("part", pa.int64()), ("pos", pa.int64()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        cut = lambda rows, schema, n: [pa.RecordBatch.from_pylist(rows[k : k + n], schema) for k in range(0, len(rows), n)]
        ways = [r for b in chat_format._forward(given)(iter(cut(turns, schema, 37))) for r in b.to_pylist()]
        fields = pa.RecordBatch.from_pylist(ways).schema
        got = [r for b in chat_format._backward(ends)(iter(cut(ways[::-1], fields, 53))) for r in b.to_pylist()][::-1]
        want = []
        for p in (0, 1):
            for run in range(5):
                codes = [CODE.get(t["role"], 3) for t in turns if t["part"] == p and t["conv_id"] == run]
                rows = [list(given.get((p, run), [chat_format.FAR] * 3 + [0]))]
                for c in codes:
                    rows.append([min(rows[-1][s] + chat_format.COST[c][s][t] for s in range(4)) for t in range(4)])
                state = ends.get((p, run), min(range(4), key=lambda s: rows[-1][s]))
                states = [state]
                for k in range(len(codes) - 1, -1, -1):
                    states.append(min(range(4), key=lambda s: rows[k][s] + chat_format.COST[codes[k]][s][states[-1]]))
                want += [chat_format.MOVES[c][a][b][1:] for c, a, b in zip(codes, states[:0:-1], states[-2::-1], strict=True)]
        assert [(r["action"], ROLES.index(r["new_role"]), tuple(map(ROLES.index, r["inserted"]))) for r in got] == want


def test_empty_table_and_extra_columns(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([(1, 0, "assistant", "hi", 5, 6)], SCHEMA + ", part long, pos long")
    row = repair_conversations(wide).first()
    assert (row.inserted, row.new_role, row.action) == (["user"], "assistant", "keep")
    assert row.piece == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
