"""The prefix trie against a brute-force tree, its search against plain prefix sets, and positions in groups of any size."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rondo.llm import prefix_trie as module
from rondo.llm.ordering import in_order
from rondo.llm.prefix_trie import Trie, fattest, prefix_trie, turns_of, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    whole = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}
    out = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = whole.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def brute(convs):
    """Every node by its definition."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    out = []
    for k, cs in members.items():
        below, leaves, saved = [k], 0, 0
        while below:
            u = below.pop()
            below += kids.get(u, [])
            leaves += u not in kids
            saved += (len(members[u]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", u[-1][1])) if u else 0
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(k))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(kids.get(k, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(frame):
    rows = prefix_trie(*with_shared_heads(turns_of(frame)))
    assert rows.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, rows.collect()), key=str)


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 3)
    monkeypatch.setattr(module, "BUCKET", 4)
    rng = random.Random(2)
    rows = []
    for c in [*range(90), 400, 401, 423, -7]:  # few turns to choose from: many shared prefixes, copies, prefixes of others; 400 to 423 lack or have a first one
        n = rng.choice([1, 1, 2, 3, 5, 9, 33])
        for t in range(n):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "a b", "c", None])))
    rows += [(None, 0, "user", "no conversation"), (400, 50, "user", "x " * 50_000)]
    for c in range(1000, 1060):  # copies of one conversation
        rows += [(c, t, "user", "same words here") for t in range(6)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(7).alias(c) for c in ("pos", "conv", "words", "a", "node", "lead")])
    assert trie_of(frame) == brute(rebuilt(rows))
    assert trie_of(frame.limit(0)) == []


def test_given_conversations(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert trie_of(frame) == brute(rebuilt([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]))


def test_fat_binary_search_finds_every_exit(spark):
    """Nodes of a first batch, then strangers: each shares exactly ``m`` turns at least, and its edge is the one that a plain search finds."""
    rng = random.Random(9)
    words = [tuple(rng.choice("ab") if rng.random() < 0.5 else "a" for _ in range(rng.randint(1, 40))) for _ in range(160)]
    words = sorted(set(words), key=lambda w: (hashlib.md5(str(w).encode()).digest()))
    code = lambda w: int.from_bytes(hashlib.md5(str(w).encode()).digest()[:8], "big", signed=True)
    paths = spark.createDataFrame([(i, d, code(w[:d]), code(w[:d]) ^ 5) for i, w in enumerate(words) for d in range(1, len(w) + 1)], "conv long, d long, p long, q long")
    seqs = spark.createDataFrame([(i, len(w), code(w), code(w) ^ 5) for i, w in enumerate(words)], "x long, n long, ep long, eq long")
    half = len(words) // 2
    trie = Trie(paths)
    trie.insert(seqs.filter(F.col("x") < half))
    prefixes = lambda ws: {w[:d] for w in ws for d in range(1, len(w) + 1)}

    def compacted(ws):
        every = prefixes(ws)
        return {p for p in every if p in ws or sum((*p, c) in every for c in "ab") > 1}

    assert {(r.b, r.p) for r in trie.nodes.collect()} == {(len(p), code(p)) for p in compacted(set(words[:half]))}
    nodes, there = compacted(set(words[:half])), prefixes(words[:half])
    for r in trie._locate(seqs.filter(F.col("x") >= half)).collect():
        w = words[r.x]
        shared = max([d for d in range(len(w) + 1) if not d or w[:d] in there])
        at_node = max([d for d in range(len(w) + 1) if not d or w[:d] in nodes])
        if r.lead is None:
            assert shared == at_node == r.m
        else:
            assert at_node < r.m <= shared and words[r.lead][:shared] == w[:shared]
    trie.insert(seqs.filter(F.col("x") >= half))
    assert {(r.b, r.p) for r in trie.nodes.collect()} == {(len(p), code(p)) for p in compacted(set(words))}


def test_two_fattest_number(spark):
    want = [(a, b, max(range(a + 1, b + 1), key=lambda k: k & -k)) for a in range(0, 70) for b in range(a + 1, 75)]
    got = spark.createDataFrame(want, "a long, b long, f long").withColumn("g", fattest(F.col("a"), F.col("b")))
    assert got.filter("f != g").count() == 0


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_positions_across_partitions(spark, parts):
    """One group holds most rows and takes many partitions; NULL is a group as well."""
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), k, rng.randint(-9, 9), rng.randint(0, 1 << 60)) for k in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = in_order(spark.createDataFrame(rows, "g long, k long, v long, x long"), "g", ["k"], sums=("v",), xors=("x",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    run, want = {}, {}
    for g, k, v, x in sorted(rows, key=lambda r: r[1]):
        n, s, y = run.get(g, (0, 0, 0))
        run[g] = want[k] = (n + 1, s + v, y ^ x)
    assert {r.k: (r.pos, r.run_v, r.run_x) for r in got} == want
