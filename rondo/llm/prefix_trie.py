"""Prefix trie over conversations, built as a z-fast trie of compacted nodes.

A conversation is a sequence of turns; its prefixes are told apart by 128-bit digests, running exclusive ors of the digests of (place, turn).
A compacted node has an extent (the longest prefix all its members share) and lies under its parent's extent, of length a; it is filed
under the digest of its handle, the prefix whose length is the two-fattest number of (a, extent]. A fat binary search over handles finds a conversation's exit
node in a logarithmic number of joins. Conversations are inserted in batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table

from .merkle import crc32_sql
from .ordering import in_order
from .text import words

FIRST_SHARE = 8  # the first batch is about one of so many conversations
BUCKET = 64  # depths that share a bucket when edges are expanded
CHUNK = 512  # identifiers hashed at a time
NODE = ["b", "p", "q"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """Per turn its conversation, place (pos, from 1; turn NULL first, equal turns by their digests), digest (a, b) and number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(F.lit(0), role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.size(words(text)).cast("long").alias("words"))
    return in_order(rows, "conv", ["turn", "a", "b"]).select("conv", "pos", "a", "b", "words")


def with_shared_heads(turns: DataFrame, width: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their ``width``: (turns, conversations).

    Conversation c takes the first h turns of c - c % width (fewer if it has fewer) in place of its own, h being the CRC-32 of its decimal modulo ``longest``.
    """
    turns = persist_table(turns)
    h = (F.crc32(F.col("conv").cast("string")) % longest).cast("long")
    convs = persist_table(turns.filter("pos = 1").select("conv", (F.col("conv") - F.col("conv") % width).alias("base"), h.alias("h")))
    heads = turns.filter((F.col("conv") % width == 0) & (F.col("pos") < longest)).withColumnRenamed("conv", "base")
    given = persist_table(convs.join(heads, "base").filter("pos <= h").select("conv", "pos", "a", "b", "words"))
    taken = given.groupBy("conv").agg(F.count("*").alias("taken"))
    place = F.col("pos") - h + F.coalesce("taken", F.lit(0))
    own = turns.filter(F.col("pos") > h).join(taken, "conv", "left").select("conv", place.alias("pos"), "a", "b", "words")
    return given.unionByName(own), convs.select("conv")


def fattest(low: Column, high: Column) -> Column:
    """The number of (low, high] that the largest power of two divides."""
    bit = F.floor(F.log2(low.bitwiseXOR(high).cast("double"))).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", high, bit), bit)


class Trie:
    """Compacted nodes (b, p, q, lead): length and digest of the extent, and a conversation that runs through it."""

    def __init__(self, paths: DataFrame):
        """``paths``: conv, d, p, q, the digests of all prefixes of the conversations to insert."""
        self.paths, self.spark = paths, paths.sparkSession
        self.nodes = self.spark.createDataFrame([], "b long, p long, q long, lead long")
        self.pairs: DataFrame | None = None

    def at(self, rows: DataFrame, conv: str, depth: Column, names: dict[str, str], how: str = "inner") -> DataFrame:
        """``rows`` with columns of the prefix of ``conv`` at ``depth``."""
        prefix = self.paths.select(F.col("conv").alias("_conv"), F.col("d").alias("_d"), *[F.col(c).alias(n) for c, n in names.items()])
        return rows.join(prefix, (F.col(conv) == F.col("_conv")) & (depth == F.col("_d")), how).drop("_conv", "_d")

    def insert(self, batch: DataFrame) -> None:
        """Insert distinct sequences (x, n, ep, eq): conversation, length from 1, digest of all of it."""
        batch = persist_table(batch)
        if self.pairs is None:
            there = self.at(batch, "x", F.lit(1), {"p": "np", "q": "nq"})
            made, state = self._new_leaves(there.withColumn("nd", F.lit(1).cast("long")))
        else:
            located = self._locate(batch)
            along = located.filter("lead is not null").select("x", "n", "ep", "eq", "m", "lead")
            fresh, new_state = self._new_leaves(located.filter("lead is null and m < n").select("x", "n", "ep", "eq", F.col("nd"), "np", "nq"))
            made, state = fresh, persist_table(along.unionByName(new_state))
        parts = [self.nodes, made]
        while state.limit(1).count():
            splits, made, state = self._round(state)
            parts += [splits, made]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        self.nodes = persist_table(union.groupBy(*NODE).agg(F.min("lead").alias("lead")))
        self.pairs = persist_table(self._ancestors())

    def _new_leaves(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One leaf per class of sequences that leave the trie at one node by one turn, whose prefix of ``nd`` turns has digest (np, nq).

        The class's leaf is drawn by hash, so that what others share with it halves their class on average; they go on along its edge.
        """
        rows = persist_table(rows.withColumn("cls", F.struct("nd", "np", "nq")))
        chosen = rows.groupBy("cls").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x", "n", "ep", "eq")).alias("c"))
        chosen = persist_table(chosen.select(F.col("cls").alias("c_cls"), "c.*").withColumnRenamed("x", "lead"))
        leaves = chosen.select(F.col("n").alias("b"), F.col("ep").alias("p"), F.col("eq").alias("q"), "lead")
        rest = rows.join(chosen.select("c_cls", "lead"), F.col("cls") == F.col("c_cls")).filter("x != lead")
        return leaves, persist_table(rest.select("x", "n", "ep", "eq", F.col("nd").alias("m"), "lead"))

    def _round(self, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Sequences that share ``m`` turns with ``lead``: where each leaves its edge, the nodes there, and leaves for what goes on elsewhere."""
        mine = self.paths.select(F.col("conv").alias("x_"), "d", "p", "q")
        rows = state.join(mine, (F.col("x") == F.col("x_")) & (F.col("d") >= F.col("m"))).select("x", "n", "ep", "eq", "lead", "d", "p", "q")
        rows = self.at(rows, "lead", F.col("d"), {"p": "lp", "q": "lq"}, "left")
        alike = F.coalesce((F.col("p") == F.col("lp")) & (F.col("q") == F.col("lq")), F.lit(False))
        place = F.struct("d", "p", "q")
        left = persist_table(rows.groupBy("x", "n", "ep", "eq").agg(F.max(F.when(alike, place)).alias("last"), F.min(F.when(~alike, place)).alias("next")))
        splits = left.select(F.col("last.d").alias("b"), F.col("last.p").alias("p"), F.col("last.q").alias("q"), F.col("x").alias("lead"))
        on = left.filter("next is not null").select("x", "n", "ep", "eq", F.col("next.d").alias("nd"), F.col("next.p").alias("np"), F.col("next.q").alias("nq"))
        made, rest = self._new_leaves(on)
        return splits, made, rest

    def _ancestors(self) -> DataFrame:
        """Every node with every node on its path, itself included: (b, p, q, lead) and (ab, ap, aq)."""
        over = self.nodes.select(F.col("b").alias("ab"), F.col("p").alias("ap"), F.col("q").alias("aq"))
        path = self.paths.select(F.col("conv").alias("conv_"), F.col("d").alias("d_"), F.col("p").alias("p_"), F.col("q").alias("q_"))
        down = self.nodes.join(path, (F.col("lead") == F.col("conv_")) & (F.col("d_") <= F.col("b")))
        on_path = (F.col("d_") == F.col("ab")) & (F.col("p_") == F.col("ap")) & (F.col("q_") == F.col("aq"))
        return down.join(over, on_path).select(*NODE, "lead", "ab", "ap", "aq")

    def edges(self) -> DataFrame:
        """Nodes with ``a``, the length of the parent's extent (0 under the root)."""
        above = F.max(F.when(F.col("ab") < F.col("b"), F.col("ab")))
        return self.pairs.groupBy(*NODE, "lead").agg(F.coalesce(above, F.lit(0)).alias("a"))

    def handles(self) -> DataFrame:
        """Edges with their handle (f, hp, hq) and their first turn's prefix (kp, kq)."""
        found = self.edges().withColumn("f", fattest(F.col("a"), F.col("b")))
        found = self.at(found, "lead", F.col("f"), {"p": "hp", "q": "hq"})
        return persist_table(self.at(found, "lead", F.col("a") + 1, {"p": "kp", "q": "kq"}))

    def _locate(self, batch: DataFrame) -> DataFrame:
        """The exit of every sequence by fat binary search: ``m`` turns surely shared, and ``lead`` of the edge it leaves (NULL: it leaves at a node).

        A handle that is met and whose extent is a prefix too raises the lower bound to the extent; one whose extent is not is the exit
        edge; one that is not met lowers the upper bound.
        """
        handles = self.handles()
        by_handle = handles.select("f", "hp", "hq", F.col("b").alias("e_b"), F.col("p").alias("e_p"), F.col("q").alias("e_q"), F.col("lead").alias("e_lead"))
        by_turn = handles.select((F.col("a") + 1).alias("k_d"), "kp", "kq", F.col("lead").alias("k_lead"))
        columns = ["x", "n", "ep", "eq", "low", "high", "lead"]
        is_open = "low < high and lead is null"
        state = persist_table(batch.select("x", "n", "ep", "eq", F.lit(0).cast("long").alias("low"), F.col("n").alias("high"), F.lit(None).cast("long").alias("lead")))
        settled = [state.filter(f"not ({is_open})")]
        while state.limit(1).count():
            probe = self.at(state.withColumn("at", fattest(F.col("low"), F.col("high"))), "x", F.col("at"), {"p": "sp", "q": "sq"})
            met = probe.join(by_handle, (F.col("at") == F.col("f")) & (F.col("sp") == F.col("hp")) & (F.col("sq") == F.col("hq")), "left")
            met = self.at(met, "x", F.col("e_b"), {"p": "xp", "q": "xq"}, "left")
            whole = F.coalesce((F.col("xp") == F.col("e_p")) & (F.col("xq") == F.col("e_q")), F.lit(False))
            hit = F.col("e_lead").isNotNull()
            low, high = F.when(whole, F.col("e_b")).when(hit, F.col("at")).otherwise(F.col("low")), F.when(hit, F.col("high")).otherwise(F.col("at") - 1)
            moved = persist_table(met.select("x", "n", "ep", "eq", low.alias("low"), high.alias("high"), F.when(hit & ~whole, F.col("e_lead")).alias("lead")).select(*columns))
            settled.append(moved.filter(f"not ({is_open})"))
            state = moved.filter(is_open)
        done = settled[0]
        for part in settled[1:]:
            done = done.unionByName(part)
        nexts = self.at(done, "x", F.when(F.col("lead").isNull(), F.col("low") + 1), {"p": "np", "q": "nq"}, "left")
        child = nexts.join(by_turn, (F.col("low") + 1 == F.col("k_d")) & (F.col("np") == F.col("kp")) & (F.col("nq") == F.col("kq")), "left")
        # on a child's edge the turn after the node is shared as well
        m = F.when(F.col("k_lead").isNotNull(), F.col("low") + 1).otherwise(F.col("low"))
        return persist_table(child.select("x", "n", "ep", "eq", m.alias("m"), F.coalesce("lead", "k_lead").alias("lead"), (F.col("low") + 1).alias("nd"), "np", "nq"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, conv) to texts of up to ``CHUNK`` identifiers."""
    for rows in batches:
        seqs, convs = rows.column("seq").to_pylist(), rows.column("conv").to_pylist()
        out, start = [], 0
        for k in range(1, len(seqs) + 1):
            if k == len(seqs) or seqs[k] != seqs[start] or k - start == CHUNK:
                out.append((seqs[start], convs[start], ",".join(map(str, convs[start:k]))))
                start = k
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["seq", "first", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts sorted by (seq, first) to one digest of every sequence's texts, joined by commas; one hash state is held."""
    seq, state = None, None
    for rows in batches:
        out = []
        for s, text in zip(rows.column("seq").to_pylist(), rows.column("text").to_pylist(), strict=True):
            if s != seq:
                if state is not None:
                    out.append((seq, state.hexdigest()))
                seq, state = s, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["seq", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([state.hexdigest()])], ["seq", "sha"])


def _ends_digests(ends: DataFrame, seqs: DataFrame) -> DataFrame:
    """Per distinct sequence (seq) the SHA-256 of the identifiers that are equal to it, ascending. Copies of one text may be any number:
    they are sorted over all partitions and joined to texts there; one task streams the texts of a sequence, as a digest needs."""
    one = seqs.filter("n_ends = 1").select("seq", F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("sha"))
    many = seqs.filter("n_ends > 1").select(F.col("seq"), F.col("n").alias("n_"), F.col("p").alias("p_"), F.col("q").alias("q_"))
    rows = ends.join(many, (F.col("n") == F.col("n_")) & (F.col("p") == F.col("p_")) & (F.col("q") == F.col("q_"))).select("seq", "conv")
    texts = persist_table(persist_table(rows).sort("seq", "conv").mapInArrow(_chunks, "seq long, first long, text string"))
    return one.unionByName(texts.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_digests, "seq long, sha string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv, pos (from 1 without gaps), a, b (digest of the turn) and words; ``convs`` every conversation once, turnless ones included. NULL conversations must be left
    out before (``turns_of`` does). Copies of a sequence are inserted once with their number. Prefixes are equal if their 128-bit digests are. No conversation: no row.

    Batches are located by fat binary search and inserted in rounds: of all that leave the trie at one place by one turn, one becomes a leaf,
    the others go on along its edge, so rounds are logarithmic in number on average. Sums over subtrees come from joins of nodes with the nodes on their paths. Edges
    are expanded at the end, each along its own conversation.
    """
    rows = turns.select("conv", F.col("pos").alias("d"), F.xxhash64("pos", "a", "b").alias("x"), F.xxhash64("b", "a", "pos").alias("y"), "words")
    ordered = in_order(rows, "conv", ["d"], sums=("words",), xors=("x", "y"))
    paths = persist_table(ordered.select("conv", "d", F.col("run_x").alias("p"), F.col("run_y").alias("q"), "words", F.col("run_words").alias("so_far")))
    last = paths.groupBy("conv").agg(F.max(F.struct("d", "p", "q")).alias("e")).withColumnRenamed("conv", "c")
    ends = convs.join(last, F.col("conv") == F.col("c"), "left").select("conv", *[F.coalesce(F.col(f"e.{c}"), F.lit(0)).cast("long").alias(n) for c, n in (("d", "n"), ("p", "p"), ("q", "q"))])
    ends = persist_table(ends)
    seqs = persist_table(ends.groupBy("n", "p", "q").agg(F.min("conv").alias("seq"), F.count("*").alias("n_ends")))
    own = persist_table(paths.join(seqs.select(F.col("seq").alias("conv")), "conv", "left_semi"))
    trie = Trie(own)
    share = F.pmod(F.xxhash64("seq", F.lit("batch")), F.lit(FIRST_SHARE)) == 0
    for part in (share, ~share):
        trie.insert(seqs.filter(part & (F.col("n") > 0)).select(F.col("seq").alias("x"), "n", F.col("p").alias("ep"), F.col("q").alias("eq")))
    return _expanded(trie, own, seqs, _ends_digests(ends, seqs))


def _expanded(trie: Trie, own: DataFrame, seqs: DataFrame, digests: DataFrame) -> DataFrame:
    """Sums over subtrees for every compacted node, then one row per depth of every edge."""
    spark = own.sparkSession
    root = spark.createDataFrame([(-1, 0, 0, 0, None, 0)], "node long, b long, p long, q long, lead long, so_far long")
    inner = persist_table(trie.nodes.withColumn("node", F.monotonically_increasing_id()))
    nodes = trie.at(inner, "lead", F.col("b"), {"so_far": "so_far"}).select(*root.columns).unionByName(root)
    ending = seqs.select(F.col("n").alias("n_"), F.col("p").alias("p_"), F.col("q").alias("q_"), "seq", "n_ends")
    same_end = (F.col("b") == F.col("n_")) & (F.col("p") == F.col("p_")) & (F.col("q") == F.col("q_"))
    nodes = persist_table(nodes.join(ending, same_end, "left").select(*root.columns, "seq", F.coalesce("n_ends", F.lit(0)).alias("n_ends")))
    key = inner.select(F.col("node"), *[F.col(c).alias(f"k{c}") for c in NODE])
    match = lambda b, p, q: (F.col(b) == F.col("kb")) & (F.col(p) == F.col("kp")) & (F.col(q) == F.col("kq"))
    pairs = trie.pairs.join(key.withColumnRenamed("node", "down"), match("b", "p", "q")).drop("kb", "kp", "kq")
    pairs = pairs.join(key.withColumnRenamed("node", "up"), match("ab", "ap", "aq")).select("down", "up", "ab")
    every = nodes.select(F.col("node").alias("down"), F.lit(-1).cast("long").alias("up"), F.lit(0).cast("long").alias("ab"))
    pairs = persist_table(pairs.unionByName(every))
    members = pairs.join(nodes.select(F.col("node").alias("down"), "seq", "n_ends"), "down").groupBy("up").agg(
        F.sum("n_ends").alias("n_convs"), F.min("seq").alias("first"), F.count("*").alias("below"))
    above = pairs.filter("down != up").groupBy("down").agg(F.max(F.struct("ab", "up")).alias("over")).select(F.col("down").alias("child"), F.col("over.up").alias("parent"))
    full = persist_table(nodes.join(members, F.col("node") == F.col("up")).drop("up").join(above, F.col("node") == F.col("child"), "left").drop("child"))
    parents = full.select(F.col("node").alias("o_node"), F.col("b").alias("a"), F.col("so_far").alias("o_so_far"), F.col("first").alias("o_first"))
    full = persist_table(full.join(parents, F.col("parent") == F.col("o_node"), "left").drop("o_node").withColumn("own_saved", (F.col("n_convs") - 1) * (F.col("so_far") - F.coalesce("o_so_far", F.lit(0)))))
    sums = pairs.join(full.select(F.col("node").alias("down"), "own_saved", (F.col("below") == 1).cast("long").alias("leaf")), "down").groupBy("up").agg(
        F.sum("leaf").alias("n_leaves"), F.sum("own_saved").alias("all_saved"))
    fanout = full.filter("parent is not null").groupBy(F.col("parent").alias("kin")).agg(F.count("*").alias("n_kids"))
    full = full.join(sums, F.col("node") == F.col("up")).drop("up").join(fanout, F.col("node") == F.col("kin"), "left").drop("kin")
    full = persist_table(full.join(digests.withColumnRenamed("seq", "e_seq"), F.col("seq") == F.col("e_seq"), "left").drop("e_seq").withColumn("n_kids", F.coalesce("n_kids", F.lit(0))))
    buckets = F.explode(F.sequence(F.floor((F.col("a") + 1) / BUCKET), F.floor(F.col("b") / BUCKET))).alias("bucket")
    spread = full.filter("node >= 0").select("*", buckets)
    steps = own.select(F.col("conv").alias("s_conv"), "d", F.floor(F.col("d") / BUCKET).alias("s_bucket"), "words", F.col("so_far").alias("s_so_far"))
    along = spread.join(steps, (F.col("lead") == F.col("s_conv")) & (F.col("bucket") == F.col("s_bucket")) & (F.col("d") > F.col("a")) & (F.col("d") <= F.col("b")))
    none = F.sha2(F.lit("").cast("binary"), 256)
    bottom = F.col("d") == F.col("b")
    rows = along.select(
        F.col("first").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("a") + 1, F.col("o_first")).otherwise(F.col("first")).alias("parent_conv_id"), "n_convs",
        F.when(bottom, F.col("n_kids")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("all_saved") - F.col("own_saved") + (F.col("n_convs") - 1) * (F.col("so_far") - F.col("s_so_far") + F.col("words"))).alias("saved_tokens"),
        F.when(bottom, F.coalesce("sha", none)).otherwise(none).alias("ends_sha256"))
    top = full.filter("node < 0 and n_convs > 0").select(
        F.col("first").alias("conv_id"), F.col("b").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("n_kids").cast("long").alias("n_children"), "n_leaves",
        F.col("all_saved").alias("saved_tokens"), F.coalesce("sha", none).alias("ends_sha256"))
    return rows.unionByName(top)


ORACLE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS base, {crc32_sql("c::VARCHAR")} % 4 AS h, count(*) AS n FROM t GROUP BY c),
rebuilt AS (
  SELECT v.c, t.k AS d, role, text FROM convs v JOIN t ON t.c = v.base AND t.k <= v.h
  UNION ALL
  SELECT v.c, t.k - v.h + least(v.h, coalesce(o.n, 0)), role, text FROM t JOIN convs v ON v.c = t.c LEFT JOIN convs o ON o.c = v.base WHERE t.k > v.h),
paths AS (
  SELECT c, d, string_agg(sha256(role || chr(1) || text), '') OVER (PARTITION BY c ORDER BY d) AS prefix, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM rebuilt
  UNION ALL
  SELECT c, 0, '', 0 FROM convs),
ends AS (SELECT d, prefix, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, max(d) AS d, max_by(prefix, d) AS prefix FROM paths GROUP BY c) GROUP BY d, prefix),
nodes AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM paths GROUP BY d, prefix),
kids AS (SELECT d - 1 AS d, left(prefix, 64 * (d - 1)) AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
sums AS (
  SELECT p.d, p.prefix, sum((k.n IS NULL)::BIGINT) AS n_leaves, sum((u.n_convs - 1) * u.w) AS saved
  FROM nodes u JOIN paths p ON p.c = u.conv_id AND p.d <= u.d LEFT JOIN kids k ON k.d = u.d AND k.prefix = u.prefix
  GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
  coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.prefix = n.prefix LEFT JOIN nodes o ON o.d = n.d - 1 AND o.prefix = left(n.prefix, 64 * (n.d - 1))
LEFT JOIN kids k ON k.d = n.d AND k.prefix = n.prefix LEFT JOIN ends e ON e.d = n.d AND e.prefix = n.prefix"""
