"""Merkle manifest of a data set: digests of rows, of runs of eight and so on up to one root, and a proof for every row.

Every node carries the interval of leaf ranks it covers. Ancestors are attached by containment joins that are bucketed by level, and
the siblings of a node are what its parent's interval holds besides its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table

from .ordering import in_order
from .text import same

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIBLINGS = "array<struct<before:string,after:string>>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def row_digest(fields: list[Column]) -> Column:
    """SHA-256 of all fields: ``-`` for NULL, else the length in UTF-8 bytes, a colon and the value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return sha(*[part(f) for f in fields])


def _bucket(level: int) -> Column:
    """Number of the interval of this level that a leaf rank or a lower interval lies in."""
    return F.expr(f"lo div {FANOUT**level}")


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """Level ``level`` over nodes (tree, lo, hi, level, digest): runs of ``FANOUT`` intervals in order become one, with their children kept."""
    children = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children")
    grown = nodes.groupBy("tree", "level", _bucket(level).alias("bucket")).agg(children)
    return grown.select("tree", F.element_at("children", 1)["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), (F.col("level") + 1).alias("level"),
                        sha(F.array_join(F.col("children")["digest"], "")).alias("digest"), "children")


def _tree(nodes: DataFrame, sizes: DataFrame) -> list[DataFrame]:
    """Levels above the leaves, lowest first; a tree stops at its first level of one node. ``sizes`` has (tree, n_leaves)."""
    levels, most, width = [], sizes.agg(F.max("n_leaves")).first()[0] or 0, 1
    while width < most:
        open_trees = sizes.filter(F.col("n_leaves") > width).select("tree")
        below = nodes.select("tree", "lo", "hi", "level", "digest").join(open_trees.withColumnRenamed("tree", "open"), same(F.col("tree"), F.col("open")), "left_semi")
        nodes = persist_table(_parents(below, len(levels) + 1))
        levels.append(nodes)
        width *= FANOUT
    return levels


def _siblings(children: Column, lo: Column, hi: Column) -> Column:
    """What the parent's interval holds besides [lo, hi): digests before it and after it."""
    left = F.array_join(F.filter(children, lambda c: c["hi"] <= lo)["digest"], "")
    right = F.array_join(F.filter(children, lambda c: c["lo"] >= hi)["digest"], "")
    return F.struct(left.alias("before"), right.alias("after"))


def _attach(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """Nodes of one level with ``path``, their siblings from here to the root; a node without parent in its tree takes the path of its tree's root.

    The containment join is bucketed: an interval of this level can only lie in the one interval of the next that starts its bucket.
    """
    bucket = _bucket(level + 1)
    over = parents.select(F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("children").alias("p_children"), F.col("path").alias("p_path"), bucket.alias("p_bucket"))
    inside = same(F.col("tree"), F.col("p_tree")) & (bucket == F.col("p_bucket")) & (F.col("lo") >= F.col("p_lo")) & (F.col("hi") <= F.col("p_hi"))
    path = F.concat(F.array(_siblings(F.col("p_children"), F.col("lo"), F.col("hi"))), F.col("p_path"))
    return nodes.join(over, inside).select(*nodes.columns, path.alias("path"))


def _paths(levels: list[DataFrame], roots: DataFrame) -> DataFrame | None:
    """The lowest level above the leaves with ``path``. ``roots`` has (root_tree, root_level, root_path) for every tree."""
    above = None
    for k in range(len(levels), 0, -1):
        nodes = levels[k - 1]
        tops = nodes.join(roots, same(F.col("tree"), F.col("root_tree")) & (F.col("level") == F.col("root_level"))).select(*nodes.columns, F.col("root_path").alias("path"))
        above = persist_table(tops if above is None else tops.unionByName(_attach(nodes, above, k)))
    return above


def _one_tree(leaves: DataFrame, sizes: DataFrame, roots: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Leaves with ``path``, and the root of every tree (tree, level, digest). ``roots`` turns the latter into the roots' paths."""
    levels = _tree(leaves, sizes)
    tops = sizes.select(F.col("tree").alias("t"), sum((F.col("n_leaves") > FANOUT**k).cast("int") for k in range(21)).alias("height"))
    nodes = leaves.select("tree", "lo", "level", "digest")
    for level in levels:
        nodes = nodes.unionByName(level.select("tree", "lo", "level", "digest"))
    top = persist_table(nodes.filter("lo = 0").join(tops, same(F.col("tree"), F.col("t")) & (F.col("level") == F.col("height"))).select("tree", "level", "digest"))
    given = roots(top)
    alone = leaves.join(given.filter("root_level = 0"), same(F.col("tree"), F.col("root_tree"))).select(*leaves.columns, F.col("root_path").alias("path"))
    above = _paths(levels, given)
    return (alone if above is None else _attach(leaves, above, 0).unionByName(alone)), top


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, leaf, subroot (of its language), root, and ``path``, its siblings level by level up to the root.

    Leaves of a language ascend by doc_id (NULL first); equal identifiers by leaf digest. Every 8 consecutive nodes become the digest of their digests until one is
    left, the subroot; subroots in the order of their languages (NULL first, by UTF-8 bytes) become the root in the same way. ``path`` holds
    per level the digests before and after the node in its run, each joined to one string, empty where there is none. NULLs in
    any field are told apart from empty values, repeated rows are leaves of their own, long texts are hashed whole, an empty
    table gives no row. Also kept: ``altered``, the leaf of the row with its text in lower case (A to Z).

    Ranks come from one range sort, so a language may hold any share of the rows. A level is a written table an eighth of the size
    of the one below; paths go from the top down, so all joins but the last one are on an eighth of the rows or less.
    """
    fields = [F.col(c) for c in FIELDS]
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, row_digest([*fields[:4], F.translate("text", UPPER, LOWER)]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("tree"), row_digest(fields).alias("digest"), altered.alias("altered"))
    ranked = in_order(persist_table(rows.withColumn("row", F.monotonically_increasing_id())), "tree", ["doc_id", "digest", "row"])
    leaves = persist_table(ranked.select("doc_id", "tree", (F.col("pos") - 1).alias("lo"), F.col("pos").alias("hi"), F.lit(0).alias("level"), "digest", "altered"))
    sizes = persist_table(leaves.groupBy("tree").agg(F.count("*").alias("n_leaves")))
    whole = []

    def roots(subroots: DataFrame) -> DataFrame:
        """The same tree over the subroots; languages may be many."""
        order = in_order(subroots.select(F.lit(1).alias("all"), F.col("tree").alias("lang"), "level", "digest"), "all", ["lang"])
        tops = persist_table(order.select(F.lit("").alias("tree"), (F.col("pos") - 1).alias("lo"), F.col("pos").alias("hi"), F.lit(0).alias("level"), "digest", "lang", F.col("level").alias("sub_level")))
        count = persist_table(tops.groupBy("tree").agg(F.count("*").alias("n_leaves")))
        nothing = F.array().cast(SIBLINGS)
        made, top = _one_tree(tops, count, lambda t: t.select(F.col("tree").alias("root_tree"), F.col("level").alias("root_level"), nothing.alias("root_path")))
        whole.append(top.select(F.col("digest").alias("root")))
        return persist_table(made.select(F.col("lang").alias("root_tree"), F.col("sub_level").alias("root_level"), F.col("path").alias("root_path")))

    made, subroots = _one_tree(leaves, sizes, roots)
    root = whole[0].first()
    named = made.join(subroots.select(F.col("tree").alias("s_tree"), F.col("digest").alias("subroot")), same(F.col("tree"), F.col("s_tree")))
    return named.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root.root if root else None).cast("string").alias("root"), "path", "altered")


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return sha(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: sha(s["before"], node, s["after"]))


def verify(manifest: DataFrame) -> DataFrame:
    """Rows of a manifest with proof_sha256, folded_root (from ``altered`` where it is given, else from the leaf) and verified."""
    checked = manifest.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return checked.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string expression, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256({})"


def _leaf_sql(text: str) -> str:
    return _LEAF.format(" || ".join(_FIELD.format(f) for f in ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]))


ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leaves),
tree AS (
  SELECT lang, 0 AS level, r, leaf AS digest, count(*) OVER (PARTITION BY lang) AS width FROM ranked
  UNION ALL
  SELECT lang, level + 1, r // {FANOUT}, sha256(string_agg(digest, '' ORDER BY r)), any_value((width + {FANOUT - 1}) // {FANOUT})
  FROM tree WHERE width > 1 GROUP BY lang, level, r // {FANOUT}),
subs AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS s FROM tree WHERE width = 1),
crown AS (
  SELECT 0 AS level, s, digest, count(*) OVER () AS width FROM subs
  UNION ALL
  SELECT level + 1, s // {FANOUT}, sha256(string_agg(digest, '' ORDER BY s)), any_value((width + {FANOUT - 1}) // {FANOUT})
  FROM crown WHERE width > 1 GROUP BY level, s // {FANOUT}),
height AS (SELECT lang, max(level) AS h FROM tree GROUP BY lang),
sides AS (
  SELECT k.doc_id, k.lang, k.r, k.leaf, t.level,
    coalesce(string_agg(t.digest, '' ORDER BY t.r) FILTER (t.r < k.r // CAST({FANOUT}::BIGINT ** t.level AS BIGINT)), '') AS before,
    coalesce(string_agg(t.digest, '' ORDER BY t.r) FILTER (t.r > k.r // CAST({FANOUT}::BIGINT ** t.level AS BIGINT)), '') AS after
  FROM ranked k JOIN tree t ON t.lang IS NOT DISTINCT FROM k.lang AND t.width > 1 AND t.r // {FANOUT} = k.r // CAST({FANOUT}::BIGINT ** (t.level + 1) AS BIGINT)
  GROUP BY ALL
  UNION ALL
  SELECT k.doc_id, k.lang, k.r, k.leaf, h.h + c.level,
    coalesce(string_agg(c.digest, '' ORDER BY c.s) FILTER (c.s < u.s // CAST({FANOUT}::BIGINT ** c.level AS BIGINT)), ''),
    coalesce(string_agg(c.digest, '' ORDER BY c.s) FILTER (c.s > u.s // CAST({FANOUT}::BIGINT ** c.level AS BIGINT)), '')
  FROM ranked k JOIN subs u ON u.lang IS NOT DISTINCT FROM k.lang JOIN height h ON h.lang IS NOT DISTINCT FROM k.lang
  JOIN crown c ON c.width > 1 AND c.s // {FANOUT} = u.s // CAST({FANOUT}::BIGINT ** (c.level + 1) AS BIGINT)
  GROUP BY ALL),
paths AS (SELECT lang, r, list({{'before': before, 'after': after}} ORDER BY level) AS path FROM sides GROUP BY lang, r),
done AS (
  SELECT k.doc_id, k.leaf, u.digest AS subroot, (SELECT digest FROM crown WHERE width = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(p.path, lambda x: x.before || x.after), ''), '')) AS proof_sha256,
    list_reduce(list_prepend({{'before': coalesce(k.altered, k.leaf), 'after': ''}}, coalesce(p.path, [])),
      lambda n, x: {{'before': sha256(x.before || n.before || x.after), 'after': ''}}).before AS folded_root
  FROM ranked k JOIN subs u ON u.lang IS NOT DISTINCT FROM k.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM k.lang AND p.r = k.r)
SELECT *, folded_root = root AS verified FROM done"""
