"""Column expressions shared by the text operators (native functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table, written_bytes

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SHINGLE = 5
BLOCK = 64


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it.

    A lambda that captures an expression evaluates it anew for every element; a lambda variable is a plain read.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Maximal runs of characters other than space, tab and line ends; NULL or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def shingle_hashes(found: Column, width: int = SHINGLE) -> Column:
    """Distinct hashes of all runs of ``width`` words; fewer words make one shingle of them all, none make none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - F.lit(width)), lambda i: F.xxhash64(*[w[i + F.lit(k)] for k in range(width)]))
        short = F.array(F.xxhash64(F.lit("short"), F.concat_ws(" ", w)))
        return F.when(n >= width, F.array_distinct(runs)).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))

    return bind(found, of)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def prefix_sums(values: Column) -> Column:
    """For each position the sum of all earlier values, in blocks so that long arrays stay cheap."""

    def of(a: Column) -> Column:
        last = F.floor((F.size(a) - 1) / BLOCK).cast("int")
        blocks = F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        return bind(blocks, lambda bs: bind(F.transform(bs, total), lambda sums: F.flatten(F.transform(bs, lambda x, b: bind(
            total(F.slice(sums, F.lit(1), b)), lambda base: F.transform(x, lambda _, i: base + total(F.slice(x, F.lit(1), i))))))))

    return F.coalesce(bind(values.cast("array<bigint>"), of), F.array().cast("array<bigint>"))


def regex_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as structs of start, end (code points, end exclusive), match and one group.

    The gaps between matches come from ``split``; running lengths of gaps and matches give the places.
    """

    def of(matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), F.length)
        lens = F.transform(matches, F.length)
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
        return bind(gaps, lambda g: bind(groups, lambda v: bind(prefix_sums(F.zip_with(g, lens, lambda x, y: x + y)), lambda before: F.transform(
            matches, lambda m, i: F.struct((before[i] + g[i]).alias("s"), (before[i] + g[i] + F.length(m)).alias("e"), m.alias("m"), v[i].alias("v"))))))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """Identifier, text and the named columns only: whatever else a table carries cannot clash."""
    return docs.select("doc_id", "text", *more)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def own_keys(docs: DataFrame, ordered: bool = False) -> tuple[DataFrame, str]:
    """The documents in a written table with a key of its own for every row, and the name of the key (no column of the documents).

    Ordered keys rise with the identifier, NULL last; rows that share one are told apart in the order they are read.
    """
    key = "own_key"
    while key in docs.columns:
        key += "_"
    if ordered:
        docs = docs.withColumn(key, F.monotonically_increasing_id()).sort(F.col("doc_id").asc_nulls_last(), key).drop(key)
    return persist_table(docs.withColumn(key, F.monotonically_increasing_id())), key


def row_keys(docs: DataFrame, ordered: bool = False) -> tuple[DataFrame, str]:
    """The documents and the name of a column that is a key of every row: the identifier where it is one, else ``own_keys``.

    Only identifiers are looked at; the documents are copied only if one is NULL or shared.
    """
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1).count():
        return docs, "doc_id"
    return own_keys(docs, ordered)


def small(written: DataFrame, most: int = 16 << 20) -> DataFrame:
    """A written table with a broadcast hint if its files have at most ``most`` bytes; beyond that the planner shuffles."""
    return F.broadcast(written) if written_bytes(written) <= most else written
