"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles. Native functions only."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table

from .text import row_keys, same, shingle_hashes, small, words

PERCENT = 75
MISS = 1e-9  # bound on the chance that the search overlooks an item at the threshold
CLASSES = range(31)  # an item of size n is in class log2(n); arrays are not longer than 2^31


def slots(size_class: int) -> int:
    """Length of the MinHash signature of items with 2^class to 2^(class+1) shingles: all of a small set, a sample of a large one."""
    return min(64, max(16, 2 ** max(0, size_class - 1)))


def least_hits(k: int) -> int:
    """Slots an item at the threshold has in common with a document, but for a chance under ``MISS``."""
    share, tail, m = PERCENT / 100, 0.0, 0
    while m < k and (tail := tail + comb(k, m) * share**m * (1 - share) ** (k - m)) < MISS:
        m += 1
    return max(1, m)


def _by_class(n: Column, value) -> Column:
    chosen = F.lit(value(CLASSES[-1]))
    for c in reversed(CLASSES[:-1]):
        chosen = F.when(n < 2 ** (c + 1), F.lit(value(c))).otherwise(chosen)
    return chosen


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document and a test item of which the document holds at least three quarters of the five-word shingles.

    A signature of a whole document says nothing of a short passage in it, so the sets are treated unevenly. Items are partitioned by size; each
    class has a signature of its own length, the smallest shingle hashes of the item. The signatures form an index of slots, and documents of
    any length look up all their shingles in it. Of an item at the threshold, the common slots are a random sample of its shingles, so their
    number has a known least value per class; pairs that reach it are candidates. A candidate counts if the exact sets say so:
    100 * common shingles >= 75 * shingles of the item. Words are lower-cased; fewer than five words are one shingle, the whole sequence.

    NULL or blank texts and items contain nothing and are contained in nothing. NULL identifiers are kept as such; rows of one identifier give one pair with
    the greatest count. An empty table gives an empty result. Columns: doc_id, item_id, n_item, n_common.
    """
    hashes = lambda t: shingle_hashes(words(F.lower(t)))
    sets = items.select(F.col("item_id"), hashes(F.col("text")).alias("item_set")).withColumn("n_item", F.size("item_set")).filter("n_item > 0")
    sets = persist_table(sets.withColumn("item_key", F.monotonically_increasing_id()))
    signature = F.slice(F.sort_array("item_set"), F.lit(1), _by_class(F.col("n_item"), slots))
    index = persist_table(sets.select(F.explode(signature).alias("slot"), "item_key", _by_class(F.col("n_item"), lambda c: min(2**c, least_hits(slots(c)))).alias("least")))
    seen = docs.select("doc_id", F.explode(hashes(F.col("text"))).alias("slot"))
    hits = seen.join(small(index), "slot").groupBy("doc_id", "item_key").agg(F.count("*").alias("hits"), F.first("least").alias("least"))
    pairs = persist_table(hits.filter(F.col("hits") >= F.col("least")).select(F.col("doc_id").alias("pair_doc"), "item_key"))
    texts = docs.select("doc_id", "text").join(small(pairs), same(F.col("doc_id"), F.col("pair_doc")))
    common = F.size(F.array_intersect("doc_set", "item_set"))
    exact = texts.join(sets, "item_key").select("doc_id", "item_id", "n_item", hashes(F.col("text")).alias("doc_set"), "item_set").select("doc_id", "item_id", F.col("n_item").cast("long"), common.cast("long").alias("n_common"))
    return exact.filter(100 * F.col("n_common") >= PERCENT * F.col("n_item")).groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_common").alias("n_common"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no test item; all columns stay. Every row is judged by its own text, whatever its identifier."""
    keyed, key = row_keys(docs)
    gone = persist_table(contained_items(keyed.select(F.col(key).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(small(gone), key, "left_anti").select(*docs.columns)


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([list_aggregate(w[i:i+4], 'string_agg', ' ') FOR i IN range(1, len(w) - 3)]) ELSE [] END AS s FROM w),
v AS (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
b AS (SELECT item_id, list_distinct([list_aggregate(w[i:i+4], 'string_agg', ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM v WHERE len(w) >= 5),
e AS (SELECT item_id, len(s) AS n_item, unnest(s) AS g FROM b),
x AS (SELECT doc_id, unnest(s) AS g FROM d)
SELECT doc_id, item_id, CAST(max(n_item) AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_common FROM x JOIN e USING (g)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * max(n_item)
"""
