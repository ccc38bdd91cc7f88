"""Quality rules and the quality classifier."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondo.llm.quality_classifier import Logistic, co_train, score_quality
from rondo.llm.quality_rules import drop_rejected, js_distance, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    seen, dup, covered = set(), 0, set()
    grams = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(grams)
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_counts_match_brute_force(request, which):
    docs = request.getfixturevalue(which)
    want = sorted([r.doc_id if r.doc_id is not None else -1, *counts(r.text)] for r in docs.collect())
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted([r.doc_id if r.doc_id is not None else -1, *[r[c] for c in columns]] for r in quality_rules(docs).collect())
    assert got == want


def test_verdict_keeps_good_and_drops_junk(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality_rules(docs).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in judged if r.quality == 1)
    bad = [r for r in judged if r.quality == 0]
    assert sum(not r.kept for r in bad) > 0.9 * len(bad)


def test_empty_table_and_stage(none, odd):
    assert quality_rules(none).count() == 0
    left = drop_rejected(odd)
    assert left.columns == odd.columns and left.count() == 0  # all of them are too short or repeat themselves


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(js_distance(F.col("p"), F.col("q")).alias("d"), js_distance(F.col("p"), F.col("p")).alias("z")).first()
    assert abs(row.d - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-12 and row.z == 0


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fitted = labels.filter("doc_id % 3 != 0")
    held = score_quality(docs, fitted).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in held)
    assert right > 0.95 * len(held) and all(0 <= r.p_quality <= 1 for r in held)


def test_classifier_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 0, 0), (6, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(odd, labels).count() == odd.count()
    assert score_quality(none, labels).count() == 0
    assert {(r.p_quality, r.kept) for r in score_quality(odd, labels.limit(0)).collect()} == {(0.5, True)}


def test_co_training_uses_the_other_view():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.5).astype(float)
    a, b = y[:, None] * 3 + rng.normal(size=(3000, 3)), y[:, None] * 3 + rng.normal(size=(3000, 2))
    held = np.arange(60) % 5 == 0
    first, second, both = co_train((a[:60], b[:60]), y[:60], (a[60:2000], b[60:2000]), held)
    p = both.logit(np.column_stack([first.logit(a[2000:]), second.logit(b[2000:])])) > 0
    assert (p == (y[2000:] > 0.5)).mean() > 0.97
    assert (Logistic(np.zeros((0, 3)), np.zeros(0)).logit(a[:2]) == 0).all()


def test_samples_are_bounded_and_whole_when_small(spark):
    from rondo.llm.quality_classifier import _sample

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("double").alias("y"))
    assert _sample(rows, ["doc_id", "y"], 6000).num_rows == 5000
    some = _sample(rows, ["doc_id", "y"], 500)
    assert 400 < some.num_rows <= 500 and some.equals(_sample(rows.repartition(9), ["doc_id", "y"], 500))
