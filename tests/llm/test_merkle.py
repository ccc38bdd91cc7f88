"""The Merkle manifest against a tree built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rondo.llm.merkle import merkle_manifest, verify


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def brute(rows):
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = digest([doc_id, source, lang, n_chars, text])
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        changed = digest([doc_id, source, lang, n_chars, low]) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else leaf
        by.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels([r[2] for r in sorted(by[lang])]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for s, lang in enumerate(order):
        for k, (_, _, leaf, node, doc_id) in enumerate(sorted(by[lang])):
            path = siblings(trees[lang], k) + siblings(top, s)
            for before, after in path:
                node = sha(before + node + after)
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest(frame):
    return sorted(map(tuple, verify(merkle_manifest(frame)).collect()), key=str)


def test_manifest(spark, odd, none, sample):
    plain = odd.select(*sample.columns)
    langs = sample.limit(150).select("doc_id", "text", F.concat(F.lit("l"), F.col("doc_id") % 70).alias("lang"), "source", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")).alias("n_chars"))
    for frame in (plain, sample, plain.union(langs)):
        rows = [tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        got = manifest(frame)
        assert got == brute(rows)
        assert frame is plain or any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert [r[:6] for r in manifest(odd)] == [r[:6] for r in manifest(plain)]
    assert manifest(none) == []


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 513])
def test_sizes(spark, n):
    rows = [(k, f"Text {k}", "en", None, k) for k in range(n)]
    assert manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")) == brute(rows)
