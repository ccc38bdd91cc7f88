"""Packing against a step-by-step replay, the tokenizers library and the least number of sequences."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondo.llm import packing
from rondo.llm.packing import cut_documents, pack_documents, pack_pieces, sum_of_squares


def replay(lengths, capacity):
    """The rule by its definition: the sum of squares is counted anew for every open sequence."""
    fills, out = [], []
    for n in lengths:
        options = []
        for s, fill in enumerate(fills):
            if fill + n <= capacity and fill < capacity:
                after = [*fills[:s], fill + n, *fills[s + 1 :]]
                counts = {}
                for f in after:
                    if f < capacity:
                        counts[f] = counts.get(f, 0) + 1
                options.append((sum(c * c for c in counts.values()), capacity - fill, s))
        if options:
            least = min(options)[:2]
            s = next(s for *o, s in options if tuple(o) == least)
        else:
            s = len(fills)
            fills.append(0)
        out.append((least[1] if options else capacity, n))
        fills[s] += n
    return out, len(fills)


def test_rule_matches_its_definition():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([5, 10, 24])
        lengths = [rng.randint(1, capacity - 1) for _ in range(rng.randint(0, 30))]
        sequence, offset = sum_of_squares(np.array(lengths, dtype=np.int64), capacity)
        steps, opened = replay(lengths, capacity)
        assert [(capacity - int(o), n) for o, n in zip(offset, lengths, strict=True)] == steps
        assert len(set(sequence.tolist())) == opened


def check(rows, capacity):
    """Every sequence is filled from 0 without gaps and not beyond its capacity; returns how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark, odd, none, sample, byte_bpe):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe)
    long = [(100, "lorem ipsum " * 40_000, None, None, None), (101, "漢字 " * 20_000, None, None, None), (102, "<|endoftext|>" * 1024, None, None, None), (103, "<|endoftext|>" * 1023, None, None, None)]
    docs = odd.select(*sample.columns).union(sample.withColumn("doc_id", F.col("doc_id") + 1000)).union(spark.createDataFrame(long, sample.schema))
    got = pack_documents(docs, byte_bpe).collect()
    want = []
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got], key=str) == sorted(want, key=str)
    least = -(-sum(w[3] for w in want) // 1024)
    assert check(got, 1024) <= 1.01 * least + 1
    assert pack_documents(none, byte_bpe).count() == 0 and cut_documents(odd, byte_bpe).filter("doc_id is null").count() == 1


def test_blocks_are_packed_together(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, rng.choice([100, 300, 500, 511, 700, 1000, rng.randint(1, 1024)])) for k in range(5000)]
    pieces = spark.createDataFrame(rows, "own long, length long").repartition(5)
    monkeypatch.setattr(packing, "BLOCK_PIECES", 256)
    got = pack_pieces(pieces).collect()
    assert sorted((r.own, r.length) for r in got) == rows
    fixed, _ = sum_of_squares(np.array(sorted((n for _, n in rows if n < 1024), reverse=True)), 1024)
    assert check(got, 1024) <= 1.01 * (len(set(fixed.tolist())) + sum(n == 1024 for _, n in rows)) + 1
    same = pack_pieces(spark.range(3000).select(F.lit(600).alias("length"))).collect()
    assert check(same, 1024) == 3000
    with pytest.raises(Exception, match="not of 1 to 1024"):
        pack_pieces(spark.createDataFrame([(0,)], "length long")).collect()
