"""Token counts and byte-pair encoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondo.llm import bpe, token_count
from rondo.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, concatenate, halves
from rondo.llm.token_count import token_counts
from rondo.llm.vocabulary import safe_cuts, vocabulary

PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "ß", "1", "12", ".", "'s", "'", "x" * 9, "<|endoftext|>", "　", "漢", "😀", "S"]


@pytest.fixture(scope="module")
def library(byte_bpe):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe)


def test_joins_and_cuts_match_the_library(library, byte_bpe, monkeypatch):
    vocab, rng = vocabulary(byte_bpe), random.Random(11)
    for _ in range(1500):
        alphabet = rng.sample(PARTS, rng.randint(1, 6))
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([5, 30, 200, 600])))
        longest = rng.choice([3, 10, 40, 100])
        monkeypatch.setattr(bpe, "WINDOW", rng.choice([1, 4, 16, 64]))
        want = library.encode(text, add_special_tokens=False).ids
        parts = [(p.encode(), vocab.encode(p).astype(np.int64)) for p in halves(text, longest, tuple(vocab.specials))]
        assert concatenate(parts, vocab).tolist() == want, text
        assert [i for p in safe_cuts(text.encode(), longest) for i in vocab.encode(p.decode()).tolist()] == want, text
        ids = np.array([rng.randrange(50257) for _ in range(6)])
        assert vocab.decode(ids)[0].tobytes().decode(errors="replace") == library.decode(ids.tolist(), skip_special_tokens=False)


def test_every_code_point_is_encoded_alike(library, byte_bpe):
    vocab = vocabulary(byte_bpe)
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)} x" for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF][::7]
    assert all(vocab.encode(t).tolist() == e.ids for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True))


def test_documents(spark, odd, none, sample, library, byte_bpe, monkeypatch):
    long = [(100, "lorem ipsum " * 9000, None, None, None), (101, "q" * 70_000, None, None, None), (102, "漢字 " * 20_000, None, None, None), (103, "<|endoftext|>" * 6000, None, None, None)]
    docs = odd.select(*sample.columns).union(sample.limit(150).withColumn("doc_id", F.col("doc_id") + 1000)).union(spark.createDataFrame(long, odd.select(*sample.columns).schema))
    counted = sorted(map(tuple, token_counts(docs, byte_bpe).collect()), key=str)
    tripped = sorted(map(tuple, bpe_round_trip(docs, byte_bpe).collect()), key=str)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    ids = [library.encode(t, add_special_tokens=False).ids for _, t in rows]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert counted == sorted(((d, len(t.encode()), len(i), len(i) > 512) for (d, t), i in zip(rows, ids, strict=True)), key=str)
    back = [library.decode(i, skip_special_tokens=False) for i in ids]
    assert back == [t for _, t in rows]
    assert tripped == sorted(((d, len(i), sha(",".join(map(str, i))), sha(b)) for (d, _), i, b in zip(rows, ids, back, strict=True)), key=str)
    decoded = bpe_decode(bpe_encode(odd, byte_bpe), byte_bpe)
    assert sorted(r.text for r in decoded.collect()) == sorted(r.text or "" for r in odd.collect())
    assert token_counts(none, byte_bpe).count() == bpe_round_trip(none, byte_bpe).count() == 0
    assert token_count.LONG and bpe_decode(spark.createDataFrame([(None,)], "ids array<int>"), byte_bpe).first().text is None
