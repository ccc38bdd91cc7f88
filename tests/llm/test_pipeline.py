"""The pipeline's stages on the smallest data set, each against the operator it applies, and odd tables through all of them."""

import corpus_pipeline
import __spark_entry__ as entry_point
from rondo.llm.quality_rules import quality_rules
from rondo.session import persist_table

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, sample, byte_bpe):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe)
    kept = {r.doc_id for r in quality_rules(sample).filter("kept").collect()}
    docs, seen = sample, []
    for name, stage in corpus_pipeline.STAGES:
        out = persist_table(stage(spark, docs, SF_DIR), spark)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == sample.columns
            seen.append({r.doc_id: r.text for r in out.collect()})
        else:
            assert {r.doc_id: r.n_tokens for r in out.collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in seen[-1].items()}
        docs = out
    assert set(seen[0]) == kept and set(seen[1]) == kept
    # the one near-duplicate of these rows is a short text that already loses its only line to line dedup
    assert set(seen[3]) < set(seen[2]) <= set(seen[1]) and seen[2] == {i: seen[1][i] for i in seen[2]}
    assert {r.n_chars == len(r.text) for r in persist_table(corpus_pipeline.lines(spark, sample, SF_DIR)).collect()} == {True}


def test_odd_tables(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == docs.columns and out.count() <= docs.count()


def test_every_operator_is_registered():
    names = entry_point.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_rows_are_judged_by_their_own_text(spark, sample):
    """One bad row must not take the rows with its identifier along, and copies under NULL or a shared identifier must go."""
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    good = [r for r in quality_rules(sample).filter("kept AND doc_id < 60").join(sample.select("doc_id", "text"), "doc_id").orderBy("doc_id").collect()][:3]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], sample.schema)
    texts = lambda f: sorted((r.doc_id or -1, r.text) for r in f.collect())
    line = "One line that all of these documents hold, long enough."
    for i in (None, 7):
        docs = frame([(i, good[0].text), (i, "bad bad"), (i, good[1].text), (1, good[2].text)])
        assert texts(corpus_pipeline.quality(spark, docs, SF_DIR)) == sorted([(i or -1, good[0].text), (i or -1, good[1].text), (1, good[2].text)])
        docs = frame([(i, "clean words only"), (i, f"before {item} after")])
        assert texts(corpus_pipeline.benchmark(spark, docs, SF_DIR)) == [(i or -1, "clean words only")]
        docs = frame([(i, f"{line}\na"), (i, f"{line}\nb"), (3, f"{line}\nc")])
        got = persist_table(corpus_pipeline.lines(spark, docs, SF_DIR)).collect()
        assert len(got) == 3 and sum(line in r.text for r in got) == 1 and sorted(r.text[-1] for r in got) == ["a", "b", "c"]
        assert [line in r.text for r in got if r.doc_id == 3] == [True]
        docs = frame([(i, good[0].text), (i, good[0].text), (9, good[0].text), (i, good[1].text)])
        left = corpus_pipeline.near(spark, docs, SF_DIR).collect()
        assert sorted(r.text for r in left) == sorted([good[0].text, good[1].text])
