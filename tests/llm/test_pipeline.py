"""The pipeline's stages against plain versions, each over what the one before it kept, and rows of any kind."""

from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_decontam import plain as leaks
from test_neardup import exact_components
from test_operators import prose, words

import corpus_pipeline
from relspark.llm import passages, quality, queries, sentencepiece_tok

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage keeps, in memory."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs[-1], SF)
        docs.append(spark.createDataFrame(kept.collect(), kept.schema))
    return docs


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    assert all(d.columns == stages[0].columns for d in stages[:5])
    counts = [d.count() for d in stages]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] > counts[4] == counts[5] > 0


def test_quality_keeps_what_is_accepted(spark, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score(stages[0], model).filter("score >= 0.7").collect()}
    assert Counter(i for i, _ in texts(stages[1])) == Counter(want)


def test_one_document_of_each_group_stays(stages):
    comp = exact_components(texts(stages[1]), k=5)
    assert {i for i, _ in texts(stages[2])} == {i for i, (_, c) in comp.items() if i == c}


def test_passages_that_an_earlier_document_has_go(stages):
    """No 50 words in a row are left that an earlier document has; what is left is as it was."""
    before, after = dict(texts(stages[2])), dict(texts(stages[3]))
    owner, left = {}, 0
    for i in sorted(after):
        w = words(after[i])
        for k in range(len(w) - 49):
            left += owner.setdefault(tuple(w[k : k + 50]), i) != i
    assert left == 0
    for i, t in after.items():
        if t != before[i]:
            rest = iter(words(before[i]))
            assert all(x in rest for x in words(t))  # a subsequence
            assert len(words(before[i])) - len(words(t)) >= passages.MIN_WORDS
    for r in stages[3].collect():
        assert r.n_chars == len(r.text)


def test_no_leak_stays_and_nothing_else_goes(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _ in leaks(texts(stages[3]), items)}
    assert {i for i, _ in texts(stages[4])} == {i for i, _ in texts(stages[3])} - bad and bad


def test_ids_are_the_librarys(stages):
    model = sentencepiece_tok.read_model(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    text = dict(texts(stages[4]))
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == set(text) and all(r.ids == library.encode(text[r.doc_id]) and r.round_trip for r in rows)


def test_run_gives_the_last_stages_rows(spark, stages):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: r.ids for r in stages[5].collect()}


def test_rows_of_any_kind(spark):
    long = prose(7, 30_000, 10**6)
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (5, long), (None, "no id " * 30), (6, "one"), (6, "one"), (7, prose(1, 80)), (7, prose(2, 80)), (8, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, id int, found int, ids string, t int"
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1, 2, "y", 3) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF).collect()
        assert Counter(r.doc_id for r in kept) <= Counter(i for i, _ in rows), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert stage(spark, docs, SF).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()} == {1, 2, 3, 4, None, 6, 7, 8}
    left = Counter(r.doc_id for r in corpus_pipeline.passage_stage(spark, docs.withColumn("n_chars", F.length("text")), SF).collect())
    assert left == Counter({1: 1, 2: 1, 3: 1, 4: 1, None: 1, 6: 2, 7: 2, 8: 1})
