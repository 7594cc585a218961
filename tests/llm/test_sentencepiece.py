"""Ids of whole tables against the sentencepiece library, and rows of any kind."""

import sentencepiece
from pyspark.sql import functions as F

from relspark.llm import queries, sentencepiece_tok


def test_parity_over_documents(spark):
    """Every document's ids are the library's."""
    model = sentencepiece_tok.read_model(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = sentencepiece_tok.encode(docs, model).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.round_trip and r.ids == library.encode(r.text) and r.n_tokens == len(r.ids)


def test_rows_of_any_kind(spark):
    model = sentencepiece_tok.read_model(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "word " * 120_000), (4, None), (5, "\x00 \t\n ﬁ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("lang", F.lit(1)).repartition(2)
    got = sentencepiece_tok.encode(d, model)
    assert got.columns == ["doc_id", "text", "lang", "ids", "n_tokens", "round_trip"]
    rows = got.collect()
    assert sorted(((r.ids is None), r.n_tokens == 0) for r in rows) == sorted((t is None, not t) for _, t in d.select("doc_id", "text").collect())
    back = sentencepiece_tok.decode(got.withColumnRenamed("text", "old"), model).collect()
    assert all(r.text == r.old for r in back if r.doc_id != 5)
    assert sentencepiece_tok.encode(d.limit(0), model).count() == 0 and sentencepiece_tok.decode(got.limit(0), model).count() == 0
