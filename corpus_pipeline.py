"""A training corpus from documents: quality, near-duplicates, passages, benchmark, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; all but the last return the columns of
documents.  Between stages the documents are written as Parquet to the cluster's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relspark.llm import decontam, minhash, passages, quality, sentencepiece_tok
from relspark.llm.queries import TOKENIZERS
from relspark.llm.store import keep, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from all labels, accepts.  A null text is scored as an empty one; rows
    that repeat an id are each scored by their own text; a null id is no reason to go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id.  Null and empty texts and null ids stay;
    rows that repeat an id are one document."""
    return minhash.drop_near_duplicates(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; documents with nothing left go too.  n_chars follows the text where it
    was cut.  Null and empty texts and rows without an id stay as they are; rows that repeat an id lose nothing to one
    another."""
    cut = passages.cut_repeated(docs).filter("removed_runs = 0 or trim(text) != ''")
    return cut.selectExpr(*(c if c != "n_chars" else "case when removed_runs > 0 then length(text) else n_chars end as n_chars" for c in docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.  Null and empty texts stay; a null id is no reason to stay or go; rows that
    repeat an id are decided one by one."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, one row for each.  A null text has null ids, an empty one none."""
    model = sentencepiece_tok.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    return sentencepiece_tok.encode(docs, model).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", passage_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: No stage can be put as SQL: the classifier is fitted, and the tokenizer is a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, f"stage{i + 1}")
    return docs
