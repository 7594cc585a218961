"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html_extract, langid, lm_score, minhash, passages, quality, sentencepiece_tok, topk
from .store import table

#: Where the public tokenizers' files lie; a parameter of sentencepiece().
TOKENIZERS = "/opt/tokenizers"


def _fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def _good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column `good`, true for those that have a label of quality 1."""
    good = labels.filter("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    # labels grow with the documents: never broadcast; texts stream past them and are not sorted
    return docs.join(good.hint("shuffle_hash"), "doc_id", "left")


def lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score_within(_good(docs, table(spark, sf_dir, "labels")), "good")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(_fold(4) != 2))
    return quality.score(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "score", "predicted")


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that loses passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = passages.cut_repeated(docs).filter("removed_runs > 0")
    return cut.select("doc_id", "removed_runs", "removed_words", "removed", "text")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(_fold(3) != 1))
    out = langid.identify(docs, model)
    return out.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def sentencepiece(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    model = sentencepiece_tok.read_model(f"{folder}/piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_tok.encode(docs, model).select("doc_id", "n_tokens", "ids", "round_trip")


def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat.read_back(chat.windows(rows.unionByName(extra)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_html": html,
    "op2_lm_score": lm,
    "op3_quality": quality_scores,
    "op4_passages": repeated_passages,
    "op5_language": language,
    "op6_topk": nearest,
    "op7_decontamination": benchmark_leaks,
    "op8_minhash": near_duplicates,
    "op9_sentencepiece": sentencepiece,
    "op10_chat": chat_windows,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
            WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
}
