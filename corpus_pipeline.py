"""The corpus pipeline: language, near copies, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm.common import discard, settled, small_batches
from lakeseek.llm.jaccard_join import jaccard_classes
from lakeseek.llm.language import learn_filters, predict_language
from lakeseek.llm.mixing import curriculum
from lakeseek.llm.pieces import encode_pieces
from lakeseek.llm.queries import piece_model
from lakeseek.llm.spans import dedup_spans

#: A text stays if its language holds at least this share of its n-grams, false positives taken off.
LEAST_SHARE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones too) and those that no learned language covers. Learns from all of the documents."""
    small_batches(spark)
    scored = predict_language(docs, learn_filters(docs))
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near copies (five-word shingles, similarity 0.8 or more).

    Documents without an id stay; of rows that share an id all stay or all go.
    """
    small_batches(spark)
    gone = settled(lambda: jaccard_classes(docs, k=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from texts; a document of which nothing is left goes. Null and empty texts stay; rows alike in id and text keep the same."""
    small_batches(spark)
    kept = dedup_spans(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, a row per copy, in training order. Null and empty texts have no words to take and are left out once their source is served."""
    small_batches(spark)
    return curriculum(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids and each piece's span of source bytes; round_trip says whether they decode to the text. A null text has the end id only. Rows stay apart."""
    small_batches(spark)
    encoded = encode_pieces(docs, piece_model())
    return encoded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("mixing", mixing), ("tokens", tokens)]
#: The first stage's filters and the last stage's pieces can't be said in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage but the last is written to the shared folder, so that none is computed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir))  # noqa: B023
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
