"""The operators' queries over the driver's tables: name -> f(spark, sf_dir), and SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lakeseek.llm.common import small_batches
from lakeseek.llm.context_tree import score_texts
from lakeseek.llm.flac import flac_digests
from lakeseek.llm.jaccard_join import jaccard_classes
from lakeseek.llm.language import identify_languages
from lakeseek.llm.mixing import mix_plan
from lakeseek.llm.pieces import piece_digests
from lakeseek.llm.shards import uniform_shards
from lakeseek.llm.spans import dedup_spans
from lakeseek.llm.toxicity import score_toxicity
from lakeseek.llm.vector_graph import near_vectors


def piece_model() -> str:
    """The path of the tokenizer's model: LAKESEEK_PIECES, or the installed public one."""
    if found := os.environ.get("LAKESEEK_PIECES"):
        return found
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed", "removed")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_digests(_table(spark, sf_dir, "documents"))


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), piece_model())


def op7_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op8_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_shards(_table(spark, sf_dir, "documents"), 40)


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "positions")


def op10_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentence_spans, op2_ngram_jaccard_join, op3_context_tree, op4_flac, op5_kneser_ney_toxicity, op6_sentencepiece, op7_vector_graph, op8_uniform_shards, op9_curriculum_mix, op10_language_filters)}

ORACLE_SQL: dict[str, str] = {}
