"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.conversations import damaged, repair_report
from pairlens.llm.embeddings import near_vectors
from pairlens.llm.html import main_texts
from pairlens.llm.langid import identified
from pairlens.llm.lm import lm_scores
from pairlens.llm.mixing import mix
from pairlens.llm.oracle import EMBEDDINGS_SQL, PHRASES_SQL, QUALITY_SQL, REPAIR_SQL
from pairlens.llm.packing import pack
from pairlens.llm.phrases import collocations
from pairlens.llm.pii import pii_report
from pairlens.llm.quality import quality_report
from pairlens.llm.shards import histogram_shards
from pairlens.llm.simhash import near_duplicates
from pairlens.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(_table(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histogram_shards(_table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_embeddings, op3_language, op4_shards, op5_packing, op6_mixing, op7_quality, op8_lm, op9_pii, op10_html, op11_toxicity, op12_phrases, op13_conversations)}
ORACLE_SQL: dict[str, str] = {"op2_embeddings": EMBEDDINGS_SQL, "op7_quality": QUALITY_SQL, "op12_phrases": PHRASES_SQL, "op13_conversations": REPAIR_SQL}
