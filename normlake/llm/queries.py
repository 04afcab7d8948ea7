"""Registered queries of the corpus operators and their SQL twins, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.llm.alignment import Vocabularies, align_documents
from normlake.llm.ann import nearest
from normlake.llm.common import table
from normlake.llm.fingerprinting import fingerprint_edits
from normlake.llm.licenses import oracle as license_oracle
from normlake.llm.licenses import scan
from normlake.llm.lm import score_words
from normlake.llm.mixing import mix
from normlake.llm.mixing import oracle as mixing_oracle
from normlake.llm.neardup import simhash_near_dedup
from normlake.llm.ogg import media_digest
from normlake.llm.phrases import collocations
from normlake.llm.phrases import oracle as phrase_oracle
from normlake.llm.pieces import PieceModel, load, token_digest
from normlake.llm.ppm import held_out_language_id
from normlake.llm.sharding import shard_documents
from normlake.llm.toxicity import held_out_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_LEVEL = "byte_bpe_50k.json"
#: Weights of domains, languages and sources; names that are absent weigh 1.
TARGET = ({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 4, "de": 2, "fr": 2, "es": 1}, {})


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def piece_model() -> PieceModel:
    """The public 32k byte-pair piece model that is installed beside the tokenizer libraries."""
    return load(path(PIECE_MODEL))


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return held_out_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return held_out_language_id(table(spark, folder, "documents"))


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mix(table(spark, folder, "documents"), TARGET)
    return rows.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"),
                       F.col("_budget").alias("leaf_budget"), F.col("_epochs").alias("epochs"))


ORACLES["op3_mixing"] = mixing_oracle(TARGET)


@query
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(table(spark, folder, "documents"))


@query
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))


@query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))


ORACLES["op6_license_scan"] = license_oracle()


@query
def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_near_dedup(table(spark, folder, "documents"))


@query
def op8_ogg_media(spark: SparkSession, folder: str) -> DataFrame:
    return media_digest(table(spark, folder, "documents"))


@query
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_words(table(spark, folder, "documents"))


@query
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return token_digest(table(spark, folder, "documents"), piece_model())


@query
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_documents(table(spark, folder, "documents"), Vocabularies(path(BYTE_LEVEL), path(PIECE_MODEL)))


@query
def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


ORACLES["op13_collocations"] = phrase_oracle()
