"""The corpus pipeline: language ID, toxicity, near-dedup, mixing, piece encoding, each over all its predecessor kept.

Every stage writes Parquet to the shared folder and the next one reads it, so a lost executor repeats one stage's tasks.
All stages but the last return the columns of ``documents``; other columns are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.llm import ppm, toxicity
from normlake.llm.common import saved, scratch, table
from normlake.llm.mixing import mix
from normlake.llm.neardup import keep_one
from normlake.llm.pieces import token_digest
from normlake.llm.queries import TARGET, piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SHARE = 0.5  # a language has to be likelier than all others together
RADIUS, CHECK = 9, 20  # bits in which the fingerprints of two- and of five-word shingles of proposed pairs may differ
SIMILAR = 0.8  # Jaccard similarity of the five-word shingles of near-copies


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without a letter, and texts that no learned language makes likelier than the others."""
    docs = docs.select(*COLUMNS)
    found = ppm.predict(docs, ppm.train(docs), COLUMNS)
    return found.where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are toxic by a classifier trained on the labelled texts among ``docs``."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).where(F.col("predicted") == 0).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of copies and near-copies stays, the one with the smallest id.

    Texts link when the sets of their five-word shingles have a similarity of 0.8 or more. Fingerprints of two-word shingles
    within 9 bits and rare shingles in common propose pairs; every link is verified on the sets.
    """
    return keep_one(docs.select(*COLUMNS), width=2, radius=RADIUS, check_width=5, check=CHECK, similar=SIMILAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them: not at all, once, or once per epoch."""
    taken = mix(docs.select(*COLUMNS), TARGET).where(F.col("_epochs") > 0)
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_epochs"))).alias("_epoch")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every text's pieces and of the text decoded from them."""
    return token_digest(docs, piece_model())


STAGES = [
    ("language_id", identify),
    ("toxicity", detoxify),
    ("near_dedup", deduplicate),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: Stages fit models and follow links to the end, which SQL does not express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
