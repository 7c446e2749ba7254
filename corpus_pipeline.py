"""Quality rules, near-dedup, personal data, mixing and BPE encoding, one after the other, over the whole of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import bpe, mixing, near_dedup, pii, quality_rules
from gleaner.llm.common import Scratch, released
from gleaner.llm.queries import DOMAIN_WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.quality_rules(docs.select(*COLUMNS), quality_rules.trusted_ids(_labels(spark, sf_dir)))
    return judged.where("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8 or more): that of the smallest id."""
    return near_dedup.drop_near_duplicates(spark, docs.select(*COLUMNS), k=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars counts the new text."""
    from pyspark.sql import functions as F

    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates towards the target weights say."""
    return mixing.mix(docs.select(*COLUMNS), mixing.labelled_domains(_labels(spark, sf_dir)), DOMAIN_WEIGHTS).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests of ids and decoded text."""
    import public_tokenizers

    return bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup_stage),
    ("personal_data", personal_data),
    ("mixing", mixing_stage),
    ("encoding", encoding),
]

#: No stage but the third could be told in SQL (hashes, sketches, a fitted model): tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        # What a stage's operator wrote for itself, and the table before, are no longer needed once its result is written.
        with released():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
