"""From raw documents to packed training sequences: rules, near duplicates, secrets, mix, packing.

Each stage reads what the one before kept, written as Parquet in the cluster's shared folder, so a lost
executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import mixing, near_dup, packing, quality, secrets
from folioscope.llm.common import shared_table, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule of the current policy go; the others stay as they are.

    A null or empty text has too few words and goes. Repeated rows are judged alike; columns of any name stay.
    """
    column = unused("_ledger", docs)
    judged = quality.annotate(docs, column)
    return judged.where(quality.verdict(F.col(f"{column}.failed"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least id stays, once; rows without an id all stay."""
    classes = near_dup.similarity_join(docs)
    kept = classes.where("doc_id = class_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in it are masked. Null texts stay null; an empty table stays empty."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat or go so that the sources come near their target weights; texts stay whole.

    A null source is one of its own; rows without a word go, as they add nothing to a mix.
    """
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, ids included; a null doc_id stays null, a null text is the single end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither the draw of the mix nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
