"""From raw documents to token ids in five stages, each one of the operators of `tapeworks.llm`.

Every stage reads all that its predecessor kept, as a table. The first four return the columns of
documents (n_chars follows the text that they leave); the last returns the token ids.

Columns of any name are carried through the first four stages. An empty table gives an empty one.
Repeated rows and null ids are documents like others; what a null text becomes is said of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tapeworks
from tapeworks.llm import bpe, decontaminate, linededup, minhash, quality
from tapeworks.llm.common import scratch, table

#: SQL can express neither near duplicates by sketches nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their host's boilerplate lines. Null and empty texts have no words and go; repeated rows are judged alike."""
    return _columns(quality.clean(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; one may be left without a word. Null texts stay null."""
    return _columns(linededup.dedup(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (null first); repeated rows are copies. Texts without a word are in no group and all stay."""
    tapeworks.distribute(spark)
    return minhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, without the benchmark's passages. Null and empty texts stay, and all do if the benchmark is empty."""
    tapeworks.distribute(spark)
    return _columns(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian u32), ids_sha256, decoded_sha256 of every document; null and empty texts have no ids."""
    tapeworks.distribute(spark)
    return bpe.digests(docs, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written and read again."""
    tapeworks.distribute(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
