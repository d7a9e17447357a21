"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last keep
the columns of their input:

1. quality rules: documents that the base rule or the perplexity band of their
   language rejects go;
2. n-gram Jaccard join: of each component of texts whose sets of five-word
   shingles have a similarity of 0.8 or more, the document of the least id stays;
3. benchmark decontamination: removal spans of test passages go from the texts;
4. secret scans: every reported span is replaced by a placeholder;
5. SentencePiece encoding: the texts' piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import decontaminate, jaccard_join, piece_codec, quality_rules, secret_scan
from caselens.llm.textcore import discard, written


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` again, where the table has it, after a change of text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secret_scan.redact(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode(docs, piece_codec.model_file())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("piece_encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[DataFrame] = []
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return docs


#: the language model of the first stage can't be put in SQL
ORACLE_SQL = None
