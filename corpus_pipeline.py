"""Corpus preparation: stages from documents to documents, the last to token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written as Parquet before the next one reads it:

1. quality: documents that the quality rules reject go;
2. near_dedup: of each class of near copies, the document of least id stays;
3. decontaminate: documents that hold a benchmark item go;
4. pii: personal data in texts is replaced by placeholders;
5. encode: texts become BPE ids and what they decode to.

Stages 1 to 4 return the columns of documents; ``n_chars`` follows the text where
a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, near_dedup, pii, quality_rules
from docloom.runtime import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(docs.select(COLUMNS), table(spark, sf_dir, "labels"))
    return judged.where("kept").select(COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality", quality),
    ("near_dedup", dedup),
    ("decontaminate", clean_of_benchmarks),
    ("pii", redacted),
    ("encode", encoded),
]

#: No stage but the last is expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
