"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.llm import decontam, langid, linededup, neardup, packing
from isochron.llm.common import fresh_path
from isochron.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without language: null texts and texts without a letter.

    Low scores reject nothing: a text of one word has one too, however clean it is.
    """
    return langid.identify(docs).where(F.col("lang_pred") != "und").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that ten documents or more share; all documents stay, with what is left of them."""
    clean = linededup.dedup_lines(docs.select(*COLUMNS), min_docs=10, least=1)
    text = F.when(F.col("text").isNotNull(), F.col("text_kept"))
    return clean.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: five-word shingles, a similarity of 0.8 or more.

    Rows without doc_id, repeated rows and different texts under one doc_id are rows like others.
    """
    return neardup.survivors(docs.select(*COLUMNS), words=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text holds four fifths or more of a benchmark item's five-word shingles, whatever their doc_id."""
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: Language profiles, MinHash and tokenisation are beyond SQL; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
