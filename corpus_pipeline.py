"""A training corpus from the documents table, in five stages.

Each stage is a function (spark, docs, sf_dir) that returns a DataFrame; it is
written as Parquet and read again as the next one's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, lines, mixing, quality, simjoin
from tessera.llm.queries import MIX, domain, table
from tessera.llm.storage import remove_tables, tables_now, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7 go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select(*COLUMNS), model, 0.7).where(F.col("predicted") == 1).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in the largest id; no document goes."""
    table(spark, sf_dir, "documents")
    done = lines.apply_bitmaps(docs.select(*COLUMNS), lines.dedup_lines(docs), keep=["doc_id", "lang", "source"])
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8, the smallest id stays.

    Rows are told apart by id and text: rows with one id or without one go only if
    another row's text stands for theirs, and rows alike in both are one document.
    """
    table(spark, sf_dir, "documents")
    return simjoin.keep_one(docs.select(*COLUMNS), 5, 80, 100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out; no document goes."""
    done = decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=["doc_id", "lang", "source"])
    return done.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: which documents give how many tokens."""
    table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, MIX, domain())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: A classifier and a similarity join aren't SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote goes as soon as the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    before = tables_now()
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        remove_tables(before, keep=[docs])
    return docs
