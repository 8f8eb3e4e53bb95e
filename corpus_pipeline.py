"""A corpus pipeline of five stages, each on what its predecessor kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``; other columns of ``docs``, whatever their names, are left
out. Null and empty texts pass every filter, as do rows without id; an empty table gives an empty table of the same
columns; very long texts are read whole. What a stage does with ties and repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import stored
from tidelog.llm.decontamination import WINDOW, contamination
from tidelog.llm.ngram_join import jaccard_components
from tidelog.llm.sentencepiece import piece_tokens
from tidelog.llm.substring_dedup import dedup_substrings
from tidelog.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores below one half. Repeated rows are scored, and go or stay, alike."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, carry=COLUMNS).where(F.col("predicted") == 0).select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by Jaccard 0.8 or more over five-word shingles. Rows that repeat that id all stay."""
    groups = jaccard_components(docs, shingle=5, percent=80)
    kept = groups.where((F.col("component_id") == F.col("doc_id")) | F.col("component_id").isNull()).select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept.distinct(), docs.doc_id.eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that a document with a smaller id holds too; ``n_chars`` follows where the text has changed.

    All rows stay, if need be with an empty text. Rows that repeat an id take nothing from each other.
    """
    out = dedup_substrings(docs, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return out.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source", F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("carried.n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole window of 13 words of the benchmark, however long the document, and less than a twentieth covered by its shorter items.

    A share alone would keep a benchmark passage in any document of twenty times its length. Repeated rows go or stay alike.
    """
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    window = F.exists(F.arrays_zip("starts", "ends"), lambda r: r["ends"] - r["starts"] >= WINDOW)
    return found.where(~F.col("contaminated") & ~window).select("carried.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests of ids and of what they decode to; one row for each row."""
    return piece_tokens(docs).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", substring_dedup), ("benchmark_decontamination", decontamination), ("sentencepiece", tokens)]

#: Trained scores and exact token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``: ``doc_id``, ``n_tokens``, ``ids``, ``ids_sha256``, ``decoded_sha256``. Each stage's result is kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
