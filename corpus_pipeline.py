"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept and returns the columns of documents, but the last, which returns the ids.

Columns that documents do not have of their own, whatever their names, pass through the first four stages unread and unchanged.
Repeated rows are judged alike; line dedup and near duplicates take rows of one id as one document. A null id is an id like any other, but linked with
nothing. Null texts are empty to the rules (and fail them), one empty line to line dedup, without words to the others. Empty tables give empty results.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilake.llm import bpe, decontaminate, linededup, ngram_join, quality
from petrilake.llm.common import written


#: The columns that the stages know; others are carried under names that no operator uses.
OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def _carrying(stage):
    """The stage, with all other columns of its documents handed on under their own names."""

    @wraps(stage)
    def f(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"__carried_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return f


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the new text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


@_carrying
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose histograms are far from their language's, go."""
    return quality.judge(docs, refs=written(quality.references(docs), "references")).where("kept").select(*docs.columns)


@_carrying
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in the one of the largest id."""
    return _counted(linededup.dedup_lines(docs, 20, 3), docs.columns)


@_carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similarity 0.8 links, the one of the smallest id stays.

    Empty texts are linked with nothing, and stay.
    """
    groups = ngram_join.join_components(docs.select("doc_id", "text"), 5, 80)
    return docs.join(groups.where("doc_id != component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


@_carrying
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The benchmark's passages are cut out of the texts."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontaminate.remove_contamination(docs, benchmark, 10), docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers), and whether they decode to the text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, ["doc_id", "lang", "source"], round_trip=True).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot express the segment tree's encoding; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
