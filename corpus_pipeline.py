"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept, written as
Parquet in between; all but the last return the columns of documents.
"""

from __future__ import annotations

import contextlib

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import byte_bpe, chunk_dedup, decontaminate, ecoc_langid, ngram_join
from attestra.llm.common import small, written


def _new(name: str, docs: DataFrame) -> str:
    """``name``, longer if a column of ``docs`` has it."""
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row that is the same each time it is read, and the name of that column.

    Ids may be null or repeat. A row of a Parquet table is known by its file, as a digest of the whole
    path, and its place in the file, so no copy is written; the rows of any other plan, whose order may
    change from one reading to the next, are written with a number each.
    """
    row = _new("row_", docs)
    # over a join or an explode a file's row may stand more than once, so only a plain scan has these keys
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        with contextlib.suppress(AnalysisException):  # files of other formats have no places
            place = docs.metadataColumn("_metadata")
            return docs.withColumn(row, F.struct(F.unhex(F.md5(place["file_path"])).alias("file"), place["row_index"].alias("at"))), row
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _without(docs: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """``docs`` less the rows whose keys are in ``gone``."""
    return docs.join(small(gone), row, "left_anti").drop(row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language can't be told: null texts and those without a letter. ``lang`` stays as it was."""
    lang, lettered = _new("lang_", docs), _new("lettered_", docs)
    made = (lang, _new("score_", docs), _new("ambiguous_", docs), lettered)
    judged = ecoc_langid.identify(docs, keep=tuple(c for c in docs.columns if c != "doc_id"), made=made)
    # where no row names its language nothing is learned, and `und` says nothing about the text
    return judged.where((F.col(lang) != ecoc_langid.UNDETERMINED) | F.col(lettered)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, one row stays: the one with the largest id, any id before null."""
    docs, row = _numbered(docs)
    named = docs.select(F.struct("doc_id", row).alias("id"), "text")
    copies = chunk_dedup.exact_duplicates(named, id_col="id").where(~F.col("kept"))
    return _without(docs, written(copies.select(f"id.{row}"), "copies"), row)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more over five-word n-grams, one row stays: the one with the smallest id, any id before null."""
    docs, row = _numbered(docs)
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row).alias("id"), "text")
    copies = ngram_join.near_duplicates(named, id_col="id").where(F.col("id") != F.col("component_id"))
    return _without(docs, written(copies.select(f"id.{row}"), "nears"), row)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item, or a whole shorter item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, row = _numbered(docs)
    leaks = decontaminate.contamination(docs, items, id_col=row).where("contaminated")
    return _without(docs, written(leaks.select(row), "leaks"), row)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every document left."""
    return byte_bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: The first and the last stage can't be said in SQL, nor the components of the third on whole tables: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
