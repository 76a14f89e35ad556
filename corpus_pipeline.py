"""From raw documents to packed sequences, in five stages that each read what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, near_dedup, outliers, packing, substring_dedup
from millrace.llm.common import discard, written
from millrace.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; rows with null or repeated ids are judged by their own text."""
    return outliers.without_outliers(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds. Those of which no word is left go; rows that share an id are one document here, null ids keep all lines."""
    ship_package(spark)
    return with_length(line_dedup.dedup_lines(docs, keep_emptied=False).select(docs.columns))


def with_length(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, if it is there, set to the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more. Rows with a null id or without words stay."""
    ship_package(spark)
    return near_dedup.without_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id, or the same further ahead, holds. Those of which no word is left go; rows with a null id stay as they are."""
    ship_package(spark)
    return with_length(substring_dedup.without_spans(docs, keep_emptied=False))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids; null and empty texts are one id, null and repeated ids are documents of their own."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("substring dedup", substrings), ("packing", pack)]
#: No SQL expresses the tokenizer's ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages keep of ``documents``. Each stage reads what the one before has written, which goes when the next is written.

    Null texts fail the quality rules. An empty table gives no pieces; columns beyond doc_id, text, lang and source are carried along, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
            if before is not None:
                discard(before)
            before = docs
    return docs
