"""Problem 6: ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tokenizing import decode_column, encode_column
from tessera.session import read


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(read(spark, sf_dir, "documents"))


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each document's ids decode to."""
    return decode_column(p6_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_hash"))


QUERIES = {"p6_ids": p6_ids, "p6_text": p6_text}

SQL = {"p6_text": "select doc_id, md5(coalesce(text, '')) as text_hash from documents"}
