"""Shared relations that queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.session import read


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (report_id, doc_id, text, page_count, metadata) for each report with a text."""
    rows = read(spark, sf_dir, "extract_reports").where("full_text_md is not null")
    return rows.groupBy("report_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("full_text_md").alias("text"),
        F.max("page_count").alias("page_count"),
        F.first("metadata").alias("metadata"),
    )


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(reports(spark, sf_dir), "report_id")


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "chunks").where("chunk_type = 'table' and content is not null")
    return rows.groupBy("chunk_id").agg(F.first("content").alias("text"))


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table_chunks(spark, sf_dir), "chunk_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk once, by its latest delivery."""
    rows = read(spark, sf_dir, "chunks")
    latest = F.max_by(F.struct(*(c for c in rows.columns if c != "chunk_id")), F.struct("indexed_at", "seq"))
    return rows.groupBy("chunk_id").agg(latest.alias("r")).select("chunk_id", "r.*")


def lines_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    exploded = df.select(key, F.posexplode(T.split_lines(F.col(text))).alias("pos", "line"))
    return exploded.select(key, (F.col("pos") + 1).cast("long").alias("line_no"), "line")
