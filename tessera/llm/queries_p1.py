"""Problem 1: clean text of the markup in text chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.markup import clean_texts
from tessera.session import read


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "chunks").where("chunk_type = 'text'")
    return chunks.select(
        F.col("chunk_id").alias("record_id"),
        F.col("doc_id").alias("host"),
        F.stack(F.lit(2), F.lit("content"), F.col("content"), F.lit("embed_text"), F.col("embed_text")).alias("field_name", "text"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose tree has an element: one that went as a template of its host, or one that was left and written plainly."""
    found = clean_texts(_texts(spark, sf_dir)).where(F.col("n_removed") + F.col("n_left") > 0)
    return found.select(F.col("record_id").alias("chunk_id"), "field_name").distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clean_texts(_texts(spark, sf_dir))
    return clean.groupBy(F.col("record_id").alias("chunk_id"), "field_name").agg(*(F.max(c).alias(c) for c in ("clean", "kinds", "n_left", "n_removed")))


def p1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each field: its texts, and how many clean ones still hold a comment, a wiki link or a LaTeX heading outside code and formulas."""
    bare = F.regexp_replace("clean", r"(?s)```.*?(?:```|\z)|\$[^$]*\$", "")
    return p1_clean(spark, sf_dir).groupBy("field_name").agg(
        F.count("*").alias("n_texts"), F.count_if(bare.contains("<!--")).alias("n_comments"), F.count_if(bare.rlike(r"\[\[[^\[\]]+\]\]")).alias("n_links"), F.count_if(bare.rlike(r"\\(?:sub)*section\*?\{")).alias("n_headings")
    )


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p1_check": p1_check}

SQL = {
    "p1_check": """
select field_name, count(*) as n_texts, 0::bigint as n_comments, 0::bigint as n_links, 0::bigint as n_headings from (
    select distinct chunk_id, 'content' as field_name from chunks where chunk_type = 'text' and content is not null union all select distinct chunk_id, 'embed_text' from chunks where chunk_type = 'text' and embed_text is not null) group by 1"""
}
