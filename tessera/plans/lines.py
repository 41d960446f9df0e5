"""Queries over the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.plans import _sql as S
from tessera.session import read


def with_running_headers(docs: DataFrame, lines: str, least: int = 4, longest: int = 60) -> DataFrame:
    """Adds ``headers``: the short lines that occur at least ``least`` times in each document's own array of lines.

    In the sorted array a line that occurs so often equals the one ``least`` - 1 places later.
    """
    short = F.sort_array(F.filter(F.transform(lines, lambda x: T.strip(x)), lambda x: F.length(x).between(1, longest - 1)))
    docs = docs.withColumn("short", F.when(F.size(lines) >= least, short).otherwise(F.array().cast("array<string>")))
    pairs = F.zip_with("short", F.slice("short", F.lit(least), F.greatest(F.size("short"), F.lit(1))), lambda x, y: F.when(x == y, x))
    headers = F.filter(F.array_distinct(F.array_compact(pairs)), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return docs.withColumn("headers", headers).drop("short")


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and tokens by source without running headers; documents are rows, so only the sums are shuffled."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.coalesce("source", F.lit("unknown")).alias("source"), T.split_lines(F.col("text")).alias("lines"))
    lines = with_running_headers(docs, "lines").select("source", "headers", F.explode("lines").alias("line")).withColumn("line", T.strip(F.col("line")))
    kept = lines.where((F.size("headers") == 0) | ~F.array_contains("headers", F.col("line")))
    return kept.groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(T.estimate_tokens(F.col("line"))).alias("n_tokens"))


QUERIES = {"corpus_summary": corpus_summary}
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{30FF}\x{F900}-\x{FAFF}]"
SQL = {
    "corpus_summary": rf"""
with {S.lines('documents', 'doc_id')}, l as (select l.doc_id, coalesce(source, 'unknown') as source, {S.strip('line')} as line from lines l join documents d on d.doc_id = l.doc_id),
h as (select doc_id, line from l where length(line) > 0 and length(line) < 60 and regexp_matches(line, '[\p{{L}}\p{{N}}]') group by 1, 2 having count(*) >= 4),
k as (select l.* from l where not exists (select 1 from h where h.doc_id = l.doc_id and h.line = l.line)),
t as (select source, length(line) as n, length(line) - length(regexp_replace(line, '{CJK}', '', 'g')) as cjk from k)
select source, count(*) as n_lines, sum(cjk + (n - cjk) // 4)::bigint as n_tokens from t group by 1"""
}
