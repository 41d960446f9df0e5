"""Problem 7: documents in containers of each size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.packing import fill_containers
from tessera.llm.tokenizing import count_tokens
from tessera.session import read


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read(spark, sf_dir, "container_sizes").select("container_kind", "capacity_tokens").distinct()
    capacities = sorted((r[0], r[1]) for r in kinds.collect() if r[0] is not None and r[1])  # a fixed table of three rows
    parts = fill_containers(count_tokens(read(spark, sf_dir, "documents")), capacities)
    return parts.select("container_kind", "container_id", F.col("key").cast("long").alias("doc_id"), "part_no", "part_start", "n_tokens")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each kind are filled."""
    sizes = read(spark, sf_dir, "container_sizes").select("container_kind", "capacity_tokens").distinct()
    used = p7_assignment(spark, sf_dir).groupBy("container_kind").agg(
        F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")
    )
    return used.join(sizes, "container_kind").select(
        "container_kind", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 4).alias("fill")
    )


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an assignment must keep, for each kind: every document in it, nothing above capacity, nothing split that fits, parts that join."""
    sizes = read(spark, sf_dir, "container_sizes").select("container_kind", "capacity_tokens").distinct()
    parts = p7_assignment(spark, sf_dir).join(sizes, "container_kind")
    over = parts.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("fill"), F.max("capacity_tokens").alias("c")).where("fill > c")
    whole = parts.groupBy("container_kind", "doc_id").agg(
        F.count("*").alias("n_parts"), F.sum("n_tokens").alias("n"), F.max("capacity_tokens").alias("c"), F.max(F.col("part_start") + F.col("n_tokens")).alias("end"),
        F.count_distinct("part_no").alias("n_numbers"),
    )
    bad = (F.col("n") != F.col("end")) | (F.col("n_parts") != F.col("n_numbers"))
    by_kind = whole.groupBy("container_kind").agg(
        F.count("*").alias("n_documents"), F.count_if((F.col("n_parts") > 1) & (F.col("n") <= F.col("c"))).alias("n_split_that_fit"), F.count_if(bad).alias("n_with_gaps")
    )
    return by_kind.join(over.groupBy("container_kind").agg(F.count("*").alias("n_over")), "container_kind", "left").select(
        "container_kind", "n_documents", "n_split_that_fit", "n_with_gaps", F.coalesce("n_over", F.lit(0)).alias("n_over")
    )


QUERIES = {"p7_assignment": p7_assignment, "p7_fill": p7_fill, "p7_check": p7_check}

SQL = {
    "p7_check": "select distinct container_kind, (select count(distinct doc_id) from documents) as n_documents, 0::bigint as n_split_that_fit, 0::bigint as n_with_gaps, 0::bigint as n_over from container_sizes"
}
