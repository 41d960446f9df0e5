"""Problem 2: pieces of chunks above the hard cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.splitting import split_oversized, token_estimate
from tessera.session import read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(read(spark, sf_dir, "chunks"))
    return pieces.where("n_pieces > 1").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    oversized = read(spark, sf_dir, "chunks").where("length(content) > 768").dropDuplicates(["chunk_id"])
    return split_oversized(oversized)


def p2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the pieces of each oversized chunk give when put together, and how many are above the cap, out of order or overlap too far."""
    p = p2_pieces(spark, sf_dir)
    core = F.substr("content", F.col("start") - F.col("overlap_start") + 1)
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("piece_no", core.alias("core")))), lambda x: x["core"])  # one chunk's text
    in_order = Window.partitionBy("chunk_id").orderBy("piece_no")
    gap = F.col("start") != F.coalesce(F.lag("end").over(in_order), F.lit(0))
    over = token_estimate(F.substr("content", F.lit(1), F.col("start") - F.col("overlap_start")), F.lit("text")) > 48
    p = p.withColumn("gap", gap).withColumn("far", over & (F.col("chunk_type") != "table"))
    return p.groupBy("chunk_id").agg(
        F.md5(F.array_join(pieces, "")).alias("text_hash"), F.count_if(F.col("token_est") > 768).alias("n_over"), F.count_if("gap").alias("n_gaps"), F.count_if("far").alias("n_far_overlaps")
    )


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_check": p2_check}

_OVERSIZED = r"""
with once as (select chunk_id, any_value(content) as content, any_value(chunk_type) as chunk_type from chunks where content is not null group by chunk_id),
bare as (select chunk_id, content, case when chunk_type = 'table' then regexp_replace(content, '<[^>]+>', ' ', 'g') else content end as t from once),
counted as (select chunk_id, content, length(t) as n, length(regexp_replace(t, '[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{30FF}\x{F900}-\x{FAFF}]', '', 'g')) as cjk from bare)
select chunk_id, md5(content) as text_hash, 0::bigint as n_over, 0::bigint as n_gaps, 0::bigint as n_far_overlaps from counted where cjk + (n - cjk) // 4 > 768"""

SQL = {
    "p2_check": _OVERSIZED,
    "p2_found": r"""
with bare as (
    select chunk_id, case when chunk_type = 'table' then regexp_replace(content, '<[^>]+>', ' ', 'g') else content end as t
    from chunks where content is not null),
counted as (
    select chunk_id, length(t) as n,
           length(regexp_replace(t, '[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{30FF}\x{F900}-\x{FAFF}]', '', 'g')) as cjk
    from bare)
select distinct chunk_id from counted where cjk + (n - cjk) // 4 > 768"""
}
