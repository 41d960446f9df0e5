"""Problem 4: text chunks that share most of their content (three words, 0.7, at least 20 words)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.neardup import class_table, similar_classes, similar_pairs
from tessera.session import read


def _similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = read(spark, sf_dir, "chunks").where("chunk_type = 'text'")
    return similar_classes(chunks, "chunk_id", "content", threshold=0.7, width=3, least_words=20)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(*_similar(spark, sf_dir)).toDF("chunk_id_a", "chunk_id_b")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_table(*_similar(spark, sf_dir)).withColumnRenamed("key", "chunk_id")


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}

_LINKS = r"""
with texts as (
    select chunk_id, any_value(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) as w
    from chunks where chunk_type = 'text' and content is not null group by chunk_id),
shingles as (
    select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s
    from texts where len(w) >= 20),
sizes as (select chunk_id, count(*) as n, md5(string_agg(s, '|' order by s)) as h from shingles group by chunk_id),
common as (
    select a.chunk_id as chunk_id_a, b.chunk_id as chunk_id_b, count(*) as o
    from shingles a join shingles b on a.s = b.s and a.chunk_id < b.chunk_id group by 1, 2),
links as (
    select chunk_id_a, chunk_id_b, x.h as h_a, y.h as h_b from common
    join sizes x on x.chunk_id = chunk_id_a join sizes y on y.chunk_id = chunk_id_b
    where o * 10 >= 7 * (x.n + y.n - o))"""

SQL = {
    "p4_found": f"{_LINKS} select chunk_id_a, chunk_id_b from links",
    "p4_classes": f"""{_LINKS},
classes as (select h, min(chunk_id) as class_id, count(*) as class_size from sizes group by h),
linked as (select c, count(*) as n from (select chunk_id_a as c from links where h_a <> h_b union all select chunk_id_b from links where h_a <> h_b) group by c)
select chunk_id, class_id, class_size, coalesce(linked.n, 0) as n_links from sizes join classes on classes.h = sizes.h left join linked on c = chunk_id""",
}
