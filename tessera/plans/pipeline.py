"""Queries that run the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pipeline as W
from tessera.plans import audit as A
from tessera.plans import regions as X
from tessera.session import read


def pipe_tables(spark, d):
    """TOOL-05, REP-RUN, AUD-RUN: tables with fused headers through the chain, their pages' boxes at hand."""
    lines, words = X.fused_tables(spark, d)
    docs = W.text_of(lines.withColumnRenamed("chunk_id", "doc_id"))
    docs = docs.select("doc_id", "text", F.lit(1).alias("page_count"), F.lit(1).alias("expected_tables"), F.lit(0).alias("n_degraded"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    s = W.run(docs, words.withColumnRenamed("chunk_id", "doc_id")).status
    return s.select("doc_id", "critical_before", "critical_after", "n_repaired", "n_reported", "verdict", (F.col("n_chunks") > 0).alias("has_chunks"))


def pipe_reports(spark, d):
    """TOOL-10, STR-01: every report's run through the chain; failed runs are rows with their error."""
    e = read(spark, d, "extract_reports").groupBy("report_id").agg(
        F.first("full_text_md").alias("text"), F.max("page_count").alias("page_count"), F.max("table_count").alias("expected_tables"), F.bool_and("ok").alias("ok"), F.max("error").alias("error"), F.first("doc_id").alias("package")
    )
    packages = read(spark, d, "package_metadata").where("doc_id is not null").groupBy(F.col("doc_id").alias("package")).agg(F.max(F.size("degraded_segments")).alias("n_degraded"))
    e = e.join(packages, "package", "left")
    docs = e.select(F.col("report_id").alias("doc_id"), "text", "page_count", "expected_tables", "n_degraded", F.when(F.col("ok"), "ok").otherwise("missing").alias("status"), "error")
    s = W.run(docs).status
    return s.select("doc_id", "error", "verdict", (F.col("n_chunks") > 0).alias("has_chunks"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("pipe_")}

SQL = {
    "pipe_reports": f"""with q as ({A.SQL['qc_gate']}), e as (select report_id, bool_and(ok) as ok, max(error) as error from extract_reports group by 1)
select e.report_id as doc_id, error, case when ok then coalesce(verdict, 'FAILED') else 'FAILED' end as verdict, coalesce(ok and verdict <> 'HALT', false) as has_chunks from e left join q on q.report_id = e.report_id""",
    "pipe_tables": f"""with {X.CELLS}, fh as (select a.chunk_id, a.c, trim(a.cell || ' ' || coalesce(b.cell, '')) as f from cell a left join cell b on b.chunk_id = a.chunk_id and b.c = a.c and b.k = 2 where a.k = 1),
fu as (select chunk_id, count(*) filter (regexp_matches(f, '{X.NUMBER}')) >= 2 as fused, '| ' || string_agg(f, ' | ' order by c) || ' |' as head, count(*) as n from fh group by 1),
r as ({X.FUSED}),
tx as (select fu.chunk_id, fused, status, head || chr(10) || '|' || repeat('---|', n) || chr(10) || string_agg('| ' || array_to_string(rows[k], ' | ') || ' |', chr(10) order by k) as t, built from fu left join r on r.chunk_id = fu.chunk_id
    join (select *, unnest(range(3, len(rows) + 1)) as k from grid) g on g.chunk_id = fu.chunk_id group by fu.chunk_id, fused, status, head, n, built),
v as (select *, case when length(case when status = 'repaired' then built else t end) < 50 then 'HALT' else 'WARN' end as verdict from tx)
select chunk_id as doc_id, case when fused then 1 else 0 end::bigint as critical_before, case when fused and status = 'reported' then 1 else 0 end::bigint as critical_after,
    case when status = 'repaired' then 1 else 0 end::bigint as n_repaired, case when status = 'reported' then 1 else 0 end::bigint as n_reported, verdict, verdict <> 'HALT' as has_chunks from v""",
}
