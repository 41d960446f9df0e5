"""Queries on vectors and their index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.operators import vectors as V
from tessera.plans import tables as R
from tessera.session import read
from tessera.streaming import ingest as I


def _rows(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vec_search(spark, d):
    """VEC-05, TOP-01: ten nearest rows of every row whose id is divisible by 100."""
    rows = _rows(spark, d)
    return V.search(rows.where("id % 100 = 0"), rows, 10)


def vec_filtered_search(spark, d):
    """PRED-06: the same among rows of label 3 only, filtered before they are ranked."""
    rows = _rows(spark, d)
    return V.search(rows.where("id % 100 = 0"), rows.where("label = 3"), 5)


def vec_index_recall(spark, d):
    """VEC-03: queries, and whether the inverted-file index finds at least nine of ten true neighbours."""
    rows = _rows(spark, d)
    queries = rows.where("id % 100 = 0")
    truth, found = V.search(queries, rows, 10), V.search_lists(queries, rows, 10)
    hit = truth.select("query_id", "row_id").join(found.select("query_id", "row_id"), ["query_id", "row_id"], "left_semi")
    n = hit.groupBy("query_id").agg(F.count("*").alias("n"))
    by_query = truth.groupBy("query_id").agg(F.count("*").alias("k")).join(n, "query_id", "left")
    return by_query.agg(F.count("*").alias("n_queries"), (F.sum(F.coalesce("n", F.lit(0))) / F.sum("k") >= 0.9).alias("finds_enough"))


def vec_hits(spark, d):
    """VEC-05, TOOL-09: three nearest rows of label 3 to every query, with the title and content of the document of that number."""
    rows = _rows(spark, d)
    near = V.search(rows.where("id % 100 = 0"), rows.where("label = 3"), 3)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.coalesce("source", F.lit("unknown")).alias("title"), F.col("text").alias("content"))
    return V.hits(near, docs).select("query_id", "row_id", "score", "place", "title", F.md5("content").alias("content_hash"))


def vec_build_plan(spark, d):
    """VEC-04, PRED-05: which packages a build takes, some with a body changed since and some without chunks."""
    h = F.conv(F.substring("doc_id", 1, 4), 16, 10).cast("int")
    p = read(spark, d, "package_metadata").where("doc_id is not null").groupBy("doc_id").agg(F.max_by("content_hash", F.struct("loaded_at", "content_hash")).alias("content_hash"))
    bodies = p.select("doc_id", F.when(h % 5 == 0, "changed").otherwise(F.col("content_hash")).alias("body_hash"))
    counts = R.chunks(spark, d).where((h % 7 != 0) & F.col("content").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return V.build_plan(p, bodies, counts)


def vec_payload_filter(spark, d):
    """VEC-03: tables on pages 2 to 5 out of the written index of all chunks."""
    folder = I.workspace(spark, "index")
    c = R.chunks(spark, d)
    V.write_index(V.embed(c).join(c.select("chunk_id", "doc_id", "chunk_type", "page"), "chunk_id"), folder)
    return V.filtered(spark.read.parquet(folder), chunk_type="table", first_page=2, last_page=5).select("chunk_id", "doc_id", "page", F.size("vector").alias("dimensions"))


def vec_build_report(spark, d):
    """AGG-12, TOOL-08: what the sync of the two states does, in one row."""
    return V.build_report(*_versions(spark, d))


def vec_sync_ready(spark, d):
    """VEC-04: the index after a sync that refuses stale and empty packages."""
    now, then = _versions(spark, d)
    owners = R.chunks(spark, d).where("doc_id is not null").select("chunk_id", "doc_id")
    now = now.join(owners, "chunk_id")
    then = V.embed(then).withColumn("bare", F.regexp_replace("chunk_id", "^old-", "")).join(owners.withColumnRenamed("chunk_id", "bare"), "bare").drop("bare")
    return V.sync_ready(now, then, vec_build_plan(spark, d)).select("doc_id", "chunk_id", F.size("vector").alias("dimensions"))


def _versions(spark, d):
    """Chunks as they are, and an older state: every seventh id missing, every eleventh under another id."""
    now = R.chunks(spark, d).select("chunk_id", "embed_text")
    h = F.conv(F.substring("chunk_id", 1, 4), 16, 10).cast("int")
    then = now.where(h % 7 != 0).select(F.when(h % 11 == 0, F.concat(F.lit("old-"), "chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), "embed_text")
    return now, then


def vec_diff(spark, d):
    """JON-02 to JON-04, SET-03, SRC-15: what a sync would add, delete and keep."""
    add, gone, same = V.diff(*_versions(spark, d))
    tagged = [x.withColumn("action", F.lit(n)) for n, x in (("add", add), ("delete", gone), ("keep", same))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def vec_sync(spark, d):
    """VEC-01, SNK-08, STR-09: the index after a sync."""
    now, then = _versions(spark, d)
    state = V.sync(now, V.embed(then))
    return state.select("chunk_id", F.size("vector").alias("dimensions"))


def vec_stale(spark, d):
    """PRED-05: packages whose latest build differs from an earlier one's hash."""
    p = read(spark, d, "package_metadata").groupBy("doc_id").agg(F.max_by("content_hash", "loaded_at").alias("latest"), F.min_by("content_hash", "loaded_at").alias("first"))
    return p.where("latest <> first").select("doc_id", "latest", "first")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("vec_")}


def _search(where: str, k: int) -> str:
    return f"""
with s as (select q.vec_id as query_id, r.vec_id as row_id, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 4) as score
    from embeddings q, embeddings r where q.vec_id % 100 = 0{where})
select * from (select *, row_number() over (partition by query_id order by score desc, row_id) as place from s) where place <= {k}"""


VERSIONS = """now as (select distinct chunk_id from chunks), h as (select chunk_id, ('0x' || substr(chunk_id, 1, 4))::int as h from now),
then_ as (select case when h % 11 = 0 then 'old-' || chunk_id else chunk_id end as chunk_id from h where h % 7 <> 0)"""
PLAN = """p as (select doc_id, max_by(content_hash, struct_pack(loaded_at, content_hash)) as content_hash from package_metadata where doc_id is not null group by 1),
c0 as (select chunk_id, max_by(struct_pack(doc_id, content), struct_pack(indexed_at, seq)) as r from chunks group by chunk_id), owners as (select chunk_id, r.doc_id as doc_id, r.content as content from c0),
k as (select doc_id, count(*) as n from owners where content is not null and ('0x' || substr(doc_id, 1, 4))::int % 7 <> 0 group by 1),
plan as (select p.doc_id, case when ('0x' || substr(p.doc_id, 1, 4))::int % 5 = 0 then 'stale' when coalesce(n, 0) = 0 then 'empty' else 'ready' end as state from p left join k on k.doc_id = p.doc_id)"""
SQL = {
    "vec_index_recall": "select count(*) filter (vec_id % 100 = 0) as n_queries, true as finds_enough from embeddings",
    "vec_hits": f"with h as ({_search(' and r.label = 3', 3)}) select query_id, row_id, score, place, case when doc_id is null then null else coalesce(source, 'unknown') end as title, md5(substr(text, 1, 1500)) as content_hash from h left join documents on doc_id = row_id",
    "vec_build_plan": f"with {PLAN} select doc_id, state from plan",
    "vec_payload_filter": "with c as (select chunk_id, max_by(struct_pack(doc_id, chunk_type, page), struct_pack(indexed_at, seq)) as r from chunks group by 1) select chunk_id, r.doc_id as doc_id, r.page as page, 32 as dimensions from c where r.chunk_type = 'table' and r.page between 2 and 5",
    "vec_build_report": f"with {VERSIONS} select (select count(*) from now where chunk_id not in (select chunk_id from then_)) as embedded, (select count(*) from now where chunk_id in (select chunk_id from then_)) as unchanged, (select count(*) from then_ where chunk_id not in (select chunk_id from now)) as deleted, (select count(*) from now) as total",
    "vec_sync": f"with {VERSIONS} select chunk_id, 32 as dimensions from now",
    "vec_sync_ready": f"""with {VERSIONS}, {PLAN}, o as (select owners.doc_id, owners.chunk_id, coalesce(state, 'none') as state from owners left join plan on plan.doc_id = owners.doc_id where owners.doc_id is not null)
select doc_id, chunk_id, 32 as dimensions from o where state = 'ready' union all select o.doc_id, t.chunk_id, 32 from then_ t join o on o.chunk_id = replace(t.chunk_id, 'old-', '') where state <> 'ready'""",
    "vec_search": _search("", 10),
    "vec_filtered_search": _search(" and r.label = 3", 5),
    "vec_diff": f"with {VERSIONS} select chunk_id, 'add' as action from now where chunk_id not in (select chunk_id from then_) union all select chunk_id, 'delete' from then_ where chunk_id not in (select chunk_id from now) union all select chunk_id, 'keep' from now where chunk_id in (select chunk_id from then_)",
    "vec_stale": "with p as (select doc_id, max_by(content_hash, loaded_at) as latest, min_by(content_hash, loaded_at) as first from package_metadata group by 1) select doc_id, latest, first from p where latest <> first",
}
