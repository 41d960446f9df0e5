"""Queries for sources, sinks, packages, jobs, classification and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.functions import unicode as U
from tessera.operators import classify as K
from tessera.operators import packaging as P
from tessera.plans import _sql as S
from tessera.plans import layers as L
from tessera.plans import tables as R
from tessera.sources import documents as D
from tessera.streaming import ingest as I
from tessera.session import read


def _packages(spark, d):
    """The latest build of each package."""
    p = read(spark, d, "package_metadata").where("doc_id is not null")
    latest = F.max_by(F.struct("title", "source_pdf", "pages", "generator", "content_hash", "loaded_at", "summary"), F.struct("loaded_at", "content_hash"))
    return p.groupBy("doc_id").agg(latest.alias("r")).select("doc_id", "r.*")


def snk_chunks_jsonl(spark, d):
    """SNK-01, SRC-11: all chunks written as JSON lines and read again."""
    folder = I.workspace(spark, "chunks-jsonl")
    D.write_chunks(R.chunks(spark, d), folder)
    back = D.read_chunks(spark, folder)
    return back.select("chunk_id", "doc_id", "seq", F.array_join("heading_path", "/").alias("path"), "page", "chunk_type", F.md5("content").alias("content_hash"), "token_est")


def snk_front_matter(spark, d):
    """SNK-04: front matter of every package."""
    f = P.front_matter(F.col("title"), F.col("doc_id"), F.col("source_pdf"), F.col("pages"), F.lit("PASS"), F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss"), F.col("generator"))
    return _packages(spark, d).select("doc_id", f.alias("front_matter"))


def snk_readme(spark, d):
    """SNK-05: maps of packages, with a row of tables only where there are any."""
    n = R.chunks(spark, d).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_type") == "table").alias("n_tables"))
    p = _packages(spark, d).join(n, "doc_id").where("title is not null")
    return p.select("doc_id", P.readme(F.col("title"), U.slug(F.col("title"), F.col("doc_id")), F.col("n_chunks"), F.col("n_tables")).alias("readme"))


def snk_manifest(spark, d):
    """SNK-06: a row for each file of each package, its chunks' contents."""
    return P.manifest(_files(spark, d), "doc_id")


def _files(spark, d):
    return R.chunks(spark, d).where("doc_id is not null and content is not null").select("doc_id", F.concat(F.lit("chunks/"), "chunk_id").alias("path"), "content")


def snk_metadata(spark, d):
    """SNK-06: metadata of each package, with a digest of its files."""
    p = _packages(spark, d).select("doc_id", "title", U.slug(F.col("title"), F.col("doc_id")).alias("slug"), F.col("source_pdf").alias("source"), "pages")
    return P.metadata(p, _files(spark, d), "doc_id")


def snk_csv(spark, d):
    """SNK-02: rows of all pipe tables as CSV records."""
    rows = R.table_lines(spark, d).where(T.is_pipe_row(F.col("line")) & ~T.is_separator(F.col("line")))
    return rows.select("chunk_id", "line_no", D.csv_line(T.cells(F.col("line"))).alias("record"))


def snk_table_files(spark, d):
    """SNK-02: the CSV file of each table; tables without a filled cell have none but are counted."""
    rows = R.table_lines(spark, d).where(T.is_pipe_row(F.col("line")) & ~T.is_separator(F.col("line"))).withColumn("cells", T.cells(F.col("line")))
    record = F.struct("line_no", D.csv_line(F.col("cells")).alias("record"))
    texts = rows.groupBy("chunk_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(record)), lambda x: x["record"]), "\n").alias("csv"), F.max(F.exists("cells", lambda c: c != "")).alias("filled")
    )  # one table's rows
    tables = R.chunks(spark, d).where("chunk_type = 'table' and doc_id is not null and content is not null").select("doc_id", "chunk_id", "page", "seq")
    named = P.table_files(tables, "doc_id", "page", ["seq", "chunk_id"]).join(texts, "chunk_id").where("filled")
    return named.select("doc_id", "chunk_id", "file", F.md5("csv").alias("csv_hash"))


def snk_slugs(spark, d):
    """SNK-03: slugs of packages, told apart where documents share a title."""
    p = _packages(spark, d)
    return P.unique_slugs(p.select("doc_id", U.slug(F.col("title"), F.col("doc_id")).alias("slug")))


def snk_assemble(spark, d):
    """SNK-03: slugs of packages written again beside folders of some of them, of others and of unknown documents."""
    p = _packages(spark, d).select("doc_id", U.slug(F.col("title"), F.col("doc_id")).alias("slug"))
    h = F.conv(F.substring("doc_id", 1, 4), 16, 10).cast("int")
    folders = p.where(h % 3 != 0).select("slug", F.when(h % 3 == 1, F.col("doc_id")).when(h % 2 == 0, F.concat(F.lit("x"), "doc_id")).alias("doc_id"))
    return P.assemble_slugs(p, folders)


def snk_export(spark, d):
    """SNK-07, JON-13, STR-10: what an export to an older copy would do."""
    p = _packages(spark, d).select(F.col("doc_id").alias("slug"), F.col("content_hash").alias("hash"))
    h = F.conv(F.substring("slug", 1, 4), 16, 10).cast("int")
    vault = p.where(h % 3 != 0).select(F.when(h % 5 == 0, F.concat(F.lit("x"), "slug")).otherwise(F.col("slug")).alias("slug"), F.when(h % 7 == 0, F.lit(None)).when(h % 11 == 0, F.lit("other")).otherwise(F.col("hash")).alias("hash"))
    return P.export_actions(p, vault)


def src_known(spark, d):
    """JON-05, SRC-12: reports of documents that the packages of an older state (ids below 8) don't know."""
    r = R.reports(spark, d).where("doc_id is not null")
    known = read(spark, d, "package_metadata").where("doc_id < '8'").select("doc_id").distinct()
    return r.join(known, "doc_id", "left_anti").select("report_id", "doc_id")


def src_doc_info(spark, d):
    """SRC-13, SRC-14, TOOL-14: title, creator and file of each document, with page count, tables and images over its runs."""
    e = read(spark, d, "extract_reports").where("doc_id is not null").dropDuplicates(["report_id"])
    stem = F.max(F.try_element_at("metadata", F.lit("stem"))).alias("stem")
    runs = e.groupBy("doc_id").agg(F.coalesce(F.max("page_count"), F.lit(0)).alias("pages"), F.max("table_count").alias("tables"), F.max("image_count").alias("images"), F.count("*").alias("runs"), stem)
    p = _packages(spark, d).select("doc_id", "title", F.col("generator").alias("creator"))
    return runs.join(p, "doc_id", "left").select("doc_id", T.derive_title(F.col("title"), F.col("stem")).alias("title"), "creator", "pages", "tables", "images", "runs")


def cls_documents(spark, d):
    """CLS-01, CLS-02, AGG-06, TOOL-13: type of every report's document by file stem and first pages, with features and whether it is a scan."""
    r = R.reports(spark, d)
    first_pages = F.array_join(F.slice(T.split_lines(F.col("text")), 1, 5 * 40), "\n")  # the classifier looks at five pages, here of 40 lines
    docs = r.select(F.col("report_id").alias("doc_id"), F.try_element_at("metadata", F.lit("stem")).alias("name"), first_pages.alias("sample"), F.col("page_count").alias("pages"))
    scans = L.pred_scanned(spark, d).select(F.col("report_id").alias("doc_id"), F.col("scanned").alias("is_scanned"), F.col("textless"))
    return K.classify(docs).join(scans, "doc_id", "left")


def top_recent_jobs(spark, d):
    """TOP-03: the ten latest jobs (a report of ten is the feature)."""
    j = read(spark, d, "jobs").groupBy("job_id").agg(F.max("created_at").alias("created_at"))
    return j.orderBy(F.desc("created_at"), "job_id").limit(10)


def top_jobs_kept(spark, d):
    """TOP-04: jobs that retention keeps: the newest 500 of those within 30 days of the latest."""
    j = read(spark, d, "jobs").groupBy("job_id").agg(F.max("created_at").alias("created_at"))
    latest = j.agg(F.max("created_at").alias("latest"))
    recent = j.join(F.broadcast(latest), F.col("created_at") >= F.col("latest") - 30 * 86400).select("job_id", "created_at")
    return recent.orderBy(F.desc("created_at"), "job_id").limit(500)


def top_tables(spark, d):
    """TOP-05: at most 30 tables and 20 figures of each document, the first ones (a cap that is the feature)."""
    t = R.chunks(spark, d).where("chunk_type in ('table', 'figure') and doc_id is not null and content is not null")
    w = Window.partitionBy("doc_id", "chunk_type").orderBy("seq", "chunk_id")
    kept = t.withColumn("place", F.row_number().over(w)).where("place <= 30 and (chunk_type = 'table' or place <= 20)")
    return kept.select("doc_id", "chunk_type", "chunk_id", "place")


def agg_batch(spark, d):
    """AGG-09: runs by outcome and engine."""
    e = read(spark, d, "extract_reports").dropDuplicates(["report_id"])
    return e.groupBy("engine").agg(F.count("*").alias("total"), F.count_if("ok").alias("converted"), F.count_if(~F.col("ok")).alias("failed"))


def set_segments(spark, d):
    """SET-07: the distinct segments of each document as one digest that depends on their places, with those of unknown page."""
    c = R.chunks(spark, d).where("doc_id is not null and content is not null")
    placed = P.digest(c, "doc_id", F.col("seq"), F.col("chunk_id"), F.md5("content"))
    return placed.join(c.groupBy("doc_id").agg(F.count_if(F.col("page").isNull()).alias("n_unplaced")), "doc_id").select("doc_id", "n", F.col("digest").alias("text_digest"), "n_unplaced")


def str_ingest(spark, d):
    """STR-01: chunks through a stream, each id once."""
    out, state = I.workspace(spark, "ingest"), I.workspace(spark, "ingest-state")
    I.ingest(spark, f"{d}/chunks.parquet", out, state, "chunk_id")
    return spark.read.parquet(out).select("chunk_id", "doc_id", "chunk_type")


def str_merge(spark, d):
    """STR-09: the same through micro-batches merged into a table by id."""
    target, state = I.workspace(spark, "merge"), I.workspace(spark, "merge-state")
    I.merge_batches(I.stream_table(spark, f"{d}/chunks.parquet", 4), target, state, "chunk_id")
    return spark.read.parquet(target).select("chunk_id", "chunk_type")


def str_windows(spark, d):
    """An addition: hourly windows of events behind a watermark."""
    return I.window_counts(read(spark, d, "events"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith(("snk_", "src_", "cls_", "top_", "agg_", "set_", "str_")) and callable(v)}

CHUNKS = "c0 as (select chunk_id, max_by(struct_pack(doc_id, seq, heading_path, page, chunk_type, content, token_est), struct_pack(indexed_at, seq)) as r from chunks group by chunk_id), c as (select chunk_id, r.doc_id as doc_id, r.seq as seq, r.heading_path as heading_path, r.page as page, r.chunk_type as chunk_type, r.content as content, r.token_est as token_est from c0)"
PACKAGES = "p0 as (select doc_id, max_by(struct_pack(title, source_pdf, pages, generator, content_hash, loaded_at), struct_pack(loaded_at, content_hash)) as r from package_metadata where doc_id is not null group by doc_id), p as (select doc_id, r.title as title, r.source_pdf as source_pdf, r.pages as pages, r.generator as generator, r.content_hash as content_hash, r.loaded_at as loaded_at from p0)"
SLUG = r"""a_ as (select *, regexp_replace(nfc_normalize(coalesce(title, '')), '[<>:"/\\|?*#^\[\]{}\x00-\x1f＜＞：＂／＼｜？＊]', ' ', 'g') as s0 from p),
b_ as (select *, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(s0, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\s\p{Z}]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 60), '[-.]+$', '') as s1 from a_),
s as (select *, case when s1 = '' then doc_id else s1 end as slug from b_)"""


def _yq(x: str) -> str:
    return f"""'"' || replace(replace(coalesce({x}, ''), '\\', '\\\\'), '"', '\\"') || '"'"""


SQL = {
    "snk_chunks_jsonl": f"with {CHUNKS} select chunk_id, doc_id, seq, array_to_string(heading_path, '/') as path, page, chunk_type, md5(content) as content_hash, token_est from c",
    "snk_front_matter": f"""with {PACKAGES} select doc_id, '---' || chr(10) || 'title: ' || {_yq('title')} || chr(10) || 'doc_id: ' || {_yq('doc_id')} || chr(10) || 'source: ' || {_yq('source_pdf')} || chr(10)
    || 'pages: ' || coalesce(pages::varchar, '0') || chr(10) || 'qc_verdict: "PASS"' || chr(10) || 'converted: ' || {_yq("strftime(loaded_at, '%Y-%m-%d %H:%M:%S')")} || chr(10) || 'generator: ' || {_yq('generator')} || chr(10) || '---' || chr(10) || chr(10) as front_matter from p""",
    "snk_readme": f"""with {CHUNKS}, {PACKAGES}, {SLUG}, n as (select doc_id, count(*) as n_chunks, count(*) filter (chunk_type = 'table') as n_tables from c where doc_id is not null group by 1)
select s.doc_id, '# ' || title || chr(10) || '| path | content |' || chr(10) || '|---|---|' || chr(10) || '| ' || slug || '.md | text |' || chr(10) || '| data/chunks.jsonl | ' || n_chunks || ' chunks |'
    || case when n_tables > 0 then chr(10) || '| tables/ | ' || n_tables || ' tables |' else '' end as readme from s join n on n.doc_id = s.doc_id where title is not null""",
    "snk_manifest": f"with {CHUNKS} select doc_id, 'chunks/' || chunk_id as path, substr(sha256(content), 1, 16) as sha256, strlen(content)::bigint as bytes from c where doc_id is not null and content is not null",
    "snk_metadata": f"""with {CHUNKS}, {PACKAGES}, {SLUG},
f as (select doc_id, 'chunks/' || chunk_id as path, substr(sha256(content), 1, 16) as sha, strlen(content)::bigint as b from c where doc_id is not null and content is not null),
g as (select doc_id, count(*) as n, sum(b)::bigint as b, sum(('0x' || substr(md5(path || '|' || sha), 1, 15))::bigint)::hugeint::varchar as h from f group by 1)
select s.doc_id, '{{"schema_version":"1","doc_id":' || to_json(s.doc_id)::varchar || ',"title":' || coalesce(to_json(title)::varchar, 'null') || ',"slug":' || to_json(slug)::varchar || ',"source":' || coalesce(to_json(source_pdf)::varchar, 'null')
    || ',"pages":' || coalesce(pages::varchar, 'null') || ',"files":' || coalesce(n, 0) || ',"bytes":' || coalesce(b, 0) || ',"content_hash":' || coalesce('"' || h || '"', 'null') || '}}' as metadata from s left join g on g.doc_id = s.doc_id""",
    "snk_table_files": rf"""with {CHUNKS}, {S.TABLES}, {S.lines('tables', 'chunk_id')}, r as (select chunk_id, line_no, {S.cells('line')} as cells from lines where regexp_matches({S.strip('line')}, '^\|.*\|$') and not (regexp_full_match(line, '\s*\|?[\s:|-]+\|?\s*') and contains(line, '-'))),
t as (select chunk_id, md5(string_agg(array_to_string(list_transform(cells, lambda x: case when regexp_matches(x, '[",\r\n]') then '"' || replace(x, '"', '""') || '"' else x end), ','), chr(10) order by line_no)) as csv_hash,
    bool_or(len(list_filter(cells, lambda x: x <> '')) > 0) as filled from r group by 1),
k as (select doc_id, chunk_id, 'p' || coalesce(page, 0) || '_table_' || row_number() over (partition by doc_id order by coalesce(page, 0), seq nulls first, chunk_id) || '.csv' as file from c where chunk_type = 'table' and doc_id is not null and content is not null)
select doc_id, k.chunk_id, file, csv_hash from k join t on t.chunk_id = k.chunk_id where filled""",
    "snk_assemble": f"""with {PACKAGES}, {SLUG}, h as (select doc_id, slug, ('0x' || substr(doc_id, 1, 4))::int as h from s),
fo as (select slug, case when h % 3 = 1 then doc_id when h % 2 = 0 then 'x' || doc_id end as owner from h where h % 3 <> 0),
own as (select owner as doc_id, min(slug) as slug from fo where owner is not null group by 1), fresh as (select doc_id, slug from h where doc_id not in (select doc_id from own)),
firsts as (select slug, min(doc_id) as first_doc from fresh group by 1)
select h.doc_id, own.slug from h join own on own.doc_id = h.doc_id
union all select f.doc_id, case when f.doc_id <> first_doc or f.slug in (select slug from fo) then f.slug || '-' || substr(f.doc_id, 1, 8) else f.slug end from fresh f join firsts on firsts.slug = f.slug""",
    "snk_csv": rf"""with {S.TABLES}, {S.lines('tables', 'chunk_id')} select chunk_id, line_no, array_to_string(list_transform({S.cells('line')}, lambda x: case when regexp_matches(x, '[",\r\n]') then '"' || replace(x, '"', '""') || '"' else x end), ',') as record
from lines where regexp_matches({S.strip('line')}, '^\|.*\|$') and not (regexp_full_match(line, '\s*\|?[\s:|-]+\|?\s*') and contains(line, '-'))""",
    "snk_slugs": f"with {PACKAGES}, {SLUG}, o as (select slug, min(doc_id) as owner from s group by 1) select doc_id, case when doc_id = owner then s.slug else s.slug || '-' || substr(doc_id, 1, 8) end as slug from s join o on o.slug = s.slug",
    "snk_export": f"""with {PACKAGES}, h as (select doc_id as slug, content_hash as hash, ('0x' || substr(doc_id, 1, 4))::int as h from p),
v as (select case when h % 5 = 0 then 'x' || slug else slug end as slug, case when h % 7 = 0 then null when h % 11 = 0 then 'other' else hash end as hash from h where h % 3 <> 0)
select coalesce(h.slug, v.slug) as slug, case when h.slug is null then 'keep' when v.slug is null then 'copy' when h.hash = v.hash then 'skip' else 'conflict' end as action from h full join v on v.slug = h.slug""",
    "src_known": f"with {S.REPORTS} select report_id, doc_id from reports where doc_id is not null and doc_id not in (select doc_id from package_metadata where doc_id < '8')",
    "src_doc_info": rf"""with {PACKAGES}, e as (select report_id, any_value(doc_id) as doc_id, max(page_count) as p, max(table_count) as t, max(image_count) as i, max(metadata['stem']) as stem from extract_reports where doc_id is not null group by 1),
g as (select doc_id, coalesce(max(p), 0) as pages, max(t) as tables, max(i) as images, count(*) as runs, max(stem) as stem from e group by 1), j as (select g.*, {S.strip('p.title')} as t, p.generator as creator from g left join p on p.doc_id = g.doc_id)
select doc_id, case when length(t) between 4 and 200 and length(regexp_replace(t, '\P{{L}}', '', 'g')) >= 4 and not regexp_matches(lower(t), '\.(pdf|docx?|tex|dvi|indd|pptx?|xlsx?)$') then t else stem end as title, creator, pages, tables, images, runs from j""",
    "cls_documents": rf"""with {S.REPORTS}, {S.lines('reports', 'report_id')}, five as (select report_id, string_agg(line, chr(10) order by line_no) as sample from lines where line_no <= 200 group by 1),
f as (select r.report_id as doc_id, lower(coalesce(metadata['stem'], '')) as name, coalesce(sample, '') as sample, coalesce(page_count, 0) as pages from reports r left join five on five.report_id = r.report_id),
g as (select *, regexp_matches(sample, '(?i)\$[^$]+\$|\\frac|\\sum|\\int|\\begin\{{equation|\\begin\{{align') as formulas, regexp_matches(sample, '(?m)^\|.+\|$') as tables,
    len(regexp_extract_all(sample, '[\x{{4E00}}-\x{{9FFF}}]')) as cjk, len(regexp_extract_all(sample, '[A-Za-z]')) as latin from f),
h as (select *, {', '.join(f"{'+'.join(f'contains(name, {w!r})::int' for w in words)} as h{k}" for k, words in enumerate(K.KEYWORDS.values()))} from g),
s as (select *, [struct_pack(score := h0 * 0.3::double + case when formulas then 0.4::double else 0 end + case when formulas and pages <= 15 then 0.2::double else 0 end, o := 0, t := 'academic_paper', n := h0 > 0),
    struct_pack(score := h1 * 0.3::double + case when tables and pages > 20 then 0.2::double else 0 end + case when pages > 50 then 0.1::double else 0 end, o := -1, t := 'consulting_report', n := h1 > 0),
    struct_pack(score := h2 * 0.3::double, o := -2, t := 'policy_doc', n := h2 > 0), struct_pack(score := h3 * 0.3::double, o := -3, t := 'tech_research', n := h3 > 0),
    struct_pack(score := h4 * 0.3::double + case when tables and pages > 20 then 0.2::double else 0 end, o := -4, t := 'industry_report', n := h4 > 0)] as e from h), b as (select *, list_max(e) as best from s)
select doc_id, case when best.score <= 0 then 'general' else best.t end as doc_type, case when best.score <= 0 then 0.1 else round(least(1.0, best.score), 2) end as confidence,
    case when best.n and best.score > 0 then 'filename' else 'content' end as source, case when cjk > 0.5 * latin then 'ch' when latin > 0 then 'en' else 'unknown' end as language,
    formulas as has_formulas, tables as has_tables, pages as page_count, scanned as is_scanned, textless from b left join ({L.SQL['pred_scanned']}) z on z.report_id = b.doc_id""",
    "top_recent_jobs": "select job_id, max(created_at) as created_at from jobs group by 1 order by 2 desc, 1 limit 10",
    "top_jobs_kept": "with j as (select job_id, max(created_at) as created_at from jobs group by 1) select * from j where created_at >= (select max(created_at) from j) - 30 * 86400 order by created_at desc, job_id limit 500",
    "top_tables": f"with {CHUNKS} select doc_id, chunk_type, chunk_id, place from (select doc_id, chunk_type, chunk_id, row_number() over (partition by doc_id, chunk_type order by seq nulls first, chunk_id) as place from c where chunk_type in ('table', 'figure') and doc_id is not null and content is not null) where place <= 30 and (chunk_type = 'table' or place <= 20)",
    "agg_batch": "with e as (select report_id, any_value(engine) as engine, any_value(ok) as ok from extract_reports group by 1) select engine, count(*) as total, count(*) filter (ok) as converted, count(*) filter (not ok) as failed from e group by 1",
    "set_segments": f"with {CHUNKS} select doc_id, count(*) as n, sum(('0x' || substr(md5(coalesce(seq::varchar, '') || '|' || chunk_id || '|' || md5(content)), 1, 15))::bigint)::hugeint::varchar as text_digest, count(*) filter (page is null) as n_unplaced from c where doc_id is not null and content is not null group by 1",
    "str_ingest": "select chunk_id, any_value(doc_id) as doc_id, any_value(chunk_type) as chunk_type from chunks group by 1",
    "str_merge": "select chunk_id, any_value(chunk_type) as chunk_type from chunks group by 1",
    "str_windows": "select date_trunc('hour', ts) as \"start\", event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
