"""Queries for the scalar text functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.functions import unicode as U
from tessera.plans import _sql as S
from tessera.plans import tables as R
from tessera.session import read


def scl_token_estimate(spark, d):
    """SCL-01, SCL-02: estimated tokens of every chunk, tags of tables stripped."""
    c = read(spark, d, "chunks").where("content is not null")
    est = T.estimate_tokens(F.col("content"), strip_tags=F.coalesce("chunk_type", F.lit("")) == "table")
    return c.groupBy("chunk_id").agg(F.max(est).alias("tokens"))


def scl_front_matter(spark, d):
    """SCL-03."""
    c = read(spark, d, "chunks").where("content is not null and chunk_type = 'text'")
    return c.groupBy("chunk_id").agg(F.max(F.length(T.strip_front_matter(F.col("content")))).alias("n_left"))


def scl_cells(spark, d):
    """SCL-04, SCL-05: cells of every pipe row of table chunks."""
    rows = R.table_lines(spark, d).where(T.is_pipe_row(F.col("line")))
    return rows.select("chunk_id", "line_no", F.size(T.cells(F.col("line"))).alias("n_cells"), F.array_join(T.cells(F.col("line")), "~").alias("cells"), T.is_separator(F.col("line")).alias("is_separator"))


def scl_squash(spark, d):
    """SCL-06."""
    return R.table_lines(spark, d).select("chunk_id", "line_no", F.md5(T.squash(F.col("line"))).alias("squashed"))


def scl_word_tokens(spark, d):
    """SCL-07, SCL-08, SCL-09: the three kinds of tokens of every document."""
    t = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select(
        "doc_id", F.size(T.word_tokens(t)).alias("n_words"), F.size(F.array_distinct(T.anchor_tokens(t))).alias("n_anchors"), F.array_join(T.numeric_tokens(t), ",").alias("numbers")
    )


def scl_chunk_ids(spark, d):
    """SCL-10, SEQ-07: content-addressed ids with the index among equal (document, path, content)."""
    c = R.chunks(spark, d)
    path = F.coalesce("heading_path", F.array().cast("array<string>"))
    w = F.row_number().over(Window.partitionBy("doc_id", F.array_join(path, "/"), F.coalesce("content", F.lit(""))).orderBy("seq", "chunk_id"))
    c = c.withColumn("duplicate", (w - 1).cast("int"))
    return c.select("chunk_id", "duplicate", T.chunk_id(F.col("doc_id"), path, F.col("duplicate"), F.col("content")).alias("new_id"))


def scl_content_hash(spark, d):
    """SCL-11: hash of each document's text."""
    return read(spark, d, "documents").where("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


def scl_point_id(spark, d):
    """SCL-12: UUIDs of version 5 of all chunks."""
    ids = read(spark, d, "chunks").select("chunk_id").distinct()
    return ids.select("chunk_id", T.point_id(F.col("chunk_id")).alias("point_id"))


def scl_slug(spark, d):
    """SCL-13: slugs of all package titles."""
    t = read(spark, d, "package_metadata").groupBy("doc_id").agg(F.max("title").alias("title"))
    return t.select("doc_id", U.slug(F.col("title"), F.col("doc_id")).alias("slug"))


def scl_table_score(spark, d):
    """SCL-14, AGG-07: score of every pipe table."""
    return _rows(spark, d).select("chunk_id", F.size("rows").alias("n_rows"), T.table_score(F.col("rows")).alias("score"))


def _rows(spark, d):
    lines = R.table_lines(spark, d).where(T.is_pipe_row(F.col("line")) & ~T.is_separator(F.col("line")))
    rows = lines.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("line_no", T.cells(F.col("line")).alias("cells")))).alias("r"))
    return rows.select("chunk_id", F.transform("r", lambda x: x["cells"]).alias("rows"))


def scl_pipe_table(spark, d):
    """SCL-15, SCL-16: rows written as a pipe table again."""
    return _rows(spark, d).select("chunk_id", F.md5(T.pipe_table(F.col("rows"))).alias("table_hash"), F.size(F.flatten("rows")).alias("n_cells"))


def scl_heading_tree(spark, d):
    """SCL-17: headings of every report."""
    lines = R.report_lines(spark, d).where(F.col("line").rlike(r"^#{1,6}\s+\S"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    title = T.strip(F.regexp_replace(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1), T.TAG, ""))
    return lines.select("report_id", "line_no", level.alias("level"), title.alias("title"))


def scl_echo(spark, d):
    """SCL-18: titles behind an echo of their first words, as ligatures leave it; the echo goes (titles beyond ASCII change their form and have no hash here)."""
    p = read(spark, d, "package_metadata").where("doc_id is not null and title is not null").groupBy("doc_id").agg(F.max("title").alias("title"))
    words = F.filter(F.split("title", r"\s+"), lambda w: w != "")
    k = F.conv(F.substring("doc_id", 1, 4), 16, 10).cast("int") % 5 + 2
    echo = F.concat_ws(" ", F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(words, " "))
    return p.select("doc_id", F.when(F.col("title").rlike(r"^[ -~]*$"), F.md5(U.drop_echo(echo))).alias("title_hash"))


def scl_formulas(spark, d):
    """SCL-21: empty formulas removed, broken ones counted."""
    c = read(spark, d, "chunks").where("content is not null and chunk_type = 'text'")
    t = F.col("content")
    return c.groupBy("chunk_id").agg(
        F.max(F.md5(T.remove_empty_formulas(t))).alias("left_hash"), F.max(F.regexp_count(t, F.lit(r"\?\?+"))).alias("n_broken"), F.max(F.size(F.regexp_extract_all(t, F.lit(r"\$[^$\n]+\$"), F.lit(0)))).alias("n_inline")
    )


def scl_spaced_latex(spark, d):
    """SCL-20 over all texts."""
    c = read(spark, d, "chunks").where("content is not null and chunk_type = 'text'").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", F.md5(U.close_spaced_indices(F.col("content"))).alias("closed_hash"))


def scl_images(spark, d):
    """SCL-22: images by kind, decorative ones removed."""
    c = read(spark, d, "chunks").where("content is not null")
    t = F.col("content")
    return c.groupBy("chunk_id").agg(
        F.max(F.regexp_count(t, F.lit(r"!\[[^\]]*\]\([^)]*\)"))).alias("n_images"),
        F.max(F.regexp_count(t, F.lit(r"!\[\]\([^)]*\)"))).alias("n_bare"),
        F.max(F.md5(T.remove_decorative_images(t))).alias("left_hash"),
    )


def scl_reply(spark, d):
    """SCL-24: code chunks as replies without their fences."""
    c = read(spark, d, "chunks").where("chunk_type = 'code' and content is not null")
    return c.groupBy("chunk_id").agg(F.max(F.md5(T.strip_reply(F.col("content")))).alias("left_hash"))


def scl_page_range(spark, d):
    """SCL-25: page ranges of all jobs."""
    j = read(spark, d, "jobs").select("job_id", F.get_json_object("params", "$.page_range").alias("spec")).distinct()
    pages = T.page_range(F.col("spec"))
    return j.select("job_id", F.coalesce(F.size(pages), F.lit(0)).alias("n_pages"), F.array_min(pages).alias("first_page"), F.array_max(pages).alias("last_page"))


def scl_title(spark, d):
    """SCL-26: titles of packages, else their file's stem."""
    p = read(spark, d, "package_metadata").select("doc_id", "title", "source_pdf").distinct()
    return p.select("doc_id", T.derive_title(F.coalesce("title", F.lit("")), F.regexp_replace("source_pdf", r"\.pdf$", "")).alias("title")).distinct()


def scl_language(spark, d):
    """SCL-28: both rules for the language of every document."""
    t = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", T.language_by_share(t).alias("by_share"), T.language_for_engine(t).alias("for_engine"))


def scl_params_hash(spark, d):
    """SCL-29: hash of job parameters."""
    j = read(spark, d, "jobs").select("job_id", "params").distinct()
    return j.select("job_id", F.substring(F.sha1("params"), 1, 16).alias("hash"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("scl_")}

CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{30FF}\x{F900}-\x{FAFF}]"
ROWS = f"""rows as (
    select chunk_id, list(c order by line_no) as rows from (
        select chunk_id, line_no, {S.cells('line')} as c from lines
        where regexp_matches({S.strip('line')}, '^\\|.*\\|$') and not (regexp_full_match(line, '\\s*\\|?[\\s:|-]+\\|?\\s*') and contains(line, '-')))
    group by chunk_id)"""

SQL = {
    "scl_token_estimate": rf"""
with t as (select chunk_id, case when chunk_type = 'table' then regexp_replace(content, '<[^>]+>', ' ', 'g') else content end as t from chunks where content is not null),
n as (select chunk_id, length(t) - length(regexp_replace(t, '{CJK}', '', 'g')) as cjk, length(t) as n from t)
select chunk_id, max(cjk + (n - cjk) // 4)::int as tokens from n group by chunk_id""",
    "scl_front_matter": r"""
select chunk_id, max(length(case when starts_with(content, '---' || chr(10)) and strpos(substr(content, 5), chr(10) || '---') > 0
    then regexp_replace(substr(content, 4 + strpos(substr(content, 5), chr(10) || '---') + 4), '^\n+', '') else content end)) as n_left
from chunks where content is not null and chunk_type = 'text' group by chunk_id""",
    "scl_cells": rf"""
with {S.TABLES}, {S.lines('tables', 'chunk_id')}
select chunk_id, line_no, len({S.cells('line')}) as n_cells, array_to_string({S.cells('line')}, '~') as cells,
       regexp_full_match(line, '\s*\|?[\s:|-]+\|?\s*') and contains(line, '-') as is_separator
from lines where regexp_matches({S.strip('line')}, '^\|.*\|$')""",
    "scl_squash": rf"""
with {S.TABLES}, {S.lines('tables', 'chunk_id')}
select chunk_id, line_no, md5(lower(translate(regexp_replace(line, '[\s\x0b\x{{85}}\p{{Z}}]+', '', 'g'), '−–—×·', '---xx'))) as squashed from lines""",
    "scl_word_tokens": r"""
select doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z\-'']{3,}')) as n_words,
       len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]{4,}'), lambda x: lower(x)))) as n_anchors,
       array_to_string(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)?'), ',') as numbers
from documents""",
    "scl_chunk_ids": r"""
with c as (select chunk_id, max_by(struct_pack(doc_id, heading_path, content, seq), struct_pack(indexed_at, seq)) as r from chunks group by chunk_id),
d as (select chunk_id, r.doc_id as doc_id, coalesce(array_to_string(r.heading_path, '/'), '') as path, coalesce(r.content, '') as content, r.seq as seq from c),
n as (select *, row_number() over (partition by doc_id, path, content order by seq nulls first, chunk_id) - 1 as duplicate from d)
select chunk_id, duplicate::int as duplicate, substr(sha1(coalesce(doc_id, '') || '|' || path || '|' || duplicate || '|' || content), 1, 16) as new_id from n""",
    "scl_content_hash": "select doc_id, substr(sha256(text), 1, 16) as hash from documents where text is not null",
    "scl_point_id": r"""
with h as (select distinct chunk_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(chunk_id)) as h from chunks)
select chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1)::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id
from h""",
    "scl_slug": r"""
with t as (select doc_id, max(title) as title from package_metadata group by doc_id),
a as (select doc_id, regexp_replace(nfc_normalize(coalesce(title, '')), '[<>:"/\\|?*#^\[\]{}\x00-\x1f＜＞：＂／＼｜？＊]', ' ', 'g') as s from t),
b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(s, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\s\p{Z}]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') as s from a),
c as (select doc_id, regexp_replace(substr(s, 1, 60), '[-.]+$', '') as s from b)
select doc_id, case when s = '' then doc_id else s end as slug from c""",
    "scl_table_score": rf"""
with {S.TABLES}, {S.lines('tables', 'chunk_id')}, {ROWS},
w as (select chunk_id, rows, list_max(list_transform(rows, lambda r: len(r))) as widest, flatten(rows) as all_cells from rows)
select chunk_id, len(rows) as n_rows, round(0.6 * (len(list_filter(rows, lambda r: len(r) = widest)) / len(rows))
    + 0.4 * (len(list_filter(all_cells, lambda c: trim(c) <> '')) / len(all_cells)), 3) as score from w""",
    "scl_pipe_table": rf"""
with {S.TABLES}, {S.lines('tables', 'chunk_id')}, {ROWS},
w as (select chunk_id, rows, list_max(list_transform(rows, lambda r: len(r))) as widest from rows),
l as (select chunk_id, rows, widest, list_transform(rows, lambda r: '| ' || array_to_string(list_transform(range(1, widest + 1), lambda i: trim(coalesce(r[i], ''))), ' | ') || ' |') as ls from w)
select chunk_id, md5(array_to_string(list_concat(list_concat(ls[1:1], ['| ' || array_to_string(list_transform(range(widest), lambda i: '---'), ' | ') || ' |']), ls[2:]), chr(10))) as table_hash,
    len(flatten(rows)) as n_cells from l""",
    "scl_heading_tree": rf"""
with {S.REPORTS}, {S.lines('reports', 'report_id')}
select report_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\s', 1)) as level,
    {S.strip("regexp_replace(regexp_extract(line, '^#{1,6}[[:space:]]+(.*)$', 1), '<[^>]+>', '', 'g')")} as title
from lines where regexp_matches(line, '^#{{1,6}}\s+\S')""",
    "scl_echo": r"""
with p as (select doc_id, max(title) as title from package_metadata where doc_id is not null and title is not null group by 1), w as (select doc_id, title, list_filter(regexp_split_to_array(title, '\s+'), lambda x: x <> '') as w from p)
select doc_id, case when regexp_full_match(title, '[ -~]*') then md5(case when len(w) = 1 then w[1] || ' ' || w[1] else array_to_string(w, ' ') end) end as title_hash from w""",
    "scl_spaced_latex": r"""
with c as (select chunk_id, any_value(content) as t from chunks where content is not null and chunk_type = 'text' group by 1)
select chunk_id, md5(array_to_string(list_transform(regexp_extract_all(t, '(?s)\$[^$]*\$|[^$]+|\$'), lambda p: case when starts_with(p, '$') and length(p) > 1 and contains(p, ' _ {') then regexp_replace(p, '\s*([_^{}])\s*', '\1', 'g') else p end), '')) as closed_hash from c""",
    "scl_formulas": r"""
select chunk_id, max(md5(regexp_replace(regexp_replace(content, '\$\$\s*\$\$', '', 'g'), '\$\s+\$', '', 'g'))) as left_hash,
    max(len(regexp_extract_all(content, '\?\?+'))) as n_broken, max(len(regexp_extract_all(content, '\$[^$\n]+\$'))) as n_inline
from chunks where content is not null and chunk_type = 'text' group by chunk_id""",
    "scl_images": r"""
select chunk_id, max(len(regexp_extract_all(content, '!\[[^\]]*\]\([^)]*\)'))) as n_images, max(len(regexp_extract_all(content, '!\[\]\([^)]*\)'))) as n_bare,
    max(md5(regexp_replace(regexp_replace(content, '(?i)!\[\]\([^)]*(?:logo|icon|bullet|separator|decoration|bg_)[^)]*\)', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) as left_hash
from chunks where content is not null group by chunk_id""",
    "scl_reply": rf"""
select chunk_id, max(md5({S.strip("regexp_replace(regexp_replace(" + S.strip("regexp_replace(content, '(?s)<think>.*?</think>', '', 'g')") + ", '^```[A-Za-z]*[[:space:]]*', ''), '[[:space:]]?```$', '')")})) as left_hash
from chunks where chunk_type = 'code' and content is not null group by chunk_id""",
    "scl_page_range": r"""
with j as (select distinct job_id, regexp_replace(params ->> '$.page_range', '\s+', '', 'g') as spec from jobs),
p as (select job_id, case when regexp_full_match(spec, '\d+(-\d+)?(,\d+(-\d+)?)*') then string_split(spec, ',') end as parts from j),
e as (select job_id, list_sort(list_distinct(flatten(list_transform(parts, lambda x:
    range(regexp_extract(x, '^(\d+)', 1)::int, greatest(coalesce(nullif(regexp_extract(x, '-(\d+)$', 1), ''), regexp_extract(x, '^(\d+)', 1))::int, regexp_extract(x, '^(\d+)', 1)::int) + 1))))) as pages from p)
select job_id, coalesce(len(pages), 0) as n_pages, list_min(pages) as first_page, list_max(pages) as last_page from e""",
    "scl_title": rf"""
select distinct doc_id, case when length(t) between 4 and 200 and length(regexp_replace(t, '\P{{L}}', '', 'g')) >= 4
    and not regexp_matches(lower(t), '\.(pdf|docx?|tex|dvi|indd|pptx?|xlsx?)$') then t else regexp_replace(source_pdf, '\.pdf$', '') end as title
from (select doc_id, source_pdf, {S.strip("coalesce(title, '')")} as t from package_metadata)""",
    "scl_language": r"""
with n as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x{4E00}-\x{9FFF}]')) as cjk, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) as latin from documents)
select doc_id, case when cjk > 0.5 * latin then 'ch' when latin > 0 then 'en' else 'unknown' end as by_share,
    case when cjk >= greatest(20, floor(1.2 * latin)) then 'ch' else 'en' end as for_engine from n""",
    "scl_params_hash": "select distinct job_id, substr(sha1(params), 1, 16) as hash from jobs",
}
