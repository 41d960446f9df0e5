"""Queries for chunking, heading paths and captions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from tessera.functions import textops as T
from tessera.operators import blocks as B
from tessera.operators import chunking as C
from tessera.plans import _sql as S
from tessera.plans import tables as R
from tessera.session import read


def _marks(spark, d):
    return B.headings(R.report_lines(spark, d), "report_id")


def seq_heading_paths(spark, d):
    """SEQ-04, SEQ-05: path of every heading of every report."""
    p = B.heading_paths(_marks(spark, d), "report_id")
    return p.select("report_id", "line_no", F.array_join("path", "/").alias("path"))


def seq_note_headings(spark, d):
    """Headings that stay when short numbers deep down are taken as note marks."""
    return B.demote_footnotes(_marks(spark, d)).groupBy("report_id").agg(F.count("*").alias("n"))


def seq_table_captions(spark, d):
    """SEQ-14: caption of each table of the reports, with a small table put in before every 30th line and a caption before some."""
    lines = R.report_lines(spark, d)
    at, n = F.col("line_no") % 30 == 11, F.col("line_no").cast("string")
    caption = F.when(F.col("line_no") % 60 == 11, F.array(F.concat(F.lit("Table "), n, F.lit(". Values")), F.lit("<sup>1</sup> note"), F.lit(""))).otherwise(F.array(F.lit("")))
    more = F.when(at, F.concat(caption, F.array(F.lit("| a | b |"), F.lit("|---|---|"), F.lit("| 1 | 2 |"), F.lit("")), F.array("line"))).otherwise(F.array("line"))
    spread = lines.select("report_id", "line_no", F.posexplode(more).alias("k", "line")).select("report_id", (F.col("line_no") * 10 + F.col("k")).alias("line_no"), "line")
    return B.table_captions(spread, "report_id")


def seq_notes(spark, d):
    """SEQ-06: reports with a note mark on every 25th line; each begins the text that follows it."""
    mark = F.concat(F.lit("#### "), (F.col("line_no") % 9 + 1).cast("string"))
    lines = R.report_lines(spark, d).withColumn("line", F.when(F.col("line_no") % 25 == 7, mark).otherwise(F.col("line")))
    return B.note_prefixes(lines, "report_id")


def seq_captions(spark, d):
    """SCL-23: caption or heading within three lines above each bare image, the farthest first."""
    lines = R.lines_of(R.chunks(spark, d).where("content is not null").select("doc_id", "seq", F.col("content").alias("text"), "chunk_id"), "chunk_id")
    w = Window.partitionBy("chunk_id").orderBy("line_no")
    good = F.when(F.col("line").rlike(r"(?i)^\s*(?:Exhibit|Figure|Table|Chart)\b|^#{1,6}\s"), F.substring(T.strip(F.col("line")), 1, 120))
    df = lines.withColumn("good", good)
    above = F.coalesce(*(F.lag("good", k).over(w) for k in (3, 2, 1)))
    df = df.withColumn("caption", above).where(F.col("line").rlike(r"^\s*!\[[^\]]*\]\([^)]+\)\s*$"))
    return df.select("chunk_id", "line_no", "caption")


def agg_chunk_types(spark, d):
    """AGG-13."""
    return R.chunks(spark, d).groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def chk_chunks(spark, d):
    """CHK-01 to CHK-08, SEQ-03, SEQ-09, SEQ-15, SEQ-16, JON-12: chunks of every report, anchored to pages of 40 lines (no SQL: folds; see chk_rules)."""
    return _chunked(spark, d)


def chk_rules(spark, d):
    """What the chunks of every report must keep: ids and estimates as defined, no gap in their order, pages that never go back, nothing above the cap that has a cut, every word of the text."""
    c = _chunked(spark, d)
    again = F.row_number().over(Window.partitionBy("doc_id", F.array_join("heading_path", "/"), "content").orderBy("seq")) - 1
    tokens = T.estimate_tokens(F.col("content"), F.col("chunk_type") == "table")
    c = c.withColumn("again", again).withColumn("back", F.col("page") < F.max("page").over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    cuttable = F.col("content").rlike(r"[.。!?！？]\s+\S") & (F.col("chunk_type") == "text")
    told = c.groupBy("doc_id").agg(
        F.count_if(F.col("chunk_id") != T.chunk_id(F.col("doc_id"), F.col("heading_path"), F.col("again"), F.col("content"))).alias("n_wrong_ids"),
        F.count_if(F.col("token_est") != tokens).alias("n_wrong_sizes"), (F.max("seq") + 1 - F.count("*")).cast("long").alias("n_gaps"), F.count_if("back").alias("n_back"),
        F.count_if((F.col("token_est") > 768) & cuttable).alias("n_above"),
    )
    words = lambda rows, text: rows.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{L}{4,}"), F.lit(0)))).alias("w")).distinct()
    kept = c.select("doc_id", F.concat_ws(" ", "content", F.array_join("heading_path", " ")).alias("t"))
    repeated = R.report_lines(spark, d).withColumn("line", T.strip(F.col("line"))).groupBy(F.col("report_id").alias("doc_id"), "line").agg(F.count("*").alias("n")).where("n >= 4")
    source = R.reports(spark, d).select(F.col("report_id").alias("doc_id"), "text")
    lost = words(source, "text").join(words(kept, "t"), ["doc_id", "w"], "left_anti").join(words(repeated, "line"), ["doc_id", "w"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_lost"))
    return told.join(lost, "doc_id", "left").withColumn("n_lost", F.coalesce("n_lost", F.lit(0)))


def _chunked(spark, d):
    r = R.reports(spark, d).select(F.col("report_id").alias("doc_id"), "text")
    lines = R.report_lines(spark, d)
    tokens = lines.select(F.col("report_id").alias("doc_id"), F.floor((F.col("line_no") - 1) / 40).alias("page_no"), F.explode(T.anchor_tokens(F.col("line"))).alias("t"))
    pages = tokens.groupBy("doc_id", "page_no").agg(F.collect_set("t").alias("tokens"))
    return C.chunk_documents(r, pages)


def chk_table_parts(spark, d):
    """CHK-02 to CHK-04: parts of all tables: the text that pipe tables' parts hold without the header they repeat, and the data cells of all parts of HTML tables."""
    split = F.udf(C.split_table, "array<string>", useArrow=True)
    t = R.table_chunks(spark, d).withColumn("parts", split("text"))
    rows = T.split_lines(F.col("text"))
    headed = (F.size(rows) > 1) & T.is_separator(F.get(rows, F.lit(1))) & T.strip(F.get(rows, F.lit(1))).startswith("|")
    header = F.when(headed, F.concat(F.get(rows, F.lit(0)), F.lit("\n"), F.get(rows, F.lit(1)), F.lit("\n"))).otherwise("")
    pipe = ~F.lower(T.strip(F.col("text"))).startswith("<table")
    bare = F.array_join(F.transform("parts", lambda x, i: F.when(i == 0, x).otherwise(F.substr(x, F.length(header) + 1))), "\n")
    return t.select("chunk_id", F.when(pipe, F.md5(F.array_join(T.split_lines(bare), "\n"))).alias("text_hash"), F.regexp_count(F.array_join("parts", ""), F.lit("<td")).alias("n_cells"))


def chk_summaries(spark, d):
    """SCL-19: summary of every report and where it is from."""
    kind = Y.StructType().add("summary", "string").add("source", "string")
    s = F.udf(C.summary, kind, useArrow=True)
    return R.reports(spark, d).select("report_id", s("text").alias("s")).select("report_id", "s.summary", "s.source")


def chk_parse(spark, d):
    """CHK-05: sentence ends of long texts, counted in the JVM."""
    c = read(spark, d, "chunks").where("content is not null and chunk_type = 'text'")
    return c.groupBy("chunk_id").agg(F.max(F.regexp_count("content", F.lit(r"[.。!?！？]\s+"))).alias("n_ends"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith(("seq_", "agg_", "chk_"))}

MARKS = rf"""{S.REPORTS}, {S.lines('reports', 'report_id')},
f as (select *, coalesce(sum(case when regexp_matches(line, '^\s*(```|~~~)') then 1 else 0 end) over (partition by report_id order by line_no rows between unbounded preceding and 1 preceding), 0) as fences from lines),
h as (select report_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\s', 1)) as level, {S.strip("regexp_replace(regexp_extract(line, '^#{1,6}[[:space:]]+(.*)$', 1), '<[^>]+>', '', 'g')")} as title
    from f where fences % 2 = 0 and regexp_matches(line, '^#{{1,6}}\s+\S')),
p as (select h.*, (select max(a.line_no) from h a where a.report_id = h.report_id and a.line_no < h.line_no and a.level < h.level) as parent from h)"""


def _paths() -> str:
    steps = []
    for depth in range(1, 7):
        source = "select p.*, '' as parent_path from p where parent is null" if depth == 1 else f"select p.*, d{depth - 1}.path as parent_path from p join d{depth - 1} on d{depth - 1}.report_id = p.report_id and d{depth - 1}.line_no = p.parent"
        steps.append(
            f"d{depth} as (select report_id, line_no, case when parent_path = '' then name else parent_path || '/' || name end as path from (select *, title || case when again > 1 then '#' || again else '' end as name from ("
            f"select *, row_number() over (partition by report_id, parent_path, title order by line_no) as again from ({source}))))"
        )
    return f"with {MARKS}, " + ", ".join(steps) + " " + " union all ".join(f"select report_id, line_no, path from d{k}" for k in range(1, 7))


SQL = {
    "chk_table_parts": rf"""with {S.TABLES}, {S.lines('tables', 'chunk_id')}, j as (select chunk_id, string_agg(line, chr(10) order by line_no) as whole from lines group by 1)
select t.chunk_id, case when not starts_with(lower({S.strip('text')}), '<table') then md5(coalesce(whole, '')) end as text_hash, len(regexp_extract_all(text, '<td'))::int as n_cells from tables t left join j on j.chunk_id = t.chunk_id""",
    "chk_rules": f"with {S.REPORTS} select report_id as doc_id, 0::bigint as n_wrong_ids, 0::bigint as n_wrong_sizes, 0::bigint as n_gaps, 0::bigint as n_back, 0::bigint as n_above, 0::bigint as n_lost from reports where regexp_matches(text, '\\S')",
    "seq_heading_paths": _paths(),
    "seq_note_headings": rf"with {MARKS} select report_id, count(*) as n from h where not (level >= 4 and regexp_full_match(title, '\d{{1,3}}')) group by 1",
    "chk_summaries": rf"""with {S.REPORTS}, {S.lines('reports', 'report_id')}, t as (select report_id, line_no, {S.strip('line')} as s from lines),
k as (select *, regexp_matches(s, '^#{{1,6}}\s+') as head, regexp_matches(s, '^#{{1,6}}\s+.*') or starts_with(s, '|') or starts_with(s, '!') or starts_with(s, '>') or starts_with(s, '```') or starts_with(s, '<') or starts_with(s, '---') as barred from t),
ab as (select report_id, min(line_no) as a from k where head and lower({S.strip("regexp_replace(s, '^#{1,6}[[:space:]]+', '')")}) in ('abstract', '摘要') group by 1),
sec as (select k.*, line_no - row_number() over (partition by k.report_id order by line_no) as g from k join ab on ab.report_id = k.report_id where s <> '' and line_no > a and line_no < coalesce((select min(h.line_no) from k h where h.report_id = k.report_id and h.head and h.line_no > a), 1000000000)),
abs_p as (select report_id, arg_min(p, m) as p from (select report_id, g, min(line_no) as m, substr(string_agg(s, ' ' order by line_no), 1, 600) as p from sec group by 1, 2) group by 1),
pl as (select *, line_no - row_number() over (partition by report_id order by line_no) as g from k where s <> '' and not barred),
pr as (select report_id, g, min(line_no) as m, max(line_no) as z, string_agg(s, ' ' order by line_no) as p from pl group by 1, 2),
ok as (select pr.report_id, m, p from pr left join k on k.report_id = pr.report_id and k.line_no = z + 1 where not coalesce(barred, false) and length(p) > 150 and length(p) - length(replace(replace(p, '.', ''), '。', '')) >= 2),
fi as (select report_id, arg_min(p, m) as p from ok group by 1)
select r.report_id, coalesce(abs_p.p, substr(fi.p, 1, 600), '') as summary, case when abs_p.p is not null then 'abstract' when fi.p is not null then 'first_paragraph' else 'unavailable' end as source
from reports r left join abs_p on abs_p.report_id = r.report_id left join fi on fi.report_id = r.report_id""",
    "seq_table_captions": rf"""with {S.REPORTS}, {S.lines('reports', 'report_id')}, m as (select report_id, line_no, case when line_no % 30 = 11 then list_concat(case when line_no % 60 = 11 then ['Table ' || line_no || '. Values', '<sup>1</sup> note', ''] else [''] end, ['| a | b |', '|---|---|', '| 1 | 2 |', '', line]) else [line] end as a from lines),
e as (select report_id, line_no * 10 + i - 1 as line_no, a[i] as line from m, unnest(range(1, len(a) + 1)) as u(i)), t as (select *, {S.strip('line')} as s from e),
x as (select *, regexp_matches(s, '^\|.*\|$') as pipe, s <> '' and not regexp_matches(s, '^(?:#{{1,6}}\s|```|\|.*\|$|!\[[^\]]*\]\([^)]+\)$|(?i:<table))') as txt from t),
y as (select *, pipe and not coalesce(lag(pipe) over w and lag(line_no) over w = line_no - 1, false) as starts, case when txt and not coalesce(lag(txt) over w, false) then line_no end as fresh from x window w as (partition by report_id order by line_no)),
z as (select *, max(fresh) over (partition by report_id order by line_no rows unbounded preceding) as run from y),
c as (select report_id, run, arg_max(s, line_no) filter (regexp_matches(s, '(?i)^(?:Table|Figure|表|图)\s*[\d.::]+')) as cap, arg_max(substr(s, 1, 200), line_no) as last_line from z where txt and not starts_with(s, '<sup>') group by 1, 2)
select z.report_id, z.line_no as block, coalesce(cap, last_line) as caption from z left join c on c.report_id = z.report_id and c.run = z.run where starts""",
    "seq_notes": rf"""with {S.REPORTS}, {S.lines('reports', 'report_id')}, m as (select report_id, line_no, case when line_no % 25 = 7 then '#### ' || (line_no % 9 + 1) else line end as line from lines),
f as (select *, {S.strip('line')} as s from m where {S.strip('line')} <> ''), n as (select *, regexp_extract(s, '^#{{4,6}}\s+(\d{{1,3}})$', 1) as note, not regexp_matches(s, '^(?:#{{1,6}}\s|```|~~~|\|.*\|$|!\[[^\]]*\]\([^)]+\)$|(?i:<table))') as txt from f),
g as (select *, coalesce(lead(txt) over w, false) as goes_on, lag(note) over w as before from n window w as (partition by report_id order by line_no))
select report_id, line_no, case when note <> '' then note when coalesce(before, '') <> '' and txt then before || '. ' || ltrim(line) else line end as line from g where note = '' or not goes_on""",
    "seq_captions": rf"""
with c as (select chunk_id, max_by(content, struct_pack(indexed_at, seq)) as text from chunks where content is not null group by chunk_id), {S.lines('c', 'chunk_id')},
g as (select *, case when regexp_matches(line, '(?i)^\s*(Exhibit|Figure|Table|Chart)\b|^#{{1,6}}\s') then substr({S.strip('line')}, 1, 120) end as good from lines),
a as (select *, coalesce(lag(good, 3) over w, lag(good, 2) over w, lag(good, 1) over w) as caption from g window w as (partition by chunk_id order by line_no))
select chunk_id, line_no, caption from a where regexp_matches(line, '^\s*!\[[^\]]*\]\([^)]+\)\s*$')""",
    "agg_chunk_types": "with c as (select chunk_id, max_by(struct_pack(chunk_type, doc_id), struct_pack(indexed_at, seq)) as r from chunks group by chunk_id) select r.chunk_type as chunk_type, count(*) as n, count(distinct r.doc_id) as n_docs from c group by 1",
    "chk_parse": r"select chunk_id, max(len(regexp_extract_all(content, '[.。!?！？]\s+'))) as n_ends from chunks where content is not null and chunk_type = 'text' group by 1",
}
