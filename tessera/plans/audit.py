"""Queries for the detectors and the quality gate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.operators import audit as A
from tessera.operators import blocks as B
from tessera.plans import _sql as S
from tessera.plans import tables as R
from tessera.session import read


def order_tables(spark, d):
    """(doc, line_no, line): one pipe table for each order; by its key it is torn, fused, blank or flattened."""
    k = F.col("l_orderkey")
    n, q, p = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey").cast("string")
    torn = F.concat(F.lit("| "), q, F.lit(" | "), n, F.lit(" | x 10 | - "), n, F.lit(" |"))
    plain = F.concat(F.lit("| part "), p, F.lit(" | "), q, F.lit(" | sum |  |"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(k % 5 == 0, torn).otherwise(plain).alias("line"))
    orders = read(spark, d, "lineitem").groupBy(k.alias("doc")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["line"]).alias("rows"))  # an order has few lines
    header = (
        F.when(F.col("doc") % 7 == 0, "| total 5 | rate 3.1% | a | b |")
        .when(F.col("doc") % 11 == 0, "|  |  |  |  |")
        .when(F.col("doc") % 13 == 0, "| big net price | small net price | gross sum | x |")
        .otherwise("| part | quantity | sum | note |")
    )
    lines = F.concat(F.array(header, F.lit("|---|---|---|---|")), "rows")
    return orders.select("doc", F.posexplode(lines).alias("pos", "line")).select("doc", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def dirty_texts(spark, d):
    """(doc, text): documents with control characters, damaged ones, spans and escaped brackets put in by key."""
    docs = read(spark, d, "documents").where("text is not null")
    k = F.col("doc_id")
    text = F.concat(
        F.when(k % 2 == 0, F.chr(F.lit(2))).otherwise(""), F.col("text"), F.when(k % 3 == 0, F.lit("\n<span></span>a<span></span>")).otherwise(""),
        F.when(k % 5 == 0, F.lit("\n[\\[X13,](#page-1-0) and [Y\\]](#page-2-0)")).otherwise(""), F.when(k % 7 == 0, F.lit("\nbad � sign")).otherwise(""),
        F.when(k % 11 == 0, F.lit("\n private")).otherwise(""), F.when(k % 4 == 0, F.lit("\n\\[x^2\\] see [b](#p)")).otherwise(""),
    )
    return docs.select(k.alias("doc"), text.alias("text"))


def _dirty_lines(spark, d):
    return R.lines_of(dirty_texts(spark, d), "doc")


def _blocks(spark, d):
    return B.table_blocks(order_tables(spark, d), "doc")


def det_garbled(spark, d):
    return A.garbled(_dirty_lines(spark, d), "doc")


def det_sanitize(spark, d):
    """DET-102, DET-106, DET-108a, SAN, SNK-10."""
    t = dirty_texts(spark, d)
    control, spans, brackets = A.sanitize_counts(F.col("text"))
    return t.select("doc", F.md5(A.sanitize(F.col("text"))).alias("left_hash"), control.alias("n_control"), spans.alias("n_spans"), brackets.alias("n_brackets"))


def det_empty_header(spark, d):
    return A.empty_header(_blocks(spark, d), "doc")


def det_torn_numbers(spark, d):
    return A.torn_numbers(_blocks(spark, d), "doc")


def det_fused_header(spark, d):
    return A.fused_header(_blocks(spark, d), "doc")


def det_flattened_header(spark, d):
    return A.flattened_header(_blocks(spark, d), "doc")


def det_math_collision(spark, d):
    return A.math_collision(_dirty_lines(spark, d), "doc")


def det_image_links(spark, d):
    """DET-109, JON-11, SET-06: references of figure chunks against the files of documents with an even seq."""
    c = R.chunks(spark, d).where("content is not null and chunk_type = 'figure' and doc_id is not null")
    lines = c.select("chunk_id", F.col("content").alias("line"))
    names = c.withColumn("name", F.regexp_extract("content", r"!\[[^\]]*\]\(images/([^)\s]+)\)", 1)).where("name <> ''")
    files = names.select("chunk_id", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("images/"), "name")).otherwise(F.concat(F.lit("other/"), "name")).alias("path"))
    return A.image_links(lines, files, "chunk_id")


def audit_run(spark, d):
    """AUD, AGG-05, SET-05: all rules over all order tables, severities counted by document."""
    return A.severity_counts(A.all_rules(order_tables(spark, d), "doc"), "doc")


def qc_gate(spark, d):
    """QC-01 to QC-06 of every report: tables against the number the engine reported, escalated by critical issues and segments of its package."""
    r = R.reports(spark, d)
    expected = read(spark, d, "extract_reports").groupBy("report_id").agg(F.max("table_count").alias("expected"))
    lines = R.report_lines(spark, d)
    n_tables = B.table_blocks(lines, "report_id").groupBy("report_id").agg(F.count_distinct("block").alias("n_tables"))
    critical = A.garbled(lines, "report_id").select("report_id", F.lit(True).alias("critical"))
    packages = read(spark, d, "package_metadata").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.size("degraded_segments")).alias("n_degraded"))
    r = r.join(expected, "report_id").join(n_tables, "report_id", "left").join(critical, "report_id", "left").join(packages, "doc_id", "left")
    scores = {
        "text": A.completeness(F.col("text"), F.col("page_count")),
        "headings": A.heading_structure(F.col("text")),
        "formulas": A.formula_integrity(F.col("text")),
        "tables": A.table_coverage(F.coalesce("n_tables", F.lit(0)), F.col("expected")),
    }
    verdict, failed, warned = A.gate(scores, F.coalesce("critical", F.lit(False)) | (F.coalesce("n_degraded", F.lit(0)) > 0), F.col("text"))
    return r.select("report_id", *(F.round(s, 6).alias(n) for n, s in scores.items()), verdict.alias("verdict"), failed.alias("failed"), warned.alias("warned"))


def seq_table_blocks(spark, d):
    """SEQ-01: extent of every table block of table chunks."""
    b = B.table_blocks(R.table_lines(spark, d), "chunk_id")
    return b.groupBy("chunk_id", "block").agg(F.max("line_no").alias("last_line"), F.count("*").alias("n_rows"))


def seq_block_around(spark, d):
    """SEQ-02: the block around every third line of table chunks, where that line is a row."""
    lines = R.table_lines(spark, d)
    return B.block_around(lines, lines.where("line_no % 3 = 2").select("chunk_id", F.col("line_no").alias("at")), "chunk_id")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith(("det_", "audit_", "qc_", "seq_")) and callable(v)}

ORDERS = """orders_t as (
    select l_orderkey as doc, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, trunc(l_quantity)::int::varchar) + 2)::bigint as line_no,
        case when l_orderkey % 5 = 0 then '| ' || trunc(l_quantity)::int || ' | ' || l_linenumber || ' | x 10 | - ' || l_linenumber || ' |'
             else '| part ' || l_partkey || ' | ' || trunc(l_quantity)::int || ' | sum |  |' end as line from lineitem
    union all select distinct l_orderkey, 1, case when l_orderkey % 7 = 0 then '| total 5 | rate 3.1% | a | b |' when l_orderkey % 11 = 0 then '|  |  |  |  |'
        when l_orderkey % 13 = 0 then '| big net price | small net price | gross sum | x |' else '| part | quantity | sum | note |' end from lineitem
    union all select distinct l_orderkey, 2, '|---|---|---|---|' from lineitem)"""


def _blocks_sql(source: str, key: str) -> str:
    return rf"""islands as (
    select {key}, line_no, line, line_no - row_number() over (partition by {key} order by line_no) as island from {source} where regexp_matches({S.strip('line')}, '^\|.*\|$')),
runs as (select *, min(line_no) over (partition by {key}, island) as block, count(*) over (partition by {key}, island) as n from islands),
blocks as (select {key}, block, line_no, line_no - block + 1 as row_no, line, {S.cells('line')} as cells from runs where n >= 2)"""


DIRTY = r"""dirty as (
    select doc_id as doc, case when doc_id % 2 = 0 then chr(2) else '' end || text || case when doc_id % 3 = 0 then chr(10) || '<span></span>a<span></span>' else '' end
    || case when doc_id % 5 = 0 then chr(10) || '[\[X13,](#page-1-0) and [Y\]](#page-2-0)' else '' end || case when doc_id % 7 = 0 then chr(10) || 'bad ' || chr(65533) || ' sign' else '' end
    || case when doc_id % 11 = 0 then chr(10) || chr(57344) || ' private' else '' end || case when doc_id % 4 = 0 then chr(10) || '\[x^2\] see [b](#p)' else '' end as text
    from documents where text is not null)"""


def _issue(select: str, key: str, rule: str, severity: str, by: str = "", having: str = "") -> str:
    return f"select {key}, '{rule}' as rule, '{severity}' as severity, count(*) as n, array_to_string(list(line_no order by line_no)[1:20], ',') as lines from ({select}) group by {key}{by} {having}"


HEAD = f"with {ORDERS}, {_blocks_sql('orders_t', 'doc')}\n"
LINES = f"with {DIRTY}, {S.lines('dirty', 'doc')}\n"
NUMBER = r"(^|[^A-Za-z0-9_.])[0-9]+([.][0-9]+)?%?($|[^A-Za-z0-9_])"
RULE_103 = _issue("select * from blocks where row_no = 1 and len(list_filter(cells, lambda c: c <> '')) = 0", "doc", "103", "warn")
RULE_104 = _issue(
    r"select * from blocks where not (regexp_full_match(line, '\s*\|?[\s:|-]+\|?\s*') and contains(line, '-')) and len(list_filter(cells, lambda c: regexp_full_match(c, '[×x]\s*10'))) > 0 "
    r"and len(list_filter(cells, lambda c: regexp_full_match(c, '[×x]\s*10|10\s*[−-]\s*\d{1,2}|[−-]\s*\d{1,2}|\d{1,2}'))) >= 3",
    "doc", "104", "critical", ", block", "having count(*) >= 2",
)
RULE_105 = _issue(f"select * from blocks where row_no = 1 and len(list_filter(cells, lambda c: regexp_matches(c, '{NUMBER}'))) >= 2", "doc", "105", "critical", ", block")
RULE_107 = _issue(
    r"select distinct doc, block, line_no from (select doc, block, line_no, array_to_string(w[-2:], ' ') as pair from (select doc, block, line_no, regexp_split_to_array(lower(unnest(cells)), '\s+') as w from blocks where row_no = 1) where len(w) >= 3) group by doc, block, line_no, pair having count(*) >= 2",
    "doc", "107", "warn", ", block",
)

SQL = {
    "det_garbled": LINES + _issue(r"select * from lines where regexp_matches(line, '[\x{FFFD}\x{E000}-\x{F8FF}]')", "doc", "101", "critical"),
    "det_sanitize": rf"""
with {DIRTY}, bare as (select doc, text, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') as b from dirty)
select doc, md5(replace(replace(replace(b, '<span></span>', ''), '[\[', '[['), '\]](', ']](')) as left_hash, length(text) - length(b) as n_control,
    len(regexp_extract_all(b, '<span></span>')) as n_spans, len(regexp_extract_all(b, '\[\\\[')) + len(regexp_extract_all(b, '\\\]\]\(')) as n_brackets from bare""",
    "det_empty_header": HEAD + RULE_103,
    "det_torn_numbers": HEAD + RULE_104,
    "det_fused_header": HEAD + RULE_105,
    "det_flattened_header": HEAD + RULE_107,
    "det_math_collision": LINES + _issue(r"select * from lines where (contains(line, '\[') or contains(line, '\]')) and contains(line, '](#')", "doc", "108", "warn"),
    "det_image_links": r"""
with c as (select chunk_id, max_by(struct_pack(doc_id, content, seq, chunk_type), struct_pack(indexed_at, seq)) as r from chunks group by chunk_id),
f as (select chunk_id, r.content as content, r.seq as seq from c where r.content is not null and r.chunk_type = 'figure' and r.doc_id is not null),
refs as (select distinct chunk_id, unnest(regexp_extract_all(content, '!\[[^\]]*\]\(([^)\s]+)\)', 1)) as ref from f),
files as (select chunk_id, case when seq % 2 = 0 then 'images/' else 'other/' end || regexp_extract(content, '!\[[^\]]*\]\(images/([^)\s]+)\)', 1) as path from f
    where regexp_extract(content, '!\[[^\]]*\]\(images/([^)\s]+)\)', 1) <> '')
select chunk_id, ref, case when regexp_matches(ref, '^(https?:|data:)') then 'remote' when exists (select 1 from files where files.chunk_id = refs.chunk_id and path = ref) then 'ok'
    when exists (select 1 from files where files.chunk_id = refs.chunk_id and path = 'images/' || regexp_extract(ref, '([^/]+)$', 1)) then 'rewritten' else 'broken' end as state
from refs""",
    "audit_run": HEAD
    + f"select doc, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warn') as warn, 0::bigint as info from ({RULE_103} union all {RULE_104} union all {RULE_105} union all {RULE_107}) group by doc",
    "qc_gate": rf"""
with {S.REPORTS}, {S.lines('reports', 'report_id')}, {_blocks_sql('lines', 'report_id')},
t as (select report_id, count(distinct block) as n_tables from blocks group by report_id),
g as (select distinct report_id from lines where regexp_matches(line, '[\x{{FFFD}}\x{{E000}}-\x{{F8FF}}]')),
f as (select report_id, doc_id, text, page_count, length({S.strip('text')}) / page_count as rate, len(regexp_extract_all(text, '(?m)^#{{1,6}}\s+.+$')) as h,
      list_transform(regexp_extract_all(text, '\$[^$]+\$'), lambda x: {S.strip("regexp_replace(x, '^[$]|[$]$', '', 'g')")}) as inner_f from reports),
s as (select f.report_id,
      case when coalesce(page_count, 0) <= 0 then case when length(text) > 100 then 1.0 else 0.0 end when rate >= 1000 then 1.0 when rate >= 500 then 0.8 when rate >= 200 then 0.5 when rate >= 50 then 0.3 else 0.1 end::double as text_s,
      case when h >= 5 then 1.0 when h >= 3 then 0.7 when h >= 1 then 0.4 else 0.1 end::double as headings,
      case when len(inner_f) = 0 then 1.0 else 1.0 - len(list_filter(inner_f, lambda x: regexp_full_match(x, '\?*') or contains(x, '???'))) / len(inner_f) end::double as formulas,
      case when coalesce(expected, 0) <= 0 then case when coalesce(n_tables, 0) > 0 then 1.0 else 0.5 end else least(1.0, coalesce(n_tables, 0) / expected) end::double as tables,
      g.report_id is not null or coalesce(n_degraded, 0) > 0 as critical, length({S.strip('text')}) = 0 as blank
      from f left join t on t.report_id = f.report_id left join g on g.report_id = f.report_id
      join (select report_id, max(table_count) as expected from extract_reports group by 1) x on x.report_id = f.report_id
      left join (select doc_id, max(len(degraded_segments)) as n_degraded from package_metadata group by 1) k on k.doc_id = f.doc_id),
v as (select *, list_filter([case when text_s < 0.3 then 'text' end, case when headings < 0.1 then 'headings' end, case when formulas < 0.5 then 'formulas' end], lambda x: x is not null) as failed,
      list_filter([case when text_s >= 0.3 and text_s < 0.6 then 'text' end, case when headings >= 0.1 and headings < 0.4 then 'headings' end, case when formulas >= 0.5 and formulas < 0.8 then 'formulas' end, case when tables < 0.5 then 'tables' end], lambda x: x is not null) as warned from s)
select report_id, text_s as text, headings, round(formulas, 6) as formulas, round(tables, 6) as tables, case when blank or len(failed) > 0 then 'HALT' when len(warned) > 0 or critical then 'WARN' else 'PASS' end as verdict,
    array_to_string(failed, ',') as failed, array_to_string(warned, ',') as warned from v""",
    "seq_block_around": rf"""with {S.TABLES}, {S.lines('tables', 'chunk_id')}, p as (select chunk_id, line_no, line_no - row_number() over (partition by chunk_id order by line_no) as island from lines where regexp_matches({S.strip('line')}, '^\|.*\|$')),
e as (select chunk_id, island, min(line_no) as "first", max(line_no) as "last" from p group by 1, 2)
select p.chunk_id, line_no as "at", "first", "last" from p join e on e.chunk_id = p.chunk_id and e.island = p.island where line_no % 3 = 2""",
    "seq_table_blocks": rf"with {S.TABLES}, {S.lines('tables', 'chunk_id')}, {_blocks_sql('lines', 'chunk_id')} select chunk_id, block, max(line_no) as last_line, count(*) as n_rows from blocks group by chunk_id, block",
}
