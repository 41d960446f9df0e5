"""Queries for the repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.operators import blocks as B
from tessera.operators import coverage as C
from tessera.operators import geometry as G
from tessera.operators import repair as P
from tessera.plans import _sql as S
from tessera.plans import audit as A
from tessera.plans import layers as L
from tessera.plans import tables as R


def rep_numeric_gate(spark, d):
    """REP-GATE, SET-04: every table against a copy without its last row, the table as layer."""
    t = R.table_chunks(spark, d)
    cut = F.regexp_replace("text", r"[^\n]*$", "")
    status, disputed = P.numeric_gate(F.col("text"), cut, cut, F.lit("7 8 9"))
    return t.select("chunk_id", status.alias("status"), F.array_join(disputed, ",").alias("disputed"))


def rep_torn_values(spark, d):
    """A part of REP-104: values of order lines found again from their fragments."""
    b = L.boxes(spark, d)
    words = b.select("doc", "page_no", "word_no", F.concat(F.col("x0").cast("int").cast("string"), F.lit("."), F.col("word_no").cast("string")).alias("word"))
    target = words.where("word_no in (2, 3)").groupBy("doc", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]), " ").alias("run"))
    targets = target.select("doc", "page_no", F.replace(T.squash(F.col("run")), F.lit("."), F.lit("")).alias("target"))
    return P.recover_values(words, targets, ["doc", "page_no"])


def rep_rebuild(spark, d):
    """A part of REP-105: rows of cells from word boxes."""
    b = L.boxes(spark, d)
    lines = G.visual_lines(b).select("doc", "page_no", "word_no", "x0", "line_no")
    cols = G.assign_columns(b, G.columns(b))
    words = lines.join(cols, ["doc", "page_no", "word_no"]).withColumn("word", F.col("word_no").cast("string"))
    return P.rebuild_rows(words, ["doc", "page_no"])


def rep_longest_run(spark, d):
    """SEQ-13: longest run of report lines that end without a stop."""
    lines = R.report_lines(spark, d).withColumn("on", ~T.strip(F.col("line")).rlike(r"[.!?]$"))
    return P.longest_run(lines, ["report_id"], "on")


def rep_split_tables(spark, d):
    """A part of REP-110: tables of two orders each, the second part without its repeated header, as a hash of its lines."""
    lines = A.order_tables(spark, d)
    merged = lines.select(F.floor(F.col("doc") / 2).alias("pair"), (F.col("line_no") + (F.col("doc") % 2) * 1_000_000).alias("line_no"), "line")
    blocks = B.table_blocks(merged, "pair")
    pairs = blocks.where("block > 1000000").select("pair", "block").distinct()
    return P.merge_split_tables(blocks, pairs, "pair").groupBy("pair").agg(F.count("*").alias("n_rows"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")).alias("text_hash"))


def rep_losses(spark, d):
    """REP-201, TOP-06: reports without every fortieth line, completed from their words: no token more often than there, and nothing of the text lost.

    A row for each report, with the numbers of tokens above the layer's count and below the text's own.
    """
    words = L.page_words(spark, d).groupBy("report_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]).alias("words"))
    lossy = L.page_lines(spark, d).where("line_no % 40 <> 7").groupBy("report_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    done = C.bag(P.repair_losses(lossy, words, "report_id"), "report_id").withColumnRenamed("n", "now")
    layer = C.bag(L.page_lines(spark, d).select("report_id", F.col("line").alias("text")), "report_id").withColumnRenamed("n", "there")
    before = C.bag(lossy, "report_id").withColumnRenamed("n", "had")
    counts = layer.join(done, ["report_id", "token"], "full").join(before, ["report_id", "token"], "full").fillna(0, ["now", "there", "had"])
    more = F.count_if((F.col("now") > F.col("there")) & (F.col("now") > F.col("had")))
    return counts.groupBy("report_id").agg(more.alias("n_more"), F.count_if(F.col("now") < F.col("had")).alias("n_lost"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("rep_")}

NUM = r"[0-9]+(?:\.[0-9]+)?"
SQL = {
    "rep_losses": f"with {L.PAGES}, b as (select distinct report_id from (select report_id, unnest(regexp_extract_all(line, '{L.WORD}')) as t from lines)) select report_id, 0::bigint as n_more, 0::bigint as n_lost from b",
    "rep_numeric_gate": rf"""
with {S.TABLES}, c as (select chunk_id, text, regexp_replace(text, '[^\n]*$', '') as cut from tables),
n as (select chunk_id, list_distinct(regexp_extract_all(regexp_replace(text, '<[^>]+>', ' ', 'g'), '{NUM}')) as new, list_distinct(regexp_extract_all(cut, '{NUM}')) as old, ['7', '8', '9'] as around from c),
k as (select *, list_distinct(list_concat(old, around)) as known, list_filter(list_filter(old, lambda x: not list_contains(new, x)), lambda x: len(list_filter(new, lambda y: contains(replace(y, '.', ''), x))) = 0) as lost from n),
i as (select *, list_sort(list_filter(new, lambda x: not list_contains(known, x))) as invented, len(list_filter(old, lambda x: list_contains(known, x))) / greatest(1, len(known)) as cover from k)
select chunk_id, case when len(lost) > 0 then 'fail' when len(invented) = 0 then 'pass' when len(known) < 4 or cover < 0.5 then 'verify' else 'fail' end as status,
    case when len(lost) > 0 then '' else array_to_string(invented, ',') end as disputed from i""",
    "rep_torn_values": f"""
with {L.BOXES}, w as (select doc, page_no, word_no, x0::int || '.' || word_no as word from boxes),
t as (select doc, page_no, replace(string_agg(word, '' order by word_no), '.', '') as target from w where word_no in (2, 3) group by 1, 2),
r as (select a.doc, a.page_no, b.word_no, a.word_no as start, (select string_agg(c.word, ' ' order by c.word_no) from w c where c.doc = a.doc and c.page_no = a.page_no and c.word_no between a.word_no and b.word_no) as run
      from w a join w b on b.doc = a.doc and b.page_no = a.page_no and b.word_no between a.word_no and a.word_no + 5)
select doc, page_no, run as value from (select r.*, row_number() over (partition by r.doc, r.page_no order by word_no desc, start) as n from r join t on t.doc = r.doc and t.page_no = r.page_no
    where replace(replace(run, ' ', ''), '.', '') = target) where n = 1""",
    "rep_rebuild": f"""
with {L.BOXES}, {L.COLUMNS}, a as (select *, lag(y0) over (partition by doc, page_no order by y0, x0, word_no) as before from boxes),
l as (select doc, page_no, word_no, x0, sum(case when abs(y0 - before) <= 3 then 0 else 1 end) over (partition by doc, page_no order by y0, x0, word_no rows unbounded preceding) as line_no from a),
o as (select b.doc, b.page_no, word_no, column_no, row_number() over (partition by b.doc, b.page_no, word_no order by least(x1, "right") - greatest(x0, "left") desc, column_no) as r
      from boxes b join cols c on c.doc = b.doc and c.page_no = b.page_no and least(x1, "right") - greatest(x0, "left") > 0),
c as (select l.doc, l.page_no, line_no, column_no, string_agg(l.word_no::varchar, ' ' order by x0, l.word_no) as cell from l join o on o.doc = l.doc and o.page_no = l.page_no and o.word_no = l.word_no and r = 1 group by 1, 2, 3, 4)
select doc, page_no, line_no::bigint as line_no, string_agg(cell, ' | ' order by column_no) as cells from c group by 1, 2, 3""",
    "rep_longest_run": rf"""
with {S.REPORTS}, {S.lines('reports', 'report_id')}, m as (select report_id, line_no, line_no - row_number() over (partition by report_id order by line_no) as island from lines where not regexp_matches({S.strip('line')}, '[.!?]$')),
r as (select report_id, island, min(line_no) as "first", max(line_no) as "last" from m group by 1, 2)
select report_id, "first", "last" from (select *, row_number() over (partition by report_id order by "last" - "first" desc, "first") as n from r) where n = 1""",
    "rep_split_tables": rf"""
with {A.ORDERS}, m as (select doc // 2 as pair, line_no + doc % 2 * 1000000 as line_no, line from orders_t), {A._blocks_sql('m', 'pair')},
h as (select pair, block, {S.strip('line')} as header, lag({S.strip('line')}) over (partition by pair order by block) as before from blocks where row_no = 1),
r as (select pair, block, regexp_full_match(line, '\s*\|?[\s:|-]+\|?\s*') and contains(line, '-') as ruled from blocks where row_no = 2),
s as (select h.pair, h.block, coalesce(header = before, false) or coalesce(ruled, false) as gone from h left join r on r.pair = h.pair and r.block = h.block where h.block > 1000000)
select b.pair, count(*) as n_rows, md5(string_agg(line, chr(10) order by line_no)) as text_hash from blocks b left join s on s.pair = b.pair and s.block = b.block
where not (coalesce(gone, false) and (row_no = 1 or row_no = 2 and regexp_full_match(line, '\s*\|?[\s:|-]+\|?\s*') and contains(line, '-'))) group by 1""",
}
