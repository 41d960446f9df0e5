"""Queries on text layers: coverage, word boxes and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.operators import coverage as C
from tessera.operators import geometry as G
from tessera.plans import _sql as S
from tessera.plans import tables as R
from tessera.session import read


def page_lines(spark, d):
    """(report_id, page_no, line_no, line): report lines dealt to pages of 40 lines."""
    lines = R.report_lines(spark, d)
    return lines.select("report_id", F.floor((F.col("line_no") - 1) / 40).alias("page_no"), "line_no", T.strip(F.col("line")).alias("line")).where("line <> ''")


def page_words(spark, d):
    words = page_lines(spark, d).select("report_id", "page_no", "line_no", F.posexplode(F.split("line", r"\s+")).alias("k", "word")).where("word <> ''")
    return words.select("report_id", "page_no", (F.col("line_no") * 10000 + F.col("k")).alias("word_no"), "word")


def lossy_texts(spark, d):
    """Every seventh line of the reports is lost."""
    lines = page_lines(spark, d).where("line_no % 7 <> 3")
    return lines.select("report_id", F.col("line").alias("text"))


def boxes(spark, d):
    """(doc, page_no, word_no, x0, y0, x1, y1): line items of orders laid out on pages of 1,000 orders."""
    items = read(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    n = F.row_number().over(w)
    x = (F.col("l_suppkey") % 9 * 60).cast("double")
    y = (F.col("l_partkey") % 40 * 14).cast("double") + (F.col("l_linenumber") % 3)
    df = items.select(F.floor(F.col("l_orderkey") / 10).alias("doc"), (F.col("l_orderkey") % 10).cast("int").alias("page_no"), n.alias("word_no"), x.alias("x0"), y.alias("y0"))
    return df.select("doc", "page_no", "word_no", "x0", "y0", (F.col("x0") + 40).alias("x1"), (F.col("y0") + 10).alias("y1"))


def seq_dehyphenate(spark, d):
    """SEQ-08 on every page of every report."""
    merged = C.dehyphenate(page_words(spark, d), ["report_id", "page_no"])
    return merged.groupBy("report_id", "page_no").agg(F.count("*").alias("n_words"), F.sum(F.length("word")).alias("n_chars"))


def agg_bags(spark, d):
    """AGG-01: token bags of reports."""
    return C.bag(R.reports(spark, d), "report_id").groupBy("report_id").agg(F.count("*").alias("n_tokens"), F.sum("n").alias("n"), F.max("n").alias("most"))


def agg_furniture(spark, d):
    """AGG-03, AGG-02: lines on at least 30 % of a report's pages, and what their tokens leave of the bag."""
    lines = page_lines(spark, d)
    usual = C.furniture(lines, "report_id")
    kept = C.subtract(C.bag(R.reports(spark, d), "report_id"), C.bag(lines.join(usual, ["report_id", "line"], "left_semi"), "report_id", "line"), "report_id")
    return kept.groupBy("report_id").agg(F.sum("n").alias("n"))


def agg_running_headers(spark, d):
    """AGG-04: short lines that occur at least four times in a report."""
    lines = R.report_lines(spark, d).withColumn("line", T.strip(F.col("line")))
    short = lines.where((F.length("line") > 0) & (F.length("line") < 60) & F.col("line").rlike(r"[\p{L}\p{N}]"))
    return short.groupBy("report_id", "line").agg(F.count("*").alias("n")).where("n >= 4")


def det_coverage(spark, d):
    """DET-201, JON-01, TOP-02, SET-01: what the lossy copy of each report lacks."""
    return C.deficit(C.bag(R.reports(spark, d), "report_id"), C.bag(lossy_texts(spark, d), "report_id"), "report_id")


def agg_same_bag(spark, d):
    """AGG-08, SET-02: whether the copy has the report's bag of tokens."""
    return C.same_bag(C.bag(R.reports(spark, d), "report_id"), C.bag(lossy_texts(spark, d), "report_id"), "report_id")


def jon_best_page(spark, d):
    """JON-06, SRC-10: the page of its report that shares most tokens with each line of at least six."""
    lines = page_lines(spark, d).select("report_id", "line_no", "page_no", F.array_distinct(T.anchor_tokens(F.col("line"))).alias("tokens"))
    return C.best_page(lines.withColumn("asks", F.size("tokens") >= 6), ["report_id", "line_no"])


def seq_visual_lines(spark, d):
    """SEQ-10."""
    return G.visual_lines(boxes(spark, d)).groupBy("doc", "page_no", "line_no").agg(F.count("*").alias("n"), F.min("x0").alias("left"))


def seq_columns(spark, d):
    """SEQ-11."""
    return G.columns(boxes(spark, d))


def jon_columns(spark, d):
    """JON-10."""
    b = boxes(spark, d)
    return G.assign_columns(b, G.columns(b))


def seq_densest_band(spark, d):
    """SEQ-12."""
    return G.densest_band(boxes(spark, d), least=3)


def jon_in_regions(spark, d):
    """JON-08: words in the upper left region of their page, by a theta join."""
    b = boxes(spark, d)
    regions = b.where("word_no = 1").select("doc", "page_no", (F.col("x0") - 70).alias("x0"), (F.col("y0") - 70).alias("y0"), (F.col("x1") + 70).alias("x1"), (F.col("y1") + 70).alias("y1"))
    return G.in_regions(b, regions).groupBy("doc", "page_no").agg(F.count("*").alias("n"))


def agg_page_heights(spark, d):
    """AGG-11."""
    return G.page_heights(boxes(spark, d))


def jon_merge_boxes(spark, d):
    """JON-09: near boxes united: of each page how many boxes there were, how many lie in no united one, and how many united ones are still near another."""
    b = boxes(spark, d)
    m = G.merge_boxes(b)
    page = ["doc", "page_no"]
    u = m.select(*page, *(F.col(c).alias(f"u{c}") for c in ("x0", "y0", "x1", "y1")))
    inside = b.join(u, page).where("x0 >= ux0 and y0 >= uy0 and x1 <= ux1 and y1 <= uy1").groupBy(*page).agg(F.count_distinct("word_no").alias("n_inside"))
    near = m.join(u, page).where("(x0, y0, x1, y1) <> (ux0, uy0, ux1, uy1) and x0 < ux1 + 5 and ux0 < x1 + 5 and y0 < uy1 + 5 and uy0 < y1 + 5").groupBy(*page).agg(F.count("*").alias("n_near"))
    n = b.groupBy(*page).agg(F.count("*").alias("n_boxes"))
    return n.join(inside, page, "left").join(near, page, "left").select(*page, "n_boxes", (F.col("n_boxes") - F.coalesce("n_inside", F.lit(0))).alias("n_outside"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def pred_text_layer(spark, d):
    """PRED-01, PRED-03: characters a page in windows of 80 pages and halves of them, and whether that is a text layer."""
    pages = page_lines(spark, d).groupBy("report_id", "page_no").agg(F.sum(F.length("line")).alias("chars"))
    w = pages.groupBy("report_id", F.floor(F.col("page_no") / 80).alias("window_no"), (F.floor(F.col("page_no") / 40) % 2).alias("half"))
    rate = F.avg("chars")
    return w.agg(F.round(rate, 4).alias("rate"), (rate >= 200).alias("has_layer"), (rate < 50).alias("near_empty"))


def pred_scanned(spark, d):
    """PRED-02: at most ten evenly spaced pages of each report; scanned if four fifths of them have little text."""
    pages = page_lines(spark, d).groupBy("report_id", "page_no").agg(F.sum(F.length("line")).alias("chars"))
    n = pages.groupBy("report_id").agg((F.max("page_no") + 1).alias("n"))
    k = F.least(F.col("n"), F.lit(10))
    picks = n.select("report_id", "n", F.explode(F.sequence(F.lit(0), k - 1)).alias("i")).withColumn(
        "page_no", F.round(F.col("i") * (F.col("n") - 1) / F.greatest(F.least(F.col("n"), F.lit(10)) - 1, F.lit(1))).cast("long")
    )
    seen = picks.select("report_id", "page_no").distinct().join(pages, ["report_id", "page_no"], "left")
    share = F.avg(F.when(F.coalesce("chars", F.lit(0)) < 200, 1.0).otherwise(0.0))
    return seen.groupBy("report_id").agg(F.round(share, 4).alias("textless"), (share >= 0.8).alias("scanned"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith(("seq_", "agg_", "det_", "jon_", "pred_"))}

PAGES = rf"{S.REPORTS}, {S.lines('reports', 'report_id', name='all_lines')}, lines as (select report_id, (line_no - 1) // 40 as page_no, line_no, {S.strip('line')} as line from all_lines where {S.strip('line')} <> '')"
WORD = r"[A-Za-z][A-Za-z\-'']{3,}"
BAG = f"bag as (select report_id, token, count(*) as n from (select report_id, lower(unnest(regexp_extract_all(text, '{WORD}'))) as token from reports) group by 1, 2)"
LOSSY = f"lossy as (select report_id, token, count(*) as n from (select report_id, lower(unnest(regexp_extract_all(line, '{WORD}'))) as token from lines where line_no % 7 <> 3) group by 1, 2)"
BOXES = """b0 as (select l_orderkey // 10 as doc, (l_orderkey % 10)::int as page_no, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as word_no,
    (l_suppkey % 9 * 60)::double as x0, (l_partkey % 40 * 14)::double + (l_linenumber % 3) as y0 from lineitem),
boxes as (select *, x0 + 40 as x1, y0 + 10 as y1 from b0)"""
COLUMNS = """c1 as (select *, max(x1) over (partition by doc, page_no order by x0, x1, word_no rows between unbounded preceding and 1 preceding) as reach from boxes),
c2 as (select *, sum(case when x0 <= reach + 6 then 0 else 1 end) over (partition by doc, page_no order by x0, x1, word_no rows unbounded preceding) as column_no from c1),
cols as (select doc, page_no, column_no, min(x0) as "left", max(x1) as "right" from c2 group by 1, 2, 3)"""

SQL = {
    "seq_dehyphenate": rf"""
with recursive {PAGES},
words as (select report_id, page_no, line_no * 10000 + k - 1 as word_no, w[k] as word from (select report_id, page_no, line_no, regexp_split_to_array(line, '\s+') as w from lines), unnest(range(1, len(w) + 1)) as u(k) where w[k] <> ''),
a as (select *, row_number() over (partition by report_id, page_no order by word_no) as i, lead(word) over (partition by report_id, page_no order by word_no) as nx from words),
h as (select *, word like '%-' and length(word) > 1 and nx is not null as hy from a),
g as (select *, i - row_number() over (partition by report_id, page_no, hy order by i) as island from h),
m as (select *, hy and row_number() over (partition by report_id, page_no, hy, island order by i) % 2 = 1 as merges from g),
c as (select *, coalesce(lag(merges) over (partition by report_id, page_no order by i), false) as consumed from m)
select report_id, page_no, count(*) as n_words, sum(length(case when merges then word[:-2] || nx else word end))::bigint as n_chars from c where not consumed group by 1, 2""",
    "agg_bags": f"with {S.REPORTS}, {BAG} select report_id, count(*) as n_tokens, sum(n)::bigint as n, max(n) as most from bag group by 1",
    "agg_furniture": rf"""
with {PAGES}, {BAG}, p as (select report_id, greatest(3, floor(count(distinct page_no) * 0.3)) as least from lines group by 1),
u as (select l.report_id, line from lines l join p using (report_id) where length(line) between 5 and 119 group by 1, 2, least having count(distinct page_no) >= least),
f as (select report_id, token, count(*) as m from (select l.report_id, lower(unnest(regexp_extract_all(l.line, '{WORD}'))) as token from lines l join u on u.report_id = l.report_id and u.line = l.line) group by 1, 2)
select bag.report_id, sum(n - coalesce(m, 0))::bigint as n from bag left join f on f.report_id = bag.report_id and f.token = bag.token where n - coalesce(m, 0) > 0 group by 1""",
    "agg_running_headers": rf"with {S.REPORTS}, {S.lines('reports', 'report_id')}, s as (select report_id, {S.strip('line')} as line from lines) select report_id, line, count(*) as n from s where length(line) > 0 and length(line) < 60 and regexp_matches(line, '[\p{{L}}\p{{N}}]') group by 1, 2 having count(*) >= 4",
    "det_coverage": rf"""
with {PAGES}, {BAG}, {LOSSY}, g as (select b.report_id, b.token, b.n, greatest(b.n - coalesce(l.n, 0), 0) as gap from bag b left join lossy l on l.report_id = b.report_id and l.token = b.token),
s as (select report_id, sum(gap)::bigint as missing, sum(n)::bigint as total, array_to_string((list(token order by gap desc, token) filter (gap > 0))[1:20], ',') as examples from g group by 1)
select report_id, missing, total, case when missing / total > 0.05 then 'critical' when missing / total > 0.01 then 'warn' else 'info' end as severity, examples from s where missing > 0""",
    "agg_same_bag": rf"with {PAGES}, {BAG}, {LOSSY} select coalesce(b.report_id, l.report_id) as report_id, bool_and(b.n is not distinct from l.n) as same from bag b full join lossy l on l.report_id = b.report_id and l.token = b.token group by 1",
    "jon_best_page": rf"""
with {PAGES}, t as (select report_id, page_no, line_no, list_distinct(list_transform(regexp_extract_all(line, '[A-Za-z0-9]{{4,}}'), lambda x: lower(x))) as t from lines),
probes as (select report_id, line_no, unnest(t) as token from t where len(t) >= 6), pages as (select distinct report_id, page_no, token from (select report_id, page_no, unnest(t) as token from t)),
h as (select p.report_id, p.line_no, page_no, count(*) as hits from probes p join pages g on g.report_id = p.report_id and g.token = p.token group by 1, 2, 3)
select report_id, line_no, page_no, hits from (select *, row_number() over (partition by report_id, line_no order by hits desc, page_no) as r from h) where r = 1""",
    "seq_visual_lines": f"""
with {BOXES}, a as (select *, lag(y0) over (partition by doc, page_no order by y0, x0, word_no) as before from boxes),
l as (select *, sum(case when abs(y0 - before) <= 3 then 0 else 1 end) over (partition by doc, page_no order by y0, x0, word_no rows unbounded preceding) as line_no from a)
select doc, page_no, line_no::bigint as line_no, count(*) as n, min(x0) as "left" from l group by 1, 2, 3""",
    "seq_columns": f'with {BOXES}, {COLUMNS} select doc, page_no, column_no::bigint as column_no, "left", "right" from cols',
    "jon_columns": f"""
with {BOXES}, {COLUMNS}, o as (select b.doc, b.page_no, word_no, column_no, least(x1, "right") - greatest(x0, "left") as o from boxes b join cols c on c.doc = b.doc and c.page_no = b.page_no)
select doc, page_no, word_no, column_no::bigint as column_no from (select *, row_number() over (partition by doc, page_no, word_no order by o desc, column_no) as r from o where o > 0) where r = 1""",
    "seq_densest_band": f"""
with {BOXES}, a as (select *, max(y1) over (partition by doc, page_no order by y0, y1, word_no rows between unbounded preceding and 1 preceding) as reach from boxes),
s as (select *, sum(case when y0 - reach <= 24 then 0 else 1 end) over (partition by doc, page_no order by y0, y1, word_no rows unbounded preceding) as band from a),
g as (select doc, page_no, band, min(y0) as top, max(y1) as bottom, count(*) as n from s group by 1, 2, 3)
select doc, page_no, top, bottom, n from (select *, row_number() over (partition by doc, page_no order by n desc, band) as r from g) where r = 1 and n >= 3""",
    "jon_in_regions": f"""
with {BOXES}, r as (select doc, page_no, x0 - 70 as rx0, y0 - 70 as ry0, x1 + 70 as rx1, y1 + 70 as ry1 from boxes where word_no = 1)
select b.doc, b.page_no, count(*) as n from boxes b where exists (select 1 from r where r.doc = b.doc and r.page_no = b.page_no and (x0 + x1) / 2 between rx0 and rx1 and (y0 + y1) / 2 between ry0 and ry1) group by 1, 2""",
    "agg_page_heights": f"with {BOXES} select doc, page_no, max(y1) + 36 as height from boxes group by 1, 2",
    "jon_merge_boxes": f"with {BOXES} select doc, page_no, count(*) as n_boxes, 0::bigint as n_outside, 0::bigint as n_near from boxes group by 1, 2",
    "pred_text_layer": rf"""
with {PAGES}, p as (select report_id, page_no, sum(length(line)) as chars from lines group by 1, 2)
select report_id, page_no // 80 as window_no, page_no // 40 % 2 as half, round(avg(chars), 4) as rate, avg(chars) >= 200 as has_layer, avg(chars) < 50 as near_empty from p group by 1, 2, 3""",
    "pred_scanned": rf"""
with {PAGES}, p as (select report_id, page_no, sum(length(line)) as chars from lines group by 1, 2), n as (select report_id, max(page_no) + 1 as n from p group by 1),
k as (select distinct report_id, round(i * (n - 1) / greatest(least(n, 10) - 1, 1))::bigint as page_no from n, unnest(range(least(n, 10))) as u(i)),
s as (select k.report_id, case when coalesce(chars, 0) < 200 then 1.0 else 0.0 end as textless from k left join p on p.report_id = k.report_id and p.page_no = k.page_no)
select report_id, round(avg(textless), 4) as textless, avg(textless) >= 0.8 as scanned from s group by 1""",
}
