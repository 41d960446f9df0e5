"""Queries on tables and the word boxes of their pages; both are laid out from the corpus' own table chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.operators import audit as A
from tessera.operators import blocks as B
from tessera.operators import coverage as C
from tessera.operators import geometry as G
from tessera.operators import regions as X
from tessera.operators import repair as P
from tessera.plans import _sql as S
from tessera.plans import audit as Q
from tessera.plans import layers as L
from tessera.plans import tables as R
from tessera.session import cut, read
from tessera.sources import vision as V


def _grids(spark, d):
    """(chunk_id, rows, n, h): cells of the rows of every pipe table of at least three rows, its header first; h is drawn from the id."""
    t = R.table_chunks(spark, d).where("chunk_id is not null")
    rows = F.filter(T.split_lines(F.col("text")), lambda x: T.is_pipe_row(x) & ~T.is_separator(x))
    g = t.select("chunk_id", F.transform(rows, lambda x: T.cells(x)).alias("rows")).where("size(rows) >= 3")
    return g.select("chunk_id", "rows", F.size(F.get("rows", F.lit(0))).alias("n"), F.conv(F.substring("chunk_id", 1, 4), 16, 10).cast("int").alias("h"))


def _line(cells):
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _words(rows):
    """Boxes of rows (chunk_id, page_no, y, k, cells): a cell every 240 points, a word every 40."""
    cell = rows.select("chunk_id", "page_no", "y", "k", F.posexplode("cells").alias("c", "cell"))
    word = cell.select("chunk_id", "page_no", "y", "k", "c", F.posexplode(F.split("cell", r"\s+")).alias("i", "word")).where("word <> ''")
    x = (F.lit(60) + F.col("c") * 240 + F.col("i") * 40).cast("double")
    number = (F.col("k") * 100000 + F.col("c") * 100 + F.col("i")).cast("long")
    return word.select("chunk_id", "page_no", number.alias("word_no"), x.alias("x0"), F.col("y").alias("y0"), (x + 36).alias("x1"), (F.col("y") + 10).alias("y1"), "word")


def torn_apart(spark, d):
    """(lines, words): each table in two parts with a line between them, and its pages, on which most are torn by the page's end."""
    g = _grids(spark, d).withColumn("m", F.ceil((F.size("rows") - 1) / 2).cast("int"))
    head, first = F.slice("rows", 1, 1), F.slice("rows", F.lit(2), F.col("m"))
    second = F.slice("rows", F.col("m") + 2, F.size("rows"))
    rule = F.array(F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("n"))))
    gap = F.array(F.when(F.col("h") % 3 == 0, "").when(F.col("h") % 3 == 1, "# Part").otherwise("Some words."))
    again = F.when(F.col("h") % 2 == 0, F.concat(F.transform(head, _line), rule)).otherwise(F.array().cast("array<string>"))
    text = F.concat(F.transform(head, _line), rule, F.transform(first, _line), gap, again, F.transform(second, _line))
    lines = g.select("chunk_id", F.posexplode(text).alias("pos", "line")).select("chunk_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    top = F.when(F.col("h") % 5 < 4, F.lit(780) - 18 * F.col("m")).otherwise(300)
    above = g.select("chunk_id", F.lit(0).alias("page_no"), F.posexplode(F.concat(head, first)).alias("k", "cells"), top.alias("top"))
    below = g.select("chunk_id", F.lit(1).alias("page_no"), F.posexplode(second).alias("k", "cells"), F.when(F.col("h") % 7 < 5, 40).otherwise(400).alias("top"))
    rows = above.unionByName(below).select("chunk_id", "page_no", (F.col("top") + 18 * F.col("k")).cast("double").alias("y"), "k", "cells")
    feet = g.select("chunk_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("page_no"), F.lit(800.0).alias("y"), F.lit(900).alias("k"), F.array(F.lit("page")).alias("cells"))
    captions = g.where("h % 11 = 0").select("chunk_id", F.lit(1).alias("page_no"), F.lit(20.0).alias("y"), F.lit(901).alias("k"), F.array(F.lit("Table 2:")).alias("cells"))
    return lines, _words(rows.unionByName(feet).unionByName(captions))


def jon_table_pages(spark, d):
    """JON-07: the page of each part with most occurrences of its values."""
    lines, words = torn_apart(spark, d)
    return X.locate(B.table_blocks(lines, "chunk_id"), words, "chunk_id")


def rep_regions(spark, d):
    """REP-LOC, SEQ-12: the region of each part on its page."""
    lines, words = torn_apart(spark, d)
    return X.regions(B.table_blocks(lines, "chunk_id"), words, "chunk_id")


def det_split_tables(spark, d):
    """DET-110: neighbouring parts of one table, confirmed by the boxes or only reported."""
    lines, words = torn_apart(spark, d)
    return X.split_pairs(lines, B.table_blocks(lines, "chunk_id"), words, "chunk_id").select("chunk_id", "block", "next_block", "state")


def rep_merge_split(spark, d):
    """REP-110: the texts with the confirmed parts made one."""
    lines, words = torn_apart(spark, d)
    blocks = B.table_blocks(lines, "chunk_id")
    pairs = cut(X.split_pairs(lines, blocks, words, "chunk_id"))
    merged = P.merge_split_tables(blocks, pairs.where("state = 'merge'").select("chunk_id", F.col("next_block").alias("block")), "chunk_id").select("chunk_id", "line_no", "line")
    others = X.without_gaps(lines, pairs, "chunk_id").join(blocks.select("chunk_id", "line_no"), ["chunk_id", "line_no"], "left_anti")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return merged.unionByName(others).groupBy("chunk_id").agg(F.md5(text).alias("text_hash"), F.count("*").alias("n_lines"))


def fused_tables(spark, d):
    """(lines, words): tables whose first row of data was fused into the header, and their pages; some of these lack a row."""
    g = _grids(spark, d)
    fused = F.transform(F.arrays_zip(F.get("rows", F.lit(0)).alias("a"), F.get("rows", F.lit(1)).alias("b")), lambda x: T.strip(F.concat_ws(" ", x["a"], x["b"])))
    rule = F.array(F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("n"))))
    text = F.concat(F.array(_line(fused)), rule, F.transform(F.slice("rows", F.lit(3), F.size("rows")), _line))
    lines = g.select("chunk_id", F.posexplode(text).alias("pos", "line")).select("chunk_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    rows = g.select("chunk_id", F.lit(0).alias("page_no"), F.posexplode("rows").alias("k", "cells")).withColumn("y", (F.lit(100) + 18 * F.col("k")).cast("double"))
    lost = rows.where(~((F.col("k") == 2) & (F.conv(F.substring("chunk_id", 5, 2), 16, 10).cast("int") % 4 == 0)))
    return lines, _words(lost)


def rep_fused(spark, d):
    """REP-105: tables with fused headers, built again from their page or reported."""
    lines, words = fused_tables(spark, d)
    return X.rebuild_fused(B.table_blocks(lines, "chunk_id"), words, "chunk_id").select("chunk_id", "status", F.md5("table").alias("table_hash"))


def torn_orders(spark, d):
    """(lines, words): a table for each order with torn numbers, and its page; a third of the orders have another number there."""
    k = F.col("l_orderkey")
    n, q, p = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey").cast("string")
    torn = F.concat(F.lit("| part"), p, F.lit(" | "), q, F.lit(" | "), n, F.lit(" | × 10 | - "), n, F.lit(" |"))
    digits = F.when((k % 3 == 0) & (F.col("l_linenumber") == 2), "77").otherwise(q)
    value = F.concat(digits, F.lit("."), n, F.lit(" × 10 -"), n)
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", torn.alias("line"), p.alias("p"), value.alias("value"))
    orders = read(spark, d, "lineitem").where(k % 5 == 0).groupBy(k.alias("doc")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    text = F.concat(F.array(F.lit("| part | sum |  |  |  |"), F.lit("|---|---|---|---|---|")), F.transform("rows", lambda r: r["line"]))
    lines = orders.select("doc", F.posexplode(text).alias("pos", "line")).select("doc", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    cells = orders.select(F.col("doc").alias("chunk_id"), F.lit(0).alias("page_no"), F.posexplode("rows").alias("k", "r"))
    cells = cells.select("chunk_id", "page_no", (F.lit(100) + 18 * F.col("k")).cast("double").alias("y"), "k", F.array(F.concat(F.lit("part"), F.col("r.p")), F.col("r.value")).alias("cells"))
    return lines, _words(cells).withColumnRenamed("chunk_id", "doc")


def rep_torn_columns(spark, d):
    """REP-104: the rows of these tables with whole numbers, where every row's was found."""
    lines, words = torn_orders(spark, d)
    return X.merge_torn_columns(B.table_blocks(lines, "doc"), words, "doc").select("doc", "line_no", "line", "status")


def det_figure_tokens(spark, d):
    """DET-202: words in figures of every second page that the text without every seventh line lacks."""
    w = L.page_words(spark, d)
    line = F.floor(F.col("word_no") / 10000) - 1
    y = (line % 40 * 18).cast("double")
    words = w.select(F.col("report_id").alias("doc"), "page_no", "word_no", F.lit(100.0).alias("x0"), y.alias("y0"), F.lit(140.0).alias("x1"), (y + 10).alias("y1"), "word")
    regions = words.where("page_no % 2 = 0").select("doc", "page_no").distinct().select("*", F.lit(0.0).alias("x0"), F.lit(180.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(355.0).alias("y1"))
    figures = C.bag(G.in_regions(words, regions).select(F.col("doc").alias("report_id"), F.col("word").alias("text")), "report_id")
    return C.deficit(figures, C.bag(L.lossy_texts(spark, d), "report_id"), "report_id", 15).withColumn("severity", F.lit("info"))


def src_tables(spark, d):
    """SRC-07, TOOL-12: tables found on the pages of table chunks, a third of them in drawn frames."""
    g = _grids(spark, d)
    rows = g.select("chunk_id", F.lit(0).alias("page_no"), F.posexplode("rows").alias("k", "cells")).withColumn("y", (F.lit(100) + 18 * F.col("k")).cast("double"))
    height = F.lit(100) + 18 * F.size("rows")
    frames = g.where("h % 3 = 0").select("chunk_id", F.lit(0).alias("page_no"), F.lit(0.0).alias("x0"), F.lit(95.0).alias("y0"), F.lit(9000.0).alias("x1"), height.cast("double").alias("y1"))
    notes = g.where("h % 3 = 0").select("chunk_id", F.lit(0).alias("page_no"), F.lit(800).alias("k"), F.array(F.lit("note")).alias("cells"), F.lit(20.0).alias("y"))
    found = X.extract_tables(_words(rows.unionByName(notes)), frames, "chunk_id")
    return found.select("chunk_id", "table_no", "strategy", "score", F.md5("table").alias("table_hash"))


def bare_figures(spark, d):
    """(chunk_id, chunk_type, text): chunks with their text, figures with an even sign in their id without descriptions."""
    c = R.chunks(spark, d).where("content is not null")
    bare = F.conv(F.substring("chunk_id", 1, 1), 16, 10).cast("int") % 2 == 0
    return c.select("chunk_id", "chunk_type", F.when(bare, F.regexp_replace("content", r"\n>[^\n]*", "")).otherwise(F.col("content")).alias("text"))


def rep_figures(spark, d):
    """REP-FIG: chunks whose bare images get a description, here their file's name in words; short ones are left out."""
    lines = R.lines_of(bare_figures(spark, d), "chunk_id")
    refs = lines.select("chunk_id", F.regexp_extract(T.strip(F.col("line")), r"^!\[[^\]]*\]\(([^)]+)\)$", 1).alias("ref")).where("ref <> ''").distinct()
    told = refs.select("chunk_id", "ref", F.concat(F.lit("Shows "), F.translate(F.regexp_extract("ref", r"([^/.]+)\.\w+$", 1), "_", " ")).alias("text"))
    done = V.describe_figures(lines, told, "chunk_id")
    return done.where(F.col("line").contains("\n> **Figure:** ")).select("chunk_id", "line_no", "line")


def pred_image_only(spark, d):
    """PRED-04: chunks whose filled lines are images alone."""
    c = bare_figures(spark, d)
    filled = F.filter(F.transform(T.split_lines(F.col("text")), T.strip), lambda x: x != "")
    only = (F.size(filled) > 0) & F.forall(filled, lambda x: x.rlike(r"^!\[[^\]]*\]\([^)]+\)$"))
    return c.where(only).select("chunk_id", "chunk_type")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith(("jon_", "rep_", "det_", "src_", "pred_")) and callable(v)}

GRIDS = rf"""{S.TABLES}, {S.lines('tables', 'chunk_id')},
r0 as (select chunk_id, line_no, {S.cells('line')} as cells from lines where regexp_matches({S.strip('line')}, '^\|.*\|$') and not (regexp_full_match(line, '\s*\|?[\s:|-]+\|?\s*') and contains(line, '-'))),
grid as (select chunk_id, list(cells order by line_no) as rows, ('0x' || substr(chunk_id, 1, 4))::int as h, ('0x' || substr(chunk_id, 5, 2))::int as h2 from r0 group by 1 having count(*) >= 3)"""
APART = f"""{GRIDS}, g as (select *, len(rows[1]) as n, (len(rows) // 2)::int as m from grid),
tl as (select chunk_id, h, n, m, list_concat(['| ' || array_to_string(rows[1], ' | ') || ' |', '|' || repeat('---|', n)], list_transform(rows[2:m + 1], lambda c: '| ' || array_to_string(c, ' | ') || ' |'),
    [case when h % 3 = 0 then '' when h % 3 = 1 then '# Part' else 'Some words.' end], case when h % 2 = 0 then ['| ' || array_to_string(rows[1], ' | ') || ' |', '|' || repeat('---|', n)] else [] end,
    list_transform(rows[m + 2:], lambda c: '| ' || array_to_string(c, ' | ') || ' |')) as ls, len(rows) - 1 - m as m2, rows from g),
part as (select chunk_id, 1 as block, rows[1:m + 1] as rows, m + 2 as n_lines from tl
    union all select chunk_id, m + 4, case when h % 2 = 0 then list_concat([rows[1]], rows[m + 2:]) else rows[m + 2:] end, case when h % 2 = 0 then m2 + 2 else m2 end from tl),
val as (select distinct chunk_id, block, unnest(flatten(list_transform(flatten(rows), lambda c: regexp_split_to_array(c, '\\s+')))) as word from part where n_lines >= 2),
rw as (select chunk_id, 0 as page_no, (case when h % 5 < 4 then 780 - 18 * m else 300 end + 18 * (k - 1))::double as y, k, rows[k] as cells from g, unnest(range(1, m + 2)) as u(k)
    union all select chunk_id, 1, (case when h % 7 < 5 then 40 else 400 end + 18 * (k - m - 2))::double, k, rows[k] from g, unnest(range(m + 2, len(rows) + 1)) as u(k)
    union all select chunk_id, p, 800, 900, ['page'] from g, unnest([0, 1]) as u(p) union all select chunk_id, 1, 20, 901, ['Table 2:'] from g where h % 11 = 0),
cw as (select chunk_id, page_no, y, c, regexp_split_to_array(cells[c], '\\s+') as w from rw, unnest(range(1, len(cells) + 1)) as u(c)),
words as (select chunk_id, page_no, y as y0, y + 10 as y1, (60 + (c - 1) * 240 + (i - 1) * 40)::double as x0, (96 + (c - 1) * 240 + (i - 1) * 40)::double as x1, w[i] as word from cw, unnest(range(1, len(w) + 1)) as u(i) where w[i] <> ''),
hit as (select w.*, block from words w join val v on v.chunk_id = w.chunk_id and v.word = w.word where length(v.word) >= 3),
pg as (select chunk_id, block, page_no, count(*) as hits, min(y0) as y_top, max(y1) as y_bottom from hit group by 1, 2, 3),
loc as (select * from (select *, row_number() over (partition by chunk_id, block order by hits desc, page_no) as rn from pg) where rn = 1 and hits >= 3),
pair as (select t.chunk_id, 1 as block, t.m + 4 as next_block, t.h, coalesce(b.page_no = a.page_no + 1 and a.y_bottom >= 0.85 * 846 and b.y_top <= 0.15 * 846
        and not (t.h % 11 = 0 and (1 = a.page_no and 20 > a.y_bottom or 1 = b.page_no and 20 < b.y_top)), false) as merges
    from tl t join part q on q.chunk_id = t.chunk_id and q.block <> 1 and q.n_lines >= 2 left join loc a on a.chunk_id = t.chunk_id and a.block = 1 left join loc b on b.chunk_id = t.chunk_id and b.block = t.m + 4
    where t.h % 3 <> 2 and len(q.rows[1]) = t.n)"""
CELLS = rf"""{GRIDS}, cell as (select chunk_id, h, h2, k, c, regexp_replace(rows[k][c], '\s+', ' ', 'g') as cell from (select *, unnest(range(1, len(rows) + 1)) as k from grid), unnest(range(1, len(rows[k]) + 1)) as u(c)),
used as (select chunk_id, c from cell group by 1, 2 having bool_or(cell <> ''))"""
NUMBER = "(^|[^A-Za-z0-9_.])[0-9]+([.][0-9]+)?%?($|[^A-Za-z0-9_])"

BARE = r"""c0 as (select chunk_id, max_by(struct_pack(content, chunk_type), struct_pack(indexed_at, seq)) as r from chunks group by 1),
c as (select chunk_id, r.chunk_type as chunk_type, case when ('0x' || substr(chunk_id, 1, 1))::int % 2 = 0 then regexp_replace(r.content, '\n>[^\n]*', '', 'g') else r.content end as text from c0 where r.content is not null)"""
FUSED = f"""with fu as (select chunk_id, count(*) filter (regexp_matches(f, '{NUMBER}')) as n from (select a.chunk_id, a.c, trim(a.cell || ' ' || coalesce(b.cell, '')) as f from cell a left join cell b on b.chunk_id = a.chunk_id and b.c = a.c and b.k = 2 where a.k = 1) group by 1),
nu as (select chunk_id, min(k) as f from cell where regexp_matches(cell, '{NUMBER}') group by 1),
hd as (select cell.chunk_id, c, string_agg(cell, ' ' order by k) as cell from cell join nu on nu.chunk_id = cell.chunk_id where k < f and cell <> '' group by 1, 2),
ro as (select u.chunk_id, -1 as k, '| ' || string_agg(coalesce(hd.cell, ''), ' | ' order by u.c) || ' |' as line from used u left join hd on hd.chunk_id = u.chunk_id and hd.c = u.c group by 1
    union all select u.chunk_id, 0, '| ' || string_agg('---', ' | ') || ' |' from used u group by 1
    union all select c.chunk_id, k, '| ' || string_agg(cell, ' | ' order by c.c) || ' |' from cell c join used u on u.chunk_id = c.chunk_id and u.c = c.c join nu on nu.chunk_id = c.chunk_id where k >= f group by 1, 2 having bool_or(cell <> '')),
tb as (select chunk_id, string_agg(line, chr(10) order by k) as t from ro group by 1),
lo as (select chunk_id from cell where k = 3 and h2 % 4 = 0 group by 1 having bool_or(cell <> ''))
select fu.chunk_id, case when ok then 'repaired' else 'reported' end as status, case when ok then t end as built from (select fu.chunk_id, t, coalesce(f > 1, false) and lo.chunk_id is null as ok from fu left join nu on nu.chunk_id = fu.chunk_id
    left join tb on tb.chunk_id = fu.chunk_id left join lo on lo.chunk_id = fu.chunk_id where n >= 2) fu"""

SQL = {
    "rep_fused": f"with {CELLS} select chunk_id, status, md5(built) as table_hash from ({FUSED})",
    "rep_figures": rf"""with {BARE}, {S.lines('c', 'chunk_id')},
i as (select *, regexp_extract({S.strip('line')}, '^!\[[^\]]*\]\(([^)]+)\)$', 1) as ref, coalesce(regexp_matches({S.strip('lead(line) over (partition by chunk_id order by line_no)')}, '^>\s*\*\*Figure'), false) as described from lines),
b as (select *, row_number() over (partition by chunk_id order by line_no) as place, 'Shows ' || replace(regexp_extract(ref, '([^/.]+)\.\w+$', 1), '_', ' ') as told from i where ref <> '' and not described)
select chunk_id, line_no, line || chr(10) || '> **Figure:** ' || trim(told) as line from b where place <= 20 and length(trim(told)) > 20""",
    "pred_image_only": rf"""with {BARE}, {S.lines('c', 'chunk_id')},
f as (select chunk_id, count(*) as n, count(*) filter (regexp_full_match({S.strip('line')}, '!\[[^\]]*\]\([^)]+\)')) as m from lines where {S.strip('line')} <> '' group by 1) select c.chunk_id, chunk_type from c join f on f.chunk_id = c.chunk_id where n = m""",
    "src_tables": f"""with {CELLS}, ro as (select c.chunk_id, any_value(h) as h, k, count(*) as n, count(*) filter (cell <> '') as filled, '| ' || string_agg(cell, ' | ' order by c.c) || ' |' as line from cell c join used u on u.chunk_id = c.chunk_id and u.c = c.c group by 1, 3 having bool_or(cell <> '')),
tb as (select chunk_id, any_value(h) as h, count(*) as m, max(n) as n, round(0.6 + 0.4 * (sum(filled) / sum(n)), 3) as score, min(k) as first_k, string_agg(line, chr(10) order by k) as t, string_agg(line, chr(10) order by k) filter (k > 1) as body, arg_min(line, k) as head from ro group by 1)
select chunk_id, 1 as table_no, case when h % 3 = 0 then 'ruled' else 'aligned' end as strategy, score, md5(head || chr(10) || '| ' || array_to_string(list_transform(range(n), lambda i: '---'), ' | ') || ' |' || chr(10) || substr(t, length(head) + 2)) as table_hash from tb where m >= 2 and n >= 2""",
    "jon_table_pages": f"with {APART} select chunk_id, block::bigint as block, page_no, hits, y_top, y_bottom from loc",
    "rep_regions": f"""with {APART}, hl as (select hit.* from hit join loc on loc.chunk_id = hit.chunk_id and loc.block = hit.block and loc.page_no = hit.page_no),
s1 as (select *, max(y1) over (partition by chunk_id, block order by y0, y1, x0 rows between unbounded preceding and 1 preceding) as reach from hl),
s2 as (select *, sum(case when y0 - reach <= 24 then 0 else 1 end) over (partition by chunk_id, block order by y0, y1, x0 rows unbounded preceding) as band from s1),
bd as (select chunk_id, block, page_no, band, min(y0) as t, max(y1) as b, count(*) as n, min(x0) as l, max(x1) as r from s2 group by 1, 2, 3, 4)
select chunk_id, block::bigint as block, page_no, l - 10 as x0, t - 8 as y0, r + 10 as x1, b + 8 as y1 from (select *, row_number() over (partition by chunk_id, block order by n desc, band) as rn from bd) where rn = 1 and n >= 3""",
    "det_split_tables": f"with {APART} select chunk_id, block::bigint as block, next_block::bigint as next_block, case when merges then 'merge' else 'report' end as state from pair",
    "rep_merge_split": f"""with {APART} select t.chunk_id, md5(array_to_string(x, chr(10))) as text_hash, len(x)::bigint as n_lines
from (select t.chunk_id, case when coalesce(merges, false) then list_concat(ls[1:m + 2], list_transform(rows[m + 2:], lambda c: '| ' || array_to_string(c, ' | ') || ' |')) else ls end as x from tl t left join pair on pair.chunk_id = t.chunk_id) t""",
    "det_figure_tokens": rf"""with {L.PAGES}, {L.LOSSY}, f as (select report_id, token, count(*) as n from (select report_id, lower(unnest(regexp_extract_all(line, '{L.WORD}'))) as token from lines where page_no % 2 = 0 and (line_no - 1) % 40 between 10 and 19) group by 1, 2),
g as (select f.report_id, f.token, f.n, greatest(f.n - coalesce(l.n, 0), 0) as gap from f left join lossy l on l.report_id = f.report_id and l.token = f.token),
s as (select report_id, sum(gap)::bigint as missing, sum(n)::bigint as total, array_to_string((list(token order by gap desc, token) filter (gap > 0))[1:15], ',') as examples from g group by 1)
select report_id, missing, total, 'info' as severity, examples from s where missing > 0""",
    "rep_torn_columns": """
with r as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, trunc(l_quantity)::int::varchar) as k, l_linenumber as n, trunc(l_quantity)::int as q, l_partkey as p from lineitem where l_orderkey % 5 = 0),
o as (select doc, count(*) as m, bool_or(doc % 3 = 0 and n = 2 and q <> 77) as off from r group by 1 having count(*) >= 2),
x as (select doc, 1 as line_no, '| part | sum |  |  |  |' as torn, '| part | sum |' as whole from o union all select doc, 2, '|---|---|---|---|---|', '| --- | --- |' from o
    union all select r.doc, k + 2, '| part' || p || ' | ' || q || ' | ' || n || ' | × 10 | - ' || n || ' |', '| part' || p || ' | ' || case when r.doc % 3 = 0 and n = 2 then 77 else q end || '.' || n || ' × 10 -' || n || ' |' from r join o on o.doc = r.doc)
select x.doc, line_no::bigint as line_no, case when off then torn else whole end as line, case when off then 'reported' else 'repaired' end as status from x join o on o.doc = x.doc""",
}


def _report_sql() -> str:
    """One row over both repairs."""
    return f"select (select count(*) from ({SQL['rep_fused']}) where status = 'repaired') + (select count(distinct doc) from ({SQL['rep_torn_columns']}) where status = 'repaired') as repaired, (select count(*) from ({SQL['rep_fused']}) where status = 'reported') + (select count(distinct doc) from ({SQL['rep_torn_columns']}) where status = 'reported') as reported"


def rep_report(spark, d):
    """AGG-10: tables repaired and reported over the repairs of fused headers and torn columns."""
    torn = rep_torn_columns(spark, d).select("doc", "status").distinct().select("status")
    both = rep_fused(spark, d).select("status").unionByName(torn)
    return both.agg(F.count_if(F.col("status") == "repaired").alias("repaired"), F.count_if(F.col("status") == "reported").alias("reported"))


QUERIES["rep_report"] = rep_report
SQL["rep_report"] = _report_sql()


def audit_tables(spark, d):
    """DET-103 to DET-107, AUD: issues of the corpus' own tables, whose first row of data was fused into the header."""
    lines, _ = fused_tables(spark, d)
    return A.all_rules(lines, "chunk_id")


QUERIES["audit_tables"] = audit_tables
SQL["audit_tables"] = f"""with {CELLS}, fh as (select a.chunk_id, a.c, trim(a.cell || ' ' || coalesce(b.cell, '')) as f from cell a left join cell b on b.chunk_id = a.chunk_id and b.c = a.c and b.k = 2 where a.k = 1),
l as (select chunk_id as doc, 1 as line_no, '| ' || string_agg(f, ' | ' order by c) || ' |' as line from fh group by 1 union all select chunk_id, 2, '|' || repeat('---|', count(*)) from fh group by 1
    union all select chunk_id, k, '| ' || array_to_string(rows[k], ' | ') || ' |' from (select *, unnest(range(3, len(rows) + 1)) as k from grid)),
{Q._blocks_sql('l', 'doc')} select doc as chunk_id, rule, severity, n, lines from ({Q.RULE_103} union all {Q.RULE_104} union all {Q.RULE_105} union all {Q.RULE_107})"""
