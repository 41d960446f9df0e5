"""Tables of a text found again among the word boxes of its pages, and repairs that these boxes confirm.

Blocks are rows (key, block, row_no, line_no, line) of pipe tables; words have the same key, page_no,
word_no, x0, y0, x1, y1 and word. Every join carries the key, so a document meets only itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.operators import audit as A
from tessera.operators import geometry as G
from tessera.session import cut

LEAST_HITS, LONG_VALUE = 3, 3
FOOT, HEAD = 0.85, 0.15
PAD_X, PAD_Y = 10.0, 8.0
LINE_SHARE = 0.6
CAPTION = r"(?i)^(?:table|figure|表|图)\s*[\d.::]*$"


def _values(blocks: DataFrame, key: str) -> DataFrame:
    """(key, block, word): distinct words of at least three signs in a table's cells."""
    rows = blocks.where(~T.is_separator(F.col("line")))
    words = rows.select(key, "block", F.explode(F.flatten(F.transform(T.cells(F.col("line")), lambda c: F.split(c, r"\s+")))).alias("word"))
    return words.where(F.length("word") >= LONG_VALUE).distinct()


def locate(blocks: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, block, page_no, hits, y_top, y_bottom): the page with most occurrences of a table's values, at least three, the first of equals."""
    hits = words.join(_values(blocks, key), [key, "word"])
    pages = hits.groupBy(key, "block", "page_no").agg(F.count("*").alias("hits"), F.min("y0").alias("y_top"), F.max("y1").alias("y_bottom"))
    best = F.max_by(F.struct("page_no", "hits", "y_top", "y_bottom"), F.struct(F.col("hits"), (-F.col("page_no")).alias("early")))
    return pages.groupBy(key, "block").agg(best.alias("b")).select(key, "block", "b.*").where(F.col("hits") >= LEAST_HITS)


def regions(blocks: DataFrame, words: DataFrame, key: str, gap: float = 24.0) -> DataFrame:
    """(key, block, page_no, x0, y0, x1, y1): the densest band of a table's values on its page, with a margin."""
    on_page = words.join(_values(blocks, key), [key, "word"]).join(locate(blocks, words, key).select(key, "block", "page_no"), [key, "block", "page_no"])
    by = [key, "block", "page_no"]
    band = G.densest_band(on_page, gap, LEAST_HITS, by)
    inside = on_page.join(band, by).where((F.col("y0") >= F.col("top")) & (F.col("y1") <= F.col("bottom")))
    sides = inside.groupBy(*by, "top", "bottom").agg(F.min("x0").alias("left"), F.max("x1").alias("right"))
    return sides.select(*by, (F.col("left") - PAD_X).alias("x0"), (F.col("top") - PAD_Y).alias("y0"), (F.col("right") + PAD_X).alias("x1"), (F.col("bottom") + PAD_Y).alias("y1"))


def split_pairs(lines: DataFrame, blocks: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, block, next_block, gap_from, gap_to, state): neighbouring tables that may be one, torn by a page break.

    They have as many columns, and only blank lines or headings between them. The state is merge if the
    boxes confirm it: the first ends in the last 15 % of its page, the second begins in the first 15 % of
    the next page (both measured on the first page), and no caption stands below or above; else report.
    """
    sizes = blocks.groupBy(key, "block").agg(F.max("line_no").alias("last"), F.max_by(F.size(T.cells(F.col("line"))), -F.col("row_no")).alias("n_columns"))
    w = Window.partitionBy(key).orderBy("block")
    pairs = sizes.select(key, "block", "last", "n_columns", F.lead("block").over(w).alias("next_block"), F.lead("n_columns").over(w).alias("next_columns"))
    pairs = pairs.where("n_columns = next_columns")
    between = lines.select(key, "line_no", "line").join(pairs.select(key, "block", "last", "next_block"), key).where((F.col("line_no") > F.col("last")) & (F.col("line_no") < F.col("next_block")))
    texts = between.where((T.strip(F.col("line")) != "") & ~T.strip(F.col("line")).startswith("#")).select(key, "block").distinct()
    pairs = pairs.join(texts, [key, "block"], "left_anti")
    at = cut(locate(blocks, words, key))
    heights = words.groupBy(key, "page_no").agg((F.max("y1") + 36).alias("height"))
    first = at.select(key, "block", F.col("page_no").alias("page"), F.col("y_bottom").alias("bottom")).join(heights.withColumnRenamed("page_no", "page"), [key, "page"])
    second = at.select(key, F.col("block").alias("next_block"), F.col("page_no").alias("next_page"), F.col("y_top").alias("top"))
    placed = pairs.join(first, [key, "block"], "left").join(second, [key, "next_block"], "left")
    captions = words.where(F.col("word").rlike(CAPTION)).select(key, F.col("page_no").alias("caption_page"), F.col("y0").alias("caption_y"))
    below = (F.col("caption_page") == F.col("page")) & (F.col("caption_y") > F.col("bottom"))
    above = (F.col("caption_page") == F.col("next_page")) & (F.col("caption_y") < F.col("top"))
    captioned = placed.join(captions, key).where(below | above).select(key, "block").distinct().withColumn("captioned", F.lit(True))
    fits = (F.col("next_page") == F.col("page") + 1) & (F.col("bottom") >= FOOT * F.col("height")) & (F.col("top") <= HEAD * F.col("height"))
    state = F.when(F.coalesce(fits, F.lit(False)) & F.col("captioned").isNull(), "merge").otherwise("report")
    return placed.join(captioned, [key, "block"], "left").select(key, "block", "next_block", (F.col("last") + 1).alias("gap_from"), (F.col("next_block") - 1).alias("gap_to"), state.alias("state"))


def without_gaps(lines: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Lines without those between the two parts of merged tables."""
    gaps = pairs.where("state = 'merge'").select(key, "gap_from", "gap_to")
    hit = [lines[key] == gaps[key], (F.col("line_no") >= F.col("gap_from")) & (F.col("line_no") <= F.col("gap_to"))]
    return lines.join(gaps, hit, "left_anti")


# --- torn numbers (104) ------------------------------------------------------------------------------------------------------


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def merge_torn_columns(blocks: DataFrame, words: DataFrame, key: str, longest: int = 6) -> DataFrame:
    """(key, block, line_no, line, status): rows of tables with torn numbers, each whole again, or all as they were and reported.

    The torn rows of a table must have their fragments in the same neighbouring columns. A row's value is
    a run of up to six words on a line of the pages that has one of the row's other values; squashed and
    without its points it is the fragments; the rightmost run counts, the longest of these. Only if every
    torn row is found, the columns become one in all rows of the table.
    """
    rows = blocks.withColumn("cells", T.cells(F.col("line"))).withColumn("ruled", T.is_separator(F.col("line")))
    marks = F.transform("cells", lambda c: A.is_fragment(c))
    torn = rows.where(A.is_torn(F.col("line"))).withColumn("at", F.filter(F.transform(marks, lambda m, i: F.when(m, i + 1)), lambda i: i.isNotNull()))
    first, last = F.array_min("at"), F.array_max("at")
    torn = torn.withColumn("first", first).withColumn("last", last).where(F.size("at") == last - first + 1)
    spans = torn.groupBy(key, "block").agg(F.count("*").alias("n_torn"), F.min("first").alias("first"), F.max("first").alias("f2"), F.min("last").alias("last"), F.max("last").alias("l2"))
    all_torn = rows.where(A.is_torn(F.col("line"))).groupBy(key, "block").agg(F.count("*").alias("n_all"))
    spans = spans.join(all_torn, [key, "block"]).where("n_torn >= 2 and n_torn = n_all and first = f2 and last = l2").select(key, "block", "first", "last", "n_torn")
    wanted = torn.drop("first", "last").join(spans, [key, "block"]).select(
        key, "block", "line_no",
        F.replace(T.squash(F.array_join(F.slice("cells", F.col("first"), F.col("last") - F.col("first") + 1), "")), F.lit("."), F.lit("")).alias("target"),
        F.filter(F.transform("cells", lambda c, i: F.when((i + 1 < F.col("first")) | (i + 1 > F.col("last")), c)), lambda c: c.isNotNull() & (c != "")).alias("others"),
    )
    placed = G.visual_lines(words, by=[key, "page_no"])
    in_line = Window.partitionBy(key, "page_no", "line_no").orderBy("x0", "word_no")
    whole_line = Window.partitionBy(key, "page_no", "line_no")
    runs = placed.withColumn("back", F.collect_list("word").over(in_line.rowsBetween(-(longest - 1), 0))).withColumn("there", F.collect_set("word").over(whole_line)).withColumn("end", F.row_number().over(in_line))
    runs = runs.select(key, "page_no", F.col("line_no").alias("at_line"), "there", "end", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("back")), lambda n: F.array_join(F.slice("back", -n, n), " "))).alias("n", "run"))
    runs = runs.withColumn("target", F.replace(T.squash(F.col("run")), F.lit("."), F.lit("")))
    found = runs.join(wanted, [key, "target"]).where(F.arrays_overlap("there", F.flatten(F.transform("others", lambda c: F.split(c, r"\s+")))))
    values = found.groupBy(key, "block", "line_no").agg(F.max_by("run", F.struct("end", "n", (-F.col("page_no")).alias("p"), (-F.col("at_line")).alias("l"))).alias("value"))
    verified = values.groupBy(key, "block").agg(F.count("*").alias("n_found")).join(spans, [key, "block"]).where("n_found = n_torn").select(key, "block", "first", "last")
    joined = rows.join(spans.select(key, "block"), [key, "block"]).join(verified, [key, "block"], "left").join(values, [key, "block", "line_no"], "left")
    n = F.col("last") - F.col("first") + 1
    inner = F.when(F.col("ruled"), F.lit("---")).otherwise(F.coalesce("value", F.array_join(F.filter(F.slice("cells", F.col("first"), n), lambda c: c != ""), " ")))
    merged = _row(F.concat(F.slice("cells", F.lit(1), F.col("first") - 1), F.array(inner), F.slice("cells", F.col("last") + 1, F.size("cells"))))
    repaired = F.col("first").isNotNull()
    return joined.select(key, "block", "line_no", F.when(repaired, merged).otherwise(F.col("line")).alias("line"), F.when(repaired, "repaired").otherwise("reported").alias("status"))


# --- fused headers (105) -----------------------------------------------------------------------------------------------------


def rebuild_fused(blocks: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, block, status, table): tables whose header has data in it, built again from the boxes, or reported.

    The region is the longest run of visual lines of a page whose words are the table's to 60 % and more;
    lines before the first one with a number are the header; columns are the gaps in x. It counts only if
    the words of the new table are those of the old one, each as often.
    """
    fused = blocks.where((F.col("row_no") == 1) & (F.size(F.filter(T.cells(F.col("line")), A.has_number)) >= 2)).select(key, "block")
    rows = blocks.join(fused, [key, "block"]).where(~T.is_separator(F.col("line")))
    tokens = rows.select(key, "block", F.explode(F.flatten(F.transform(T.cells(F.col("line")), lambda c: F.split(c, r"\s+")))).alias("word")).where("word <> ''")
    bag = tokens.groupBy(key, "block").agg(F.sort_array(F.collect_list("word")).alias("bag"))  # one table's words
    placed = G.visual_lines(words, by=[key, "page_no"]).select(key, "page_no", "line_no", "word_no", "x0", "x1", "word")
    known = tokens.distinct().withColumn("known", F.lit(1))
    spread = placed.join(fused, key).join(known, [key, "block", "word"], "left")
    by = [key, "block", "page_no"]
    lines = spread.groupBy(*by, "line_no").agg((F.sum(F.coalesce("known", F.lit(0))) / F.count("*")).alias("share"))
    w = Window.partitionBy(*by).orderBy("line_no")
    runs = lines.where(F.col("share") >= LINE_SHARE).withColumn("island", F.col("line_no") - F.row_number().over(w))
    runs = runs.groupBy(*by, "island").agg(F.min("line_no").alias("from_line"), F.max("line_no").alias("to_line"))
    longest = F.max_by(F.struct("page_no", "from_line", "to_line"), F.struct((F.col("to_line") - F.col("from_line")).alias("n"), (-F.col("page_no")).alias("p"), (-F.col("from_line")).alias("f")))
    region = runs.groupBy(key, "block").agg(longest.alias("r")).select(key, "block", "r.*")
    inside = spread.join(region, by).where((F.col("line_no") >= F.col("from_line")) & (F.col("line_no") <= F.col("to_line"))).drop("known", "from_line", "to_line")
    inside = cut(inside)  # columns and cells both start from it
    bounds = G.columns(inside, by=by)
    cells = inside.join(G.assign_columns(inside, bounds, by=by), [*by, "word_no"])
    cell = cells.groupBy(*by, "line_no", "column_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_no", "word"))), lambda x: x["word"]), " ").alias("cell"))
    cell = cut(cell)
    numeric = cell.where(A.has_number(F.col("cell"))).groupBy(*by).agg(F.min("line_no").alias("first_data"))
    cell = cell.join(numeric, by).withColumn("row", F.when(F.col("line_no") < F.col("first_data"), F.lit(-1).cast("long")).otherwise(F.col("line_no")))
    cell = cell.groupBy(*by, "row", "column_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "cell"))), lambda x: x["cell"]), " ").alias("cell"))
    grid = bounds.select(*by, "column_no").join(cell.select(*by, "row").distinct(), by).join(cell, [*by, "row", "column_no"], "left")
    built = grid.groupBy(*by, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("column_no", F.coalesce("cell", F.lit("")).alias("cell")))), lambda x: x["cell"]).alias("cells"))
    tables = built.groupBy(key, "block").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("rows"))  # one table's rows
    all_words = F.sort_array(F.flatten(F.transform("rows", lambda r: F.filter(F.split(F.array_join(r["cells"], " "), r"\s+"), lambda x: x != ""))))
    headed = F.get("rows", F.lit(0))["row"] == -1
    text = T.pipe_table(F.transform("rows", lambda r: r["cells"]))
    joined = fused.join(bag, [key, "block"]).join(tables, [key, "block"], "left")
    fits = F.coalesce(headed & (all_words == F.col("bag")), F.lit(False))
    return joined.select(key, "block", F.when(fits, "repaired").otherwise("reported").alias("status"), F.when(fits, text).alias("table"))


# --- tables from boxes (extraction) ------------------------------------------------------------------------------------------


def extract_tables(words: DataFrame, rules: DataFrame | None, key: str, least_score: float = 0.3, most: int = 50) -> DataFrame:
    """(key, page_no, table_no, strategy, score, table): tables of each page in two ways, ruled ones first.

    ``rules`` has (key, page_no, x0, y0, x1, y1) of drawn frames: the words in a frame are a table. On pages
    without any, words in at least two columns are one. Tables under two rows or under the score go; of
    the rest a document keeps its first ``most`` (a cap that is the feature).
    """
    page = [key, "page_no"]
    if rules is None:
        framed = words.limit(0).withColumn("frame", F.lit(0).cast("long"))
    else:
        r = rules.select(*page, F.row_number().over(Window.partitionBy(*page).orderBy("y0", "x0")).cast("long").alias("frame"), *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
        x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        framed = words.join(r, page).where((x >= F.col("rx0")) & (x <= F.col("rx1")) & (y >= F.col("ry0")) & (y <= F.col("ry1"))).drop("rx0", "ry0", "rx1", "ry1")
    ruled_pages = framed.select(*page).distinct()
    aligned = words.join(ruled_pages, page, "left_anti").withColumn("frame", F.lit(0).cast("long"))
    both = framed.withColumn("strategy", F.lit("ruled")).unionByName(aligned.withColumn("strategy", F.lit("aligned")))
    by = [*page, "frame"]
    lines = G.visual_lines(both, by=by).select(*by, "line_no", "word_no", "x0", "x1", "word", "strategy")
    bounds = G.columns(lines, by=by)
    cells = lines.join(G.assign_columns(lines, bounds, by=by), [*by, "word_no"])
    cell = cells.groupBy(*by, "strategy", "line_no", "column_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_no", "word"))), lambda c: c["word"]), " ").alias("cell"))
    grid = bounds.select(*by, "column_no").join(cell.select(*by, "strategy", "line_no").distinct(), by).join(cell, [*by, "strategy", "line_no", "column_no"], "left")
    rows = grid.groupBy(*by, "strategy", "line_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("column_no", F.coalesce("cell", F.lit("")).alias("cell")))), lambda c: c["cell"]).alias("cells"))
    tables = rows.groupBy(*by, "strategy").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "cells"))), lambda r: r["cells"]).alias("rows"))  # one frame's or page's rows
    scored = tables.withColumn("score", T.table_score(F.col("rows"))).where((F.size("rows") >= 2) & (F.size(F.get("rows", F.lit(0))) >= 2) & (F.col("score") >= least_score))
    number = F.row_number().over(Window.partitionBy(key).orderBy("page_no", "frame"))
    return scored.withColumn("table_no", number).where(F.col("table_no") <= most).select(key, "page_no", "table_no", "strategy", "score", T.pipe_table(F.col("rows")).alias("table"))
