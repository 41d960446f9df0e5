"""Relations of lines, table blocks and heading paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.session import cut


def table_blocks(lines: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, block, line_no, row_no, line): runs of at least ``least`` pipe rows; ``block`` is its first line's number."""
    pipes = lines.where(T.is_pipe_row(F.col("line")))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    runs = pipes.withColumn("island", island)
    w = Window.partitionBy(key, "island")
    runs = runs.withColumn("block", F.min("line_no").over(w)).withColumn("n", F.count("*").over(w))
    return runs.where(F.col("n") >= least).select(key, "block", "line_no", (F.col("line_no") - F.col("block") + 1).alias("row_no"), "line")


def placed_rows(lines: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, line_no, line, block, row_no): every line; rows of table blocks with their block and place in it, others with nulls."""
    w = Window.partitionBy(key).orderBy("line_no")
    pipe = T.is_pipe_row(F.col("line"))
    goes_on = F.coalesce(F.lag("pipe").over(w) & (F.lag("line_no").over(w) == F.col("line_no") - 1), F.lit(False))
    df = lines.select(key, "line_no", "line", pipe.alias("pipe")).withColumn("island", F.when(F.col("pipe") & ~goes_on, F.col("line_no")))
    df = df.withColumn("island", F.when(F.col("pipe"), F.last("island", ignorenulls=True).over(w)))
    # a block of one row is none: the row after its first one would have to be of the same island
    after = F.lead("island").over(w)
    df = df.withColumn("whole", (F.col("line_no") > F.col("island")) | (after == F.col("island"))) if least == 2 else df.withColumn("whole", F.col("pipe"))
    block = F.when(F.col("whole"), F.col("island"))
    return df.select(key, "line_no", "line", block.alias("block"), (F.col("line_no") - block + 1).alias("row_no"))


def block_around(lines: DataFrame, at: DataFrame, key: str) -> DataFrame:
    """(key, at, first, last): the run of pipe rows around each line named in ``at`` (key, at); a single row is one too."""
    rows = placed_rows(lines, key, least=1).where("block is not null")
    bounds = rows.groupBy(key, "block").agg(F.max("line_no").alias("last")).withColumnRenamed("block", "first")
    named = rows.select(key, F.col("line_no").alias("at"), F.col("block").alias("first"))
    return at.select(key, "at").join(named, [key, "at"]).join(bounds, [key, "first"]).select(key, "at", "first", "last")


def headings(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, level, title) of every heading line outside fenced code."""
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    open_fences = F.coalesce(F.sum(F.when(fence, 1).otherwise(0)).over(before), F.lit(0))
    marked = lines.withColumn("fences", open_fences).where((F.col("fences") % 2 == 0) & F.col("line").rlike(r"^#{1,6}\s+\S"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    title = T.strip(F.regexp_replace(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1), T.TAG, ""))
    return marked.select(key, "line_no", level.alias("level"), title.alias("title"))


def live_headings(marks: DataFrame, key: str) -> DataFrame:
    """Adds ``stack``: line numbers of the headings that are open at each heading, itself last."""
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == n, F.col("line_no")), ignorenulls=True).over(upto) for n in range(1, 7)]
    df = marks.select("*", *(c.alias(f"at{n}") for n, c in enumerate(last, 1)))
    live: list[Column] = []
    newest: Column = F.lit(-1).cast("long")
    for n in range(1, 7):
        at = F.col(f"at{n}")
        live.append(F.when((F.col("level") >= n) & (at > newest), at))
        newest = F.greatest(newest, F.coalesce(at, F.lit(-1)))
    return df.select(*marks.columns, F.array_compact(F.array(*live)).alias("stack"))


def heading_paths(marks: DataFrame, key: str) -> DataFrame:
    """Adds ``path``: the titles of the open headings, equal siblings told apart by #2, #3 and so on.

    Siblings are counted under their parent's path as written, so one pass for each depth over the headings, which are
    written once before.
    """
    stacked = cut(live_headings(marks, key)).withColumn("depth", F.size("stack")).withColumn("parent", F.when(F.size("stack") > 1, F.get("stack", F.size("stack") - 2)))
    done: DataFrame | None = None
    above: DataFrame | None = None
    for depth in range(1, 7):
        level = stacked.where(F.col("depth") == depth)
        if above is None:
            level = level.withColumn("parent_path", F.array().cast("array<string>"))
        else:
            level = level.join(above.select(F.col(key), F.col("line_no").alias("parent"), F.col("path").alias("parent_path")), [key, "parent"])
        again = F.row_number().over(Window.partitionBy(key, "parent_path", "title").orderBy("line_no"))
        level = level.withColumn("again", again)
        name = F.when(F.col("again") > 1, F.concat("title", F.lit("#"), F.col("again").cast("string"))).otherwise(F.col("title"))
        level = level.withColumn("path", F.concat("parent_path", F.array(name))).select(key, "line_no", "level", "title", "path")
        done = level if done is None else done.unionByName(level)
        above = level
    return done


def demote_footnotes(marks: DataFrame) -> DataFrame:
    """Headings of level four and deeper whose title is only a short number are footnote marks, not headings."""
    return marks.where(~((F.col("level") >= 4) & F.col("title").rlike(r"^\d{1,3}$")))


def table_captions(lines: DataFrame, key: str, cut: int = 200) -> DataFrame:
    """(key, block, caption): for each table of lines the last caption line of the text block before it, else the start of that block's last line.

    Lines of superscript notes are no captions; a table without text before it has none.
    """
    s = T.strip(F.col("line"))
    structural = s.rlike(r"^(?:#{1,6}\s|```|\|.*\|$|!\[[^\]]*\]\([^)]+\)$|(?i:<table))")
    w = Window.partitionBy(key).orderBy("line_no")
    placed = placed_rows(lines, key, least=1).withColumn("s", s).withColumn("is_text", (F.col("s") != "") & ~structural)
    fresh = F.when(F.col("is_text") & ~F.coalesce(F.lag("is_text").over(w), F.lit(False)), F.col("line_no"))
    placed = placed.withColumn("fresh", fresh).withColumn("run", F.last("fresh", ignorenulls=True).over(w))
    caption = F.col("s").rlike(r"(?i)^(?:Table|Figure|表|图)\s*[\d.::]+")
    told = F.col("is_text") & ~F.col("s").startswith("<sup>")
    within = Window.partitionBy(key, "run").orderBy("line_no")
    last_caption = F.last(F.when(told & caption, F.col("s")), ignorenulls=True).over(within)
    last_line = F.last(F.when(told, F.substring("s", 1, cut)), ignorenulls=True).over(within)
    placed = placed.withColumn("caption", F.when(F.col("run").isNotNull(), F.coalesce(last_caption, last_line)))
    return placed.where(F.col("line_no") == F.col("block")).select(key, "block", "caption")


def note_prefixes(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line) of the filled lines, deep headings that are only a short number made the start of the text that follows them.

    Where no text follows (a heading, a table, an image, code or the end), the number stays as a line of text.
    """
    filled = lines.select(key, "line_no", "line", T.strip(F.col("line")).alias("s")).where("s <> ''")
    w = Window.partitionBy(key).orderBy("line_no")
    note = F.regexp_extract("s", r"^#{4,6}\s+(\d{1,3})$", 1)
    text = ~F.col("s").rlike(r"^(?:#{1,6}\s|```|~~~|\|.*\|$|!\[[^\]]*\]\([^)]+\)$|(?i:<table))")
    df = filled.withColumn("note", note).withColumn("is_text", text).withColumn("goes_on", F.coalesce(F.lead("is_text").over(w), F.lit(False))).withColumn("before", F.lag("note").over(w))
    prefixed = F.concat("before", F.lit(". "), F.ltrim("line"))
    line = F.when(F.col("note") != "", F.col("note")).when((F.coalesce("before", F.lit("")) != "") & F.col("is_text"), prefixed).otherwise(F.col("line"))
    return df.where((F.col("note") == "") | ~F.col("goes_on")).select(key, "line_no", line.alias("line"))
