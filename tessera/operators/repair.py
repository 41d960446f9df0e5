"""Repairs that are made only when a check confirms them; otherwise the place is reported."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import textops as T


# --- numeric gate ------------------------------------------------------------------------------------------------------


def numeric_gate(html: Column, region: Column, block: Column, context: Column) -> tuple[Column, Column]:
    """(status, disputed): pass, fail or verify for a rewritten table against what is known of its numbers.

    Lost numbers fail first; a fragment found in a number without its points is not lost. Numbers
    that nothing knows fail only where the text layer is sound enough to judge.
    """
    new = F.array_distinct(T.numeric_tokens(F.regexp_replace(html, T.TAG, " ")))
    layer, old, around = (F.array_distinct(T.numeric_tokens(x)) for x in (region, block, context))
    bare = F.transform(new, lambda n: F.replace(n, F.lit("."), F.lit("")))
    lost = F.filter(F.array_except(old, new), lambda n: ~F.exists(bare, lambda b: b.contains(n)))
    known = F.array_union(old, around)
    invented = F.array_sort(F.array_except(new, F.array_union(layer, known)))
    cover = F.size(F.array_intersect(layer, known)) / F.greatest(F.lit(1), F.size(known))
    weak = (F.size(known) < 4) | (cover < 0.5)
    status = F.when(F.size(lost) > 0, "fail").when(F.size(invented) == 0, "pass").when(weak, "verify").otherwise("fail")
    return status, F.when(F.size(lost) > 0, F.array().cast("array<string>")).otherwise(invented)


# --- torn numbers ------------------------------------------------------------------------------------------------------


def recover_values(words: DataFrame, targets: DataFrame, key: list[str], longest: int = 6) -> DataFrame:
    """(key, value): the run of words whose squashed form without points is the target, rightmost end first, then longest.

    ``words`` has key, word_no and word; ``targets`` has key and target. Runs meet inside their line only.
    """
    w = Window.partitionBy(*key).orderBy("word_no")
    runs = words.withColumn("back", F.collect_list("word").over(w.rowsBetween(-(longest - 1), 0)))
    runs = runs.select(*key, "word_no", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("back")), lambda n: F.array_join(F.slice("back", -n, n), " "))).alias("k", "run"))
    joined = runs.join(targets, key).where(F.replace(T.squash(F.col("run")), F.lit("."), F.lit("")) == F.col("target"))
    best = F.max_by("run", F.struct("word_no", "k"))
    return joined.groupBy(*key).agg(best.alias("value"))


# --- tables from geometry ------------------------------------------------------------------------------------------------


def rebuild_rows(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, line_no, cells): words with line_no and column_no as rows of cells in order."""
    cell = words.groupBy(*key, "line_no", "column_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_no", "word"))), lambda x: x["word"]), " ").alias("cell"))
    return cell.groupBy(*key, "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column_no", "cell"))), lambda x: x["cell"]), " | ").alias("cells"))


def longest_run(lines: DataFrame, key: list[str], flag: str) -> DataFrame:
    """(key, first, last): the longest run of flagged lines, the first of equals."""
    marked = lines.where(F.col(flag)).withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy(*key).orderBy("line_no")))
    runs = marked.groupBy(*key, "island").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    best = F.max_by(F.struct("first", "last"), F.struct((F.col("last") - F.col("first")).alias("n"), (-F.col("first")).alias("early")))
    return runs.groupBy(*key).agg(best.alias("r")).select(*key, "r.first", "r.last")


def merge_split_tables(blocks: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Lines of table blocks without the second header of a table that a page break split.

    ``pairs`` (key, block) names the second parts. The first row goes only if it repeats the first
    part's header or a separator follows it; a continuation without header loses no data row.
    """
    header = blocks.where("row_no = 1").select(key, "block", T.strip(F.col("line")).alias("header"))
    w = Window.partitionBy(key).orderBy("block")
    header = header.withColumn("before", F.lag("header").over(w))
    rule = blocks.where("row_no = 2").select(key, "block", T.is_separator(F.col("line")).alias("ruled"))
    second = pairs.join(header, [key, "block"]).join(rule, [key, "block"], "left").withColumn("drop", (F.col("header") == F.col("before")) | F.coalesce("ruled", F.lit(False)))
    df = blocks.join(second.select(key, "block", "drop"), [key, "block"], "left")
    gone = F.coalesce("drop", F.lit(False)) & ((F.col("row_no") == 1) | ((F.col("row_no") == 2) & T.is_separator(F.col("line"))))
    return df.where(~gone).select(key, "block", "line_no", "row_no", "line")


# --- missing runs --------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z][A-Za-z\-']{3,}")
MOST_RUNS, LONGEST_RUN, MOST_SHARE = 10, 12, 0.05


def missing_runs(words: list[str], text: str, capped: bool = True) -> list[tuple[int, int]]:
    """(start, end) of runs of layer words that hold a missing token, widened over words that are missing too.

    Those that a repair may take on: none if more than 5 % of the layer is missing, else at most ten, of at most twelve words.
    """
    layer = Counter(t.lower() for w in words for t in _TOKEN.findall(w))
    have = Counter(t.lower() for t in _TOKEN.findall(text))
    gap = layer - have
    if not gap or (capped and sum(gap.values()) > MOST_SHARE * max(1, sum(layer.values()))):
        return []
    lacks = []
    left = Counter(gap)
    for w in words:
        tokens = [t.lower() for t in _TOKEN.findall(w)]
        missing = any(left[t] > 0 for t in tokens)
        left.subtract(t for t in tokens if left[t] > 0)
        lacks.append(missing)
    runs: list[tuple[int, int]] = []
    for k, missing in enumerate(lacks):
        if missing and runs and runs[-1][1] == k:
            runs[-1] = (runs[-1][0], k + 1)
        elif missing:
            runs.append((k, k + 1))
    return [r for r in runs if r[1] - r[0] <= LONGEST_RUN][:MOST_RUNS] if capped else runs


def inject_missing(words: list[str], text: str) -> tuple[str, int]:
    """The text with missing runs put beside their neighbours; unchanged if the result had more of any token than the layer."""
    done, n = text, 0
    for start, end in reversed(missing_runs(words, text)):
        run = " ".join(words[start:end])
        for neighbours, after in ((words[end : end + 2], False), (words[max(0, start - 2) : start], True)):
            if len(neighbours) < 2:
                continue
            spot = re.search(r"\W*".join(map(re.escape, neighbours)), done, re.I)
            if spot:
                at = spot.end() if after else spot.start()
                done = done[:at] + (" " + run if after else run + " ") + done[at:]
                n += 1
                break
    layer = Counter(t.lower() for w in words for t in _TOKEN.findall(w))
    now = Counter(t.lower() for t in _TOKEN.findall(done))
    before = Counter(t.lower() for t in _TOKEN.findall(text))
    if any(c > layer[t] and c > before[t] for t, c in now.items()):
        return text, 0
    return done, n


def repair_losses(texts: DataFrame, layer: DataFrame, key: str) -> DataFrame:
    """(key, text, n_runs, n_reported): ``texts`` (key, text) completed from ``layer`` (key, words in order).

    What is missing and was not put back, because there is too much of it or no place for it, is reported by its number of runs.
    """
    joined = texts.select(key, "text").join(layer.select(key, "words"), key)
    kind = joined.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for text, words in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist()):
                whole, n = inject_missing(words or [], text or "")
                done.append((whole, n, len(missing_runs(words or [], whole, capped=False))))
            columns = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "text", "n_runs", "n_reported"])

    return joined.select(key, "text", "words").mapInArrow(run, f"{key} {kind}, text string, n_runs int, n_reported int")
