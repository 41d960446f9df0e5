"""Word boxes on pages: lines, columns, bands, regions. Range joins always carry document and page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc", "page_no"]


def visual_lines(words: DataFrame, tolerance: float = 3.0, by: list[str] = PAGE) -> DataFrame:
    """Adds ``line_no``: words in order of (y0, x0), a new line where y0 is farther than the tolerance from the word before."""
    w = Window.partitionBy(*by).orderBy("y0", "x0", "word_no")
    fresh = F.when(F.abs(F.col("y0") - F.lag("y0").over(w)) <= tolerance, 0).otherwise(1)
    return words.withColumn("fresh", fresh).withColumn("line_no", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def columns(words: DataFrame, gap: float = 6.0, by: list[str] = PAGE) -> DataFrame:
    """(doc, page_no, column_no, left, right) or by what ``by`` names: x intervals merged where they are no more than the gap apart."""
    w = Window.partitionBy(*by).orderBy("x0", "x1", "word_no")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = words.withColumn("fresh", F.when(F.col("x0") <= reach + gap, 0).otherwise(1))
    df = df.withColumn("column_no", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*by, "column_no").agg(F.min("x0").alias("left"), F.max("x1").alias("right"))


def assign_columns(words: DataFrame, bounds: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """(doc, page_no, word_no, column_no): the column each word overlaps most, the first of equals."""
    joined = words.select(*by, "word_no", "x0", "x1").join(bounds, by)
    overlap = F.least("x1", "right") - F.greatest("x0", "left")
    best = F.max_by("column_no", F.struct(overlap.alias("o"), (-F.col("column_no")).alias("c")))
    return joined.where(overlap > 0).groupBy(*by, "word_no").agg(best.alias("column_no"))


def densest_band(hits: DataFrame, gap: float = 24.0, least: int = 6, by: list[str] = PAGE) -> DataFrame:
    """(doc, page_no, top, bottom, n): the band with most hits, bands parted by more than the gap, the first of equals."""
    w = Window.partitionBy(*by).orderBy("y0", "y1", "word_no")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = hits.withColumn("fresh", F.when(F.col("y0") - reach <= gap, 0).otherwise(1))
    df = df.withColumn("band", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bands = df.groupBy(*by, "band").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.count("*").alias("n"))
    best = bands.groupBy(*by).agg(F.max_by(F.struct("top", "bottom", "n"), F.struct(F.col("n"), (-F.col("band")).alias("b"))).alias("x"))
    return best.select(*by, "x.top", "x.bottom", "x.n").where(F.col("n") >= least)


def in_regions(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words whose centre lies in a region of their page (a theta join within document and page)."""
    r = regions.select(*PAGE, F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = [words[c] == r[c] for c in PAGE] + [(x >= F.col("rx0")) & (x <= F.col("rx1")) & (y >= F.col("ry0")) & (y <= F.col("ry1"))]
    return words.join(r, hit, "left_semi")


def page_heights(words: DataFrame) -> DataFrame:
    return words.groupBy(*PAGE).agg((F.max("y1") + 36).alias("height"))


def _united(boxes: np.ndarray, pad: float) -> np.ndarray:
    """Boxes of one page joined until none lies within ``pad`` of another: components over a sorted sweep, repeated."""
    while len(boxes) > 1:
        n = len(boxes)
        parent = list(range(n))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        rows = boxes.tolist()
        active: list[int] = []
        for i in sorted(range(n), key=lambda k: rows[k][0]):
            x0, y0, _, y1 = rows[i]
            active = [j for j in active if rows[j][2] + pad > x0]
            for j in active:
                if rows[j][1] - pad < y1 and y0 < rows[j][3] + pad:
                    parent[root(i)] = root(j)
            active.append(i)
        roots = np.array([root(i) for i in range(n)])
        names = np.unique(roots)
        if len(names) == n:
            break
        boxes = np.array([[*boxes[roots == r, :2].min(axis=0), *boxes[roots == r, 2:].max(axis=0)] for r in names])
    return boxes


def _merge_pages(pad: float):
    """Whole pages out of sorted batches; the last page of a batch waits for the next one."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[PAGE].to_numpy(dtype=object)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        values = pdf[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
        parts = [_united(values[a:b], pad) for a, b in zip(cuts, cuts[1:])]
        out = pd.DataFrame(np.concatenate(parts), columns=["x0", "y0", "x1", "y1"])
        heads = np.repeat(np.array(cuts[:-1]), [len(p) for p in parts])
        for place, name in enumerate(PAGE):
            out.insert(place, name, pdf[name].to_numpy()[heads])
        return out

    def run(batches):
        waiting: pd.DataFrame | None = None
        for pdf in batches:
            if waiting is not None:
                pdf = pd.concat([waiting, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf[PAGE] == pdf[PAGE].iloc[-1]).all(axis=1)
            waiting = pdf[last].reset_index(drop=True)
            if not last.all():
                yield merged(pdf[~last].reset_index(drop=True))
        if waiting is not None and len(waiting):
            yield merged(waiting)

    return run


def merge_boxes(boxes: DataFrame, pad: float = 5.0) -> DataFrame:
    """(doc, page_no, x0, y0, x1, y1): near boxes united to the fixpoint; specks are skipped. Pages of any number of boxes are swept."""
    big = boxes.where((F.col("x1") - F.col("x0") >= 2) | (F.col("y1") - F.col("y0") >= 2)).select(*PAGE, "x0", "y0", "x1", "y1")
    kind, page = (big.schema[c].dataType.simpleString() for c in PAGE)
    ordered = big.repartition(*PAGE).sortWithinPartitions(*PAGE)
    return ordered.mapInPandas(_merge_pages(pad), f"doc {kind}, page_no {page}, x0 double, y0 double, x1 double, y1 double")


def figure_regions(boxes: DataFrame, area: float = 4000.0, side: float = 30.0) -> DataFrame:
    merged = merge_boxes(boxes)
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return merged.where((width * height >= area) & (width >= side) & (height >= side))
