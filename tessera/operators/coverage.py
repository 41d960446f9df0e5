"""Token coverage of a text against an independent text layer, in bags of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import textops as T


def dehyphenate(words: DataFrame, page: list[str]) -> DataFrame:
    """Merge a word that ends in a hyphen with the next one of its page, which is then consumed.

    In a run of such words every odd one merges. ``words`` has the columns of ``page``, word_no and word.
    """
    w = Window.partitionBy(*page).orderBy("word_no")
    hyphen = F.col("word").rlike(r"^.+-$") & (F.length("word") > 1) & F.lead("word").over(w).isNotNull()
    df = words.withColumn("hyphen", hyphen).withColumn("after", F.lead("word").over(w))
    island = F.sum(F.when(F.col("hyphen"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("island", F.when(F.col("hyphen"), island))
    nth = F.row_number().over(Window.partitionBy(*page, "island", "hyphen").orderBy("word_no"))
    df = df.withColumn("merges", F.col("hyphen") & (nth % 2 == 1))
    df = df.withColumn("consumed", F.coalesce(F.lag("merges").over(w), F.lit(False)))
    joined = F.when(F.col("merges"), F.concat(F.regexp_replace("word", "-$", ""), F.col("after"))).otherwise(F.col("word"))
    return df.where(~F.col("consumed")).select(*page, "word_no", joined.alias("word"))


def bag(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, n)."""
    return texts.select(key, F.explode(T.word_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def subtract(bag_a: DataFrame, bag_b: DataFrame, key: str) -> DataFrame:
    """Bag difference, only what is left over."""
    b = bag_b.select(key, "token", F.col("n").alias("m"))
    left = bag_a.join(b, [key, "token"], "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0)))
    return left.where("n > 0").select(key, "token", "n")


def furniture(lines: DataFrame, key: str) -> DataFrame:
    """Lines of 5 to 119 signs on at least max(3, 30 %) of a document's pages; ``lines`` has key, page_no, line."""
    pages = lines.groupBy(key).agg(F.greatest(F.lit(3), F.floor(F.count_distinct("page_no") * 0.3)).alias("least"))
    usual = lines.where(F.length("line").between(5, 119)).groupBy(key, "line").agg(F.count_distinct("page_no").alias("n_pages"))
    return usual.join(pages, key).where(F.col("n_pages") >= F.col("least")).select(key, "line")


def deficit(layer: DataFrame, text: DataFrame, key: str, examples: int = 20) -> DataFrame:
    """(key, missing, total, severity, examples): what the layer's bag has more than the text's."""
    t = text.select(key, "token", F.col("n").alias("m"))
    joined = layer.join(t, [key, "token"], "left").withColumn("gap", F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0)))
    top = F.slice(F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.struct((-F.col("gap")).alias("g"), F.col("token"))))), 1, examples)
    df = joined.groupBy(key).agg(F.sum("gap").alias("missing"), F.sum("n").alias("total"), F.array_join(F.transform(top, lambda x: x["token"]), ",").alias("examples"))
    share = F.col("missing") / F.col("total")
    severity = F.when(share > 0.05, "critical").when(share > 0.01, "warn").otherwise("info")
    return df.where("missing > 0").select(key, "missing", "total", severity.alias("severity"), "examples")


def same_bag(bag_a: DataFrame, bag_b: DataFrame, key: str) -> DataFrame:
    """(key, same): whether both bags are equal."""
    a, b = bag_a.select(key, "token", F.col("n").alias("a")), bag_b.select(key, "token", F.col("n").alias("b"))
    return a.join(b, [key, "token"], "full").groupBy(key).agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


#: Pages of a document that are looked at together: a token's pages are the bits of one number.
PAGES_AT_ONCE = 8192


def most_common_bit(numbers: list[int]) -> tuple[int, int]:
    """How many of the numbers have the bit that most of them have, and which bit that is, the lowest of equals."""
    every = numbers[0]
    for x in numbers:
        every &= x
    if every:
        return len(numbers), (every & -every).bit_length() - 1
    places: list[int] = []  # of every bit a count of its own, binary: place k holds the digits of 2^k
    for carry in numbers:
        for k, digits in enumerate(places):
            places[k], carry = digits ^ carry, digits & carry
            if not carry:
                break
        else:
            places.append(carry)
    most, left = 0, -1
    for k in reversed(range(len(places))):
        if places[k] & left:
            most, left = most | 1 << k, places[k] & left
    return most, (left & -left).bit_length() - 1


def pages_of_probes(rows: list[tuple[int | None, list[str], bool]], at_once: int = PAGES_AT_ONCE) -> Iterator[tuple[int, int, int]]:
    """(row, page_no, hits) of the rows (page_no, tokens, asks) of one document that ask and share a token with a page."""
    pages = sorted({page for page, _, _ in rows if page is not None})
    best: dict[int, tuple[int, int]] = {}
    for at in range(0, len(pages), at_once):
        bit = {page: 1 << i for i, page in enumerate(pages[at : at + at_once])}
        on: dict[str, int] = {}
        for page, tokens, _ in rows:
            if page in bit:
                for token in tokens:
                    on[token] = on.get(token, 0) | bit[page]
        for row, (_, tokens, asks) in enumerate(rows):
            if asks and (found := [on[token] for token in tokens if token in on]):
                hits, i = most_common_bit(found)
                if row not in best or hits > best[row][1]:
                    best[row] = (pages[at + i], hits)
    return ((row, page, hits) for row, (page, hits) in best.items())


def best_page(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, page_no, hits): the page that shares most distinct tokens with a line that asks, the earliest of equals.

    ``lines`` has key, page_no, tokens and asks. The first column of key is the document; all its lines with a page_no
    make its pages, also those that ask. Lines of a document meet in one task, in one pass over sorted rows.
    """
    doc = key[0]
    tokens = F.array_distinct(F.array_compact("tokens")).alias("tokens")
    rows = lines.where(F.col(doc).isNotNull()).select(*key, "page_no", tokens, "asks")
    names = [*key, "page_no", "hits"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[tuple, tuple]] = []  # the last document's rows, which may go on in the next batch

        def answers() -> list[tuple]:
            return [(*waiting[row][0], page_no, hits) for row, page_no, hits in pages_of_probes([x for _, x in waiting])]

        for batch in batches:
            kinds = [*batch.schema.types[: len(key) + 1], pa.int64()]
            words = batch.column("tokens").flatten().dictionary_encode()
            distinct = words.dictionary.to_pylist()
            all_tokens = [distinct[i] for i in words.indices.to_pylist()]
            ends = np.cumsum(batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            ids, page_nos, asks = zip(*(batch.column(c).to_pylist() for c in key)), batch.column("page_no").to_pylist(), batch.column("asks").to_pylist()
            found: list[tuple] = []
            for of, page_no, start, end, asking in zip(ids, page_nos, [0, *ends], ends, asks):
                if waiting and waiting[0][0][0] != of[0]:
                    found += answers()
                    waiting.clear()
                waiting.append((of, (page_no, all_tokens[start:end], asking)))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kind) for c, kind in enumerate(kinds)], names=names)
        if waiting:
            found = answers()
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kind) for c, kind in enumerate(kinds)], names=names)

    return rows.repartition(doc).sortWithinPartitions(doc).mapInArrow(run, f"{schema}, hits long")
