"""A model that reads images, plugged in: tables read again from their region, figures described.

The model is a callable (prompt, image bytes) -> text; none is part of this package. What it says of a
table counts only if the numbers agree with what is known of them; a failing model says nothing and
everything stays as it is.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.operators.repair import numeric_gate

Model = Callable[[str, bytes], str]

# Calls, disputed numbers of a second round, figures of a document, shortest description.
ATTEMPTS, PAUSE, SLOT = 2, 2.0, 0.5
MOST_DISPUTED, MOST_FIGURES, LEAST_DESCRIPTION = 12, 20, 20
TABLE_PROMPT = "Write the table of this image as HTML, its numbers exactly as printed."
VERIFY_PROMPT = "Which of these numbers are printed in the image? Answer with those alone: "


class Pacer:
    """Calls of one process at least ``slot`` seconds apart."""

    def __init__(self, slot: float = SLOT, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.slot, self.clock, self.sleep = slot, clock, sleep
        self.lock = threading.Lock()
        self.free_at = 0.0

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.free_at)
            self.free_at = at + self.slot
        if at > now:
            self.sleep(at - now)


def ask(model: Model, prompt: str, image: bytes, pacer: Pacer | None = None, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> str:
    """The model's answer; after a failure again, ever later; nothing after the last one."""
    for k in range(attempts):
        if pacer is not None:
            pacer.wait()
        try:
            return model(prompt, image) or ""
        except Exception:
            if k + 1 < attempts:
                sleep(PAUSE * 2**k)
    return ""


def read_tables(tables: DataFrame, model: Model | None, key: list[str]) -> DataFrame:
    """(key, status, html): what became of each table (key, text, region, context, image) that a model read again.

    The numeric gate decides: pass replaces the table; fail keeps it; verify asks a second time, about at
    most 12 disputed numbers, and replaces it if the model names all of them. Without a model every table is kept.
    """
    if model is None:
        return tables.select(*key, F.lit("kept").alias("status"), F.lit(None).cast("string").alias("html"))
    names = [*key, "text", "region", "context", "image"]
    source = tables.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pacer = Pacer()
        for b in batches:
            said = [ask(model, TABLE_PROMPT, image or b"", pacer) for image in b.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*names, "reply"])

    replies = source.mapInArrow(read, f"{schema}, reply string").withColumn("html", T.strip_reply(F.col("reply")))
    status, disputed = numeric_gate(F.col("html"), F.col("region"), F.col("text"), F.col("context"))
    judged = replies.withColumn("status", F.when(~F.lower("html").contains("<table"), "fail").otherwise(status)).withColumn("disputed", F.slice(disputed, 1, MOST_DISPUTED))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pacer = Pacer()
        for b in batches:
            out = []
            for state, numbers, image in zip(*(b.column(c).to_pylist() for c in ("status", "disputed", "image"))):
                if state == "verify":
                    said = set(re.findall(r"\d+(?:\.\d+)?", ask(model, VERIFY_PROMPT + ", ".join(numbers), image or b"", pacer)))
                    state = "pass" if set(numbers) <= said else "fail"
                out.append("replaced" if state == "pass" else "kept")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), pa.array(out, pa.string()), b.column("html")], names=[*key, "status", "html"])

    keys = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in key)
    done = judged.select(*key, "status", "disputed", "image", "html").mapInArrow(verify, f"{keys}, status string, html string")
    return done.withColumn("html", F.when(F.col("status") == "replaced", F.col("html")))


def describe_figures(lines: DataFrame, descriptions: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line): lines with a description behind each bare image that has none.

    ``descriptions`` has key, ref and text. Texts of up to 20 signs are none; a document's first 20 images
    get one (a cap that is the feature). A described image keeps its description.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    ref = F.regexp_extract(T.strip(F.col("line")), r"^!\[[^\]]*\]\(([^)]+)\)$", 1)
    marked = lines.select(key, "line_no", "line", ref.alias("ref"), F.coalesce(T.strip(F.lead("line").over(w)).rlike(r"^>\s*\*\*Figure"), F.lit(False)).alias("described"))
    bare = marked.where("ref <> '' and not described").withColumn("place", F.row_number().over(w)).where(F.col("place") <= MOST_FIGURES)
    told = descriptions.where(F.length(T.strip(F.col("text"))) > LEAST_DESCRIPTION).groupBy(key, "ref").agg(F.min("text").alias("told"))
    named = bare.join(told, [key, "ref"]).select(key, "line_no", F.concat(F.lit("\n> **Figure:** "), T.strip(F.col("told"))).alias("added"))
    joined = lines.join(named, [key, "line_no"], "left")
    return joined.select(key, "line_no", F.concat("line", F.coalesce("added", F.lit(""))).alias("line"))


def arbitrate(lines: DataFrame, tables: DataFrame, images: DataFrame, key: str, model: Model | None, figures: bool = True) -> DataFrame:
    """Lines with the tables (key, block, text, region, context, image) that a model read again, then with described figures.

    ``images`` has key, ref and image. Without a model nothing changes; ``figures`` off leaves figures alone.
    """
    if model is None:
        return lines
    read = read_tables(tables, model, [key, "block"]).where("status = 'replaced'").select(key, "block", "html")
    sizes = tables.select(key, "block", F.size(T.split_lines(F.col("text"))).alias("n"))
    gone = read.join(sizes, [key, "block"])
    at = [lines[key] == gone[key], (F.col("line_no") >= F.col("block")) & (F.col("line_no") < F.col("block") + F.col("n"))]
    joined = lines.join(gone, at, "left").select(lines[key], "line_no", "line", "block", "html")
    lines = joined.where(F.col("html").isNull() | (F.col("line_no") == F.col("block"))).select(key, "line_no", F.coalesce("html", "line").alias("line"))
    if not figures:
        return lines

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pacer = Pacer()
        for b in batches:
            said = [ask(model, "Describe this figure in two sentences.", image or b"", pacer) for image in b.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("ref"), pa.array(said, pa.string())], names=[key, "ref", "text"])

    kind = images.schema[key].dataType.simpleString()
    told = images.select(key, "ref", "image").mapInArrow(describe, f"`{key}` {kind}, ref string, text string")
    return describe_figures(lines, told.withColumn("text", T.strip_reply(F.col("text"))), key)
