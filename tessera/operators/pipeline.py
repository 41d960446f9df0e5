"""The whole way of a document as one chain of tables: clean, audit, repair, audit again, gate, chunk, pack.

Every stage takes and gives DataFrames keyed by doc_id; a document that fails at a stage keeps its row
with what became of it. Nothing here runs on the driver but the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.operators import audit as A
from tessera.operators import blocks as B
from tessera.operators import chunking as C
from tessera.operators import regions as X
from tessera.operators import repair as P
from tessera.session import cut

KEY = "doc_id"


@dataclass
class Result:
    """``status`` has a row for each document; ``texts`` (doc_id, text) and ``chunks`` those that passed the gate or were warned."""

    status: DataFrame
    texts: DataFrame
    chunks: DataFrame


def lines_of(texts: DataFrame) -> DataFrame:
    exploded = texts.select(KEY, F.posexplode(T.split_lines(F.col("text"))).alias("pos", "line"))
    return exploded.select(KEY, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def text_of(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) as texts again; a document is one row."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(KEY).agg(whole.alias("text"))


def clean(texts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): control characters, empty spans and escaped brackets mended, references to moved images rewritten."""
    texts = texts.select(KEY, A.sanitize(F.col("text")).alias("text"))
    if files is None:
        return texts
    moved = A.image_links(lines_of(texts), files, KEY).where("state = 'rewritten'")
    pairs = moved.groupBy(KEY).agg(F.sort_array(F.collect_set("ref")).alias("refs"))  # one document's references
    joined = texts.join(pairs, KEY, "left")
    pair = lambda text, ref: F.replace(text, F.concat(F.lit("]("), ref, F.lit(")")), F.concat(F.lit("](images/"), F.regexp_extract(ref, r"([^/]+)$", 1), F.lit(")")))
    return joined.select(KEY, F.coalesce(F.aggregate("refs", F.col("text"), pair), F.col("text")).alias("text"))


def audit(texts: DataFrame) -> DataFrame:
    """(doc_id, critical, warn, info): how many issues of each severity every document has."""
    counts = A.severity_counts(A.all_rules(lines_of(texts), KEY), KEY)
    return texts.select(KEY).join(counts, KEY, "left").fillna(0, ["critical", "warn", "info"])


def repair(texts: DataFrame, words: DataFrame | None, layer: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(texts, actions): torn columns and fused headers from the boxes, then lost runs from the layer; actions has (doc_id, rule, status).

    Without boxes or layer (a source that can't be read) the texts stay as they are.
    """
    actions = texts.select(KEY, F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("status")).limit(0)
    if words is not None:
        lines = lines_of(texts)
        blocks = B.table_blocks(lines, KEY)
        torn = cut(X.merge_torn_columns(blocks, words, KEY))
        lines = lines.join(torn.where("status = 'repaired'").select(KEY, "line_no", F.col("line").alias("whole")), [KEY, "line_no"], "left")
        lines = cut(lines.select(KEY, "line_no", F.coalesce("whole", "line").alias("line")))
        blocks = B.table_blocks(lines, KEY)
        fused = cut(X.rebuild_fused(blocks, words, KEY))
        built = fused.where("status = 'repaired'").select(KEY, "block", "table")
        placed = lines.join(blocks.select(KEY, "line_no", "block"), [KEY, "line_no"], "left").join(built, [KEY, "block"], "left")
        kept = placed.where(F.col("table").isNull() | (F.col("line_no") == F.col("block")))
        texts = text_of(kept.select(KEY, "line_no", F.coalesce("table", "line").alias("line")))
        actions = torn.select(KEY, F.lit("104").alias("rule"), "status", "block").distinct().drop("block").unionByName(fused.select(KEY, F.lit("105").alias("rule"), "status"))
    if layer is not None:
        whole = cut(P.repair_losses(texts, layer, KEY))
        texts = texts.join(whole.select(KEY, F.col("text").alias("completed")), KEY, "left").select(KEY, F.coalesce("completed", "text").alias("text"))
        for counted, status in (("n_runs", "repaired"), ("n_reported", "reported")):
            actions = actions.unionByName(whole.where(F.col(counted) > 0).select(KEY, F.lit("201").alias("rule"), F.lit(status).alias("status")))
    return texts, actions


def gate(texts: DataFrame, documents: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, verdict, failed, warned); ``documents`` has page_count, expected_tables and n_degraded."""
    n_tables = B.table_blocks(lines_of(texts), KEY).groupBy(KEY).agg(F.count_distinct("block").alias("n_tables"))
    rows = texts.join(documents.select(KEY, "page_count", "expected_tables", "n_degraded"), KEY, "left").join(n_tables, KEY, "left").join(counts.select(KEY, "critical"), KEY, "left")
    scores = {
        "text": A.completeness(F.col("text"), F.col("page_count")),
        "headings": A.heading_structure(F.col("text")),
        "formulas": A.formula_integrity(F.col("text")),
        "tables": A.table_coverage(F.coalesce("n_tables", F.lit(0)), F.col("expected_tables")),
    }
    concern = (F.coalesce("critical", F.lit(0)) > 0) | (F.coalesce("n_degraded", F.lit(0)) > 0)
    verdict, failed, warned = A.gate(scores, concern, F.col("text"))
    return rows.select(KEY, verdict.alias("verdict"), failed.alias("failed"), warned.alias("warned"))


def run(documents: DataFrame, words: DataFrame | None = None, layer: DataFrame | None = None, files: DataFrame | None = None, pages: DataFrame | None = None) -> Result:
    """All stages over ``documents`` (doc_id, text, page_count, expected_tables, n_degraded, status, error).

    A document whose extraction failed (status missing, or a null text) is reported and goes no further;
    one that halts at the gate is not chunked.
    """
    known = documents.where("doc_id is not null")
    readable = known.where("text is not null and coalesce(status, 'ok') <> 'missing'")
    texts = cut(clean(readable, files))
    before = audit(texts)
    texts, actions = repair(texts, words, layer)
    texts = cut(texts)
    after = audit(texts)
    verdicts = cut(gate(texts, readable, after))
    passed = texts.join(verdicts.where("verdict <> 'HALT'").select(KEY), KEY, "left_semi")
    chunks = C.chunk_documents(passed, pages)
    done = actions.groupBy(KEY).agg(F.count_if(F.col("status") == "repaired").alias("n_repaired"), F.count_if(F.col("status") == "reported").alias("n_reported"))
    n_chunks = chunks.groupBy(KEY).agg(F.count("*").alias("n_chunks"))
    counted = before.select(KEY, F.col("critical").alias("critical_before")).join(after.select(KEY, F.col("critical").alias("critical_after")), KEY).join(verdicts, KEY)
    status = known.select(KEY, "error").join(counted, KEY, "left").join(done, KEY, "left").join(n_chunks, KEY, "left")
    status = status.fillna(0, ["n_repaired", "n_reported", "n_chunks"]).withColumn("verdict", F.coalesce("verdict", F.lit("FAILED")))
    return Result(status, passed, chunks)
