"""Sources and sinks: files of a folder, JSON lines of chunks, metadata of packages, tables as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, seq int, heading_path array<string>, page int, chunk_type string, content string, "
    "embed_text string, token_est int, extra struct<anchor: string, micro: boolean, table_part: int, table_parts: int>"
)
METADATA_SCHEMA = "schema_version string, doc_id string, title string, slug string, source string, pages int, content_hash string"


def scan_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(doc_id, path, length) of all files below a folder with the suffix in any case; the id comes from the bytes, hidden twins (._name) are left out.

    A folder that isn't there is an error.
    """
    pattern = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith("._")).select(F.substring(F.sha2("content", 256), 1, 16).alias("doc_id"), "path", "length")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not known yet, each content once (its first path)."""
    first = files.groupBy("doc_id").agg(F.min("path").alias("path"))
    return first.join(known.select("doc_id").distinct(), "doc_id", "left_anti")


def chunk_json(extra_is_empty: Column | None = None) -> Column:
    """One chunk as a JSON line: null pages are written, an empty ``extra`` is not."""
    fields = ["chunk_id", "doc_id", "seq", "heading_path", "page", "chunk_type", "content", "embed_text", "token_est"]
    keep = {"ignoreNullFields": "false"}
    empty = extra_is_empty if extra_is_empty is not None else F.col("extra").isNull()
    with_extra = F.to_json(F.struct(*fields, F.from_json(F.to_json("extra"), "map<string,string>").alias("extra")), keep)
    return F.when(empty, F.to_json(F.struct(*fields), keep)).otherwise(with_extra)


def write_chunks(chunks: DataFrame, folder: str) -> None:
    chunks.select(chunk_json().alias("value")).write.mode("overwrite").text(folder)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks from JSON lines with the fixed schema; blank lines are skipped."""
    return spark.read.schema(CHUNK_SCHEMA).json(folder)


def read_metadata(spark: SparkSession, glob: str) -> DataFrame:
    """Metadata of packages; files that can't be read give no row."""
    return spark.read.schema(METADATA_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(glob)


def csv_line(cells: Column) -> Column:
    """One CSV record, cells quoted where they must be."""

    def quote(c: Column) -> Column:
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.array_join(F.transform(cells, quote), ",")
