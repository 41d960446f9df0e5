"""Problem 8: sentence units of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.textops import strip
from tessera.llm.sentences import sentence_ends
from tessera.session import read


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_ends(read(spark, sf_dir, "documents")).distinct()


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the last unit of each document ends, and how many units are blank, repeated or end in white space."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    ends = p8_found(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list("sent_end")).alias("ends"))  # one document's ends
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("ends"))
    unit = lambda end, start: F.substr("text", (start + 1).cast("int"), (end - start).cast("int"))
    units = docs.join(ends, "doc_id").select("doc_id", "ends", F.zip_with("ends", F.slice(starts, F.lit(1), F.size("ends")), unit).alias("units"))
    return units.select(
        "doc_id", F.array_max("ends").alias("last_end"), F.size(F.filter("units", lambda u: F.length(strip(u)) == 0)).cast("long").alias("n_blank"), F.size(F.filter("units", lambda u: u.rlike(r"\s$"))).cast("long").alias("n_loose")
    )


QUERIES = {"p8_found": p8_found, "p8_check": p8_check}

SQL = {
    "p8_check": r"""
select doc_id, length(regexp_replace(text, '[\s\x0b\x{85}\x1c-\x1f\p{Z}]+$', '')) as last_end, 0::bigint as n_blank, 0::bigint as n_loose from documents where regexp_matches(text, '[^\s\x0b\x{85}\x1c-\x1f\p{Z}]')"""
}
