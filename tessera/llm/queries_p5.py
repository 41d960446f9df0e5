"""Problem 5: one consistent form of chunk contents and package titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.unicode import nfc
from tessera.llm.lookalikes import canonical
from tessera.session import read


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "chunks").where("chunk_type = 'text'")
    packages = read(spark, sf_dir, "package_metadata")
    return chunks.select(F.col("chunk_id").alias("record_id"), F.lit("content").alias("field_name"), F.col("content").alias("text")).unionByName(
        packages.select(F.col("doc_id").alias("record_id"), F.lit("title").alias("field_name"), F.col("title").alias("text"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(_texts(spark, sf_dir)).where(F.size("findings") > 0).select("record_id", "field_name").distinct()


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = canonical(_texts(spark, sf_dir))
    return forms.groupBy("record_id", "field_name", "canonical").agg(F.max("findings").alias("findings"))


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each field: its texts, and how many canonical ones still are uncomposed, wide, invisible in part or oddly spaced."""
    forms = p5_canonical(spark, sf_dir).withColumn("c", F.col("canonical"))
    joiner = F.regexp_replace("c", r"(?<=[\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsArabic}])[\x{200C}\x{200D}]|\x{200D}(?=\p{So})", "")
    return forms.groupBy("field_name").agg(
        F.count_distinct("record_id").alias("n_records"), F.count_if(nfc(F.col("c")) != F.col("c")).alias("n_uncomposed"), F.count_if(F.col("c").rlike("[０-９Ａ-Ｚａ-ｚ]")).alias("n_wide"),
        F.count_if(joiner.rlike(r"\p{Cf}")).alias("n_invisible"), F.count_if(F.col("c").rlike(r"[\p{Zs}&&[^ ]]")).alias("n_spaced"),
    )


QUERIES = {"p5_found": p5_found, "p5_canonical": p5_canonical, "p5_check": p5_check}

SQL = {
    "p5_check": """
select field_name, count(distinct record_id) as n_records, 0::bigint as n_uncomposed, 0::bigint as n_wide, 0::bigint as n_invisible, 0::bigint as n_spaced from (
    select chunk_id as record_id, 'content' as field_name from chunks where chunk_type = 'text' and content is not null union all select doc_id, 'title' from package_metadata where title is not null) group by 1""",
    "p5_found": r"""
with t as (
    select chunk_id as record_id, 'content' as field_name, content as text from chunks where chunk_type = 'text' and content is not null
    union all select doc_id, 'title', title from package_metadata where title is not null)
select distinct record_id, field_name from t
where nfc_normalize(text) <> text or regexp_matches(text, '[０-９Ａ-Ｚａ-ｚ]') or regexp_matches(text, '\p{Cf}')
   or regexp_matches(text, '[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]')
   or len(list_filter(regexp_extract_all(regexp_replace(text, '\p{Cf}', '', 'g'), '\p{L}+'), lambda w:
        regexp_matches(w, '\p{Latin}') and regexp_matches(w, '[\p{Greek}\p{Cyrillic}]')
        and not regexp_matches(regexp_replace(w, '[АВЕКМНОРСТУХаеорсухкѕіјһԁԛԝІЈЅҮԌΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικγτχω]', '', 'g'), '[^\p{Latin}]'))) > 0"""
}
