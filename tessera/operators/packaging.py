"""Packages of documents: front matter, manifests, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quoted(value: Column) -> Column:
    """A YAML scalar in double quotes."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def front_matter(title: Column, doc_id: Column, source: Column, pages: Column, verdict: Column, converted: Column, generator: Column) -> Column:
    """Front matter block; it is put before the body last, so hashes cover the body only."""
    lines = [
        F.lit("---"),
        F.concat(F.lit("title: "), quoted(title)),
        F.concat(F.lit("doc_id: "), quoted(doc_id)),
        F.concat(F.lit("source: "), quoted(source)),
        F.concat(F.lit("pages: "), F.coalesce(pages.cast("string"), F.lit("0"))),
        F.concat(F.lit("qc_verdict: "), quoted(verdict)),
        F.concat(F.lit("converted: "), quoted(converted)),
        F.concat(F.lit("generator: "), quoted(generator)),
        F.lit("---"),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))


def readme(title: Column, slug: Column, n_chunks: Column, n_tables: Column) -> Column:
    """A package's map; the row of tables is left out where there are none."""
    rows = [
        F.concat(F.lit("# "), title),
        F.lit("| path | content |\n|---|---|"),
        F.concat(F.lit("| "), slug, F.lit(".md | text |")),
        F.concat(F.lit("| data/chunks.jsonl | "), n_chunks.cast("string"), F.lit(" chunks |")),
        F.when(n_tables > 0, F.concat(F.lit("| tables/ | "), n_tables.cast("string"), F.lit(" tables |"))),
    ]
    return F.concat_ws("\n", *rows)


def unique_slugs(titles: DataFrame) -> DataFrame:
    """(doc_id, slug): the earliest document (by id) of a slug keeps it, others get the start of their id behind it."""
    first = titles.groupBy("slug").agg(F.min("doc_id").alias("owner"))
    joined = titles.join(first, "slug")
    return joined.select("doc_id", F.when(F.col("doc_id") == F.col("owner"), F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.substring("doc_id", 1, 8))).alias("slug"))


def export_actions(packages: DataFrame, vault: DataFrame, overwrite: bool = False) -> DataFrame:
    """(slug, action): copy, skip, conflict or keep, from the hashes of both sides.

    A copy whose hash can't be read (null) conflicts unless ``overwrite``; what only the vault has is kept.
    """
    joined = packages.select("slug", F.col("hash").alias("p"), F.lit(True).alias("packed")).join(vault.select("slug", F.col("hash").alias("v"), F.lit(True).alias("there")), "slug", "full")
    action = (
        F.when(F.col("packed").isNull(), "keep")
        .when(F.col("there").isNull(), "copy")
        .when(F.col("p") == F.col("v"), "skip")
        .otherwise("copy" if overwrite else "conflict")
    )
    return joined.select("slug", action.alias("action"))


def manifest(files: DataFrame, key: str) -> DataFrame:
    """(key, path, sha256, bytes): one row for each file (key, path, content), its hash the first 16 digits."""
    return files.select(key, "path", F.substring(F.sha2("content", 256), 1, 16).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def digest(rows: DataFrame, key: str, *parts: Column) -> DataFrame:
    """(key, n, digest): a hash of all rows of a key, whatever their order; add a place to ``parts`` where order counts.

    60-bit hashes of the rows are summed up, in the tasks first, so no key's rows ever meet in one place.
    """
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(row).cast("decimal(38,0)").cast("string").alias("digest"))


def metadata(packages: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, metadata): each package's metadata as JSON, with the number, size and digest of its files; the hash covers the body, not the front matter."""
    sizes = manifest(files, key)
    told = digest(sizes, key, F.col("path"), F.col("sha256")).join(sizes.groupBy(key).agg(F.sum("bytes").alias("bytes")), key)
    joined = packages.join(told, key, "left")
    fields = [F.lit("1").alias("schema_version"), *(F.col(c) for c in (key, "title", "slug", "source", "pages")), F.coalesce("n", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.col("digest").alias("content_hash")]
    return joined.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("metadata"))


def table_files(tables: DataFrame, doc: str, page: str, order: list[str]) -> DataFrame:
    """Adds ``file``: p{page}_table_{i}.csv, i counting a document's tables in order of their pages; an unknown page is 0.

    Tables are ranked within their page, and pages by the number of tables before them, so that a
    document of many tables is no single group.
    """
    paged = tables.withColumn("at", F.coalesce(page, F.lit(0)))
    within = F.row_number().over(Window.partitionBy(doc, "at").orderBy(*order))
    pages = paged.groupBy(doc, "at").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(doc).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    pages = pages.select(doc, "at", F.coalesce(before, F.lit(0)).alias("before"))
    number = (F.col("before") + F.col("within")).cast("string")
    named = paged.withColumn("within", within).join(pages, [doc, "at"])
    return named.withColumn("file", F.concat(F.lit("p"), F.col("at").cast("string"), F.lit("_table_"), number, F.lit(".csv"))).drop("at", "within", "before")


def assemble_slugs(titles: DataFrame, folders: DataFrame) -> DataFrame:
    """(doc_id, slug) of every package to write: a document's own folder is used again, a foreign or unreadable one is taken.

    ``titles`` has doc_id and slug, ``folders`` slug and doc_id (null where it can't be read).
    """
    own = folders.where("doc_id is not null").groupBy("doc_id").agg(F.min("slug").alias("own"))
    taken = folders.select("slug").distinct().withColumn("taken", F.lit(True))
    joined = titles.join(own, "doc_id", "left").join(taken, "slug", "left")
    fresh = unique_slugs(joined.where("own is null").select("doc_id", "slug"))
    free = joined.where("own is null").select("doc_id", F.col("slug").alias("wanted"), "taken").join(fresh, "doc_id")
    named = F.when(F.coalesce("taken", F.lit(False)) & (F.col("slug") == F.col("wanted")), F.concat("slug", F.lit("-"), F.substring("doc_id", 1, 8))).otherwise(F.col("slug"))
    return joined.where("own is not null").select("doc_id", F.col("own").alias("slug")).unionByName(free.select("doc_id", named.alias("slug")))


def write_packages(files: DataFrame, folder: str) -> None:
    """Files (slug, path, content) as a table under ``folder``, a partition for each package; writing a package again replaces it alone."""
    files.select("slug", "path", "content").repartition("slug").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").parquet(folder)


def export_packages(files: DataFrame, packages: DataFrame, vault: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Write the packages that ``export_actions`` says to copy; returns the actions."""
    actions = export_actions(packages, vault, overwrite)
    write_packages(files.join(actions.where("action = 'copy'").select("slug"), "slug", "left_semi"), folder)
    return actions
