"""Vectors of chunks: deterministic embedding, incremental sync, filtered exact search in blocks, an inverted-file index."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 512, 4096


def hash_embedder(dimensions: int = 32) -> Callable[[list[str]], np.ndarray]:
    """An embedder that needs no model: signed counts of hashed words, normalised. Stands in for a real one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                h = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                row[int.from_bytes(h[:4], "little") % dimensions] += 1 if h[4] & 1 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


def embed(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None, batch: int = 64, retries: int = 1) -> DataFrame:
    """(chunk_id, vector): ``embed_text`` through any embedder in batches, tried again once."""
    embedder = embedder or hash_embedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("embed_text").to_pylist()
            parts = []
            for at in range(0, len(texts), batch):
                for attempt in range(retries + 1):
                    try:
                        parts.append(embedder([t or "" for t in texts[at : at + batch]]))
                        break
                    except Exception:
                        if attempt == retries:
                            raise
            vectors = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(list(vectors), pa.list_(pa.float32()))], names=["chunk_id", "vector"])

    return chunks.select("chunk_id", "embed_text").mapInArrow(run, "chunk_id string, vector array<float>")


def diff(current: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to add, to delete, unchanged) by chunk_id; the ids are content-addressed, so equal ids are equal content."""
    now, then = current.select("chunk_id").distinct(), indexed.select("chunk_id").distinct()
    return now.join(then, "chunk_id", "left_anti"), then.join(now, "chunk_id", "left_anti"), now.join(then, "chunk_id", "left_semi")


def sync(current: DataFrame, indexed: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """The new state of the index (chunk_id, vector): vanished ids gone, only new ones embedded."""
    add, gone, _ = diff(current, indexed)
    fresh = embed(current.dropDuplicates(["chunk_id"]).join(add, "chunk_id", "left_semi"), embedder)
    return indexed.join(gone, "chunk_id", "left_anti").select("chunk_id", "vector").unionByName(fresh)


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, vector) packed into blocks (ids, matrix) where they lie; zero and null vectors have no direction and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = b.column(1).to_pylist()
            kept = [(i, v) for i, v in zip(ids, rows) if i is not None and v and any(v)]
            for at in range(0, len(kept), size):
                part = kept[at : at + size]
                m = np.array([v for _, v in part], dtype=np.float64)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([[i for i, _ in part]], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["ids", "matrix"])

    return df.mapInArrow(run, "ids array<long>, matrix binary").select(F.col("ids").alias(f"{name}_ids"), F.col("matrix").alias(f"{name}_matrix"))


def _top(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q_matrix, r_ids, r_matrix in zip(*(b.column(c).to_pylist() for c in ("q_ids", "q_matrix", "r_ids", "r_matrix"))):
                q = np.frombuffer(q_matrix).reshape(len(q_ids), -1)
                r = np.frombuffer(r_matrix).reshape(len(r_ids), -1)
                scores = np.round(q @ r.T, 4)
                ids = np.array(r_ids)
                out_q, out_r, out_s = [], [], []
                for i, row in enumerate(scores):
                    least = np.partition(row, -k)[-k] if len(row) > k else -2.0
                    near = np.flatnonzero(row >= least)
                    near = near[np.lexsort((ids[near], -row[near]))][:k]
                    out_q.extend([q_ids[i]] * len(near))
                    out_r.extend(ids[near].tolist())
                    out_s.extend(row[near].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_r, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "row_id", "score"])

    return run


def search(queries: DataFrame, rows: DataFrame, k: int = 10, parts: int | None = None) -> DataFrame:
    """(query_id, row_id, score, place): the ``k`` rows nearest by cosine to each query, exactly.

    Both sides have id and vector. Blocks of rows are dealt to ``parts`` tasks and every block of
    queries is sent to each of them, so neither side is broadcast or gathered, whatever its size; a
    pair of blocks gives its best k, and a window keeps the best of all. Filters belong on ``rows``,
    before. k is held to 1 to 50.
    """
    k = max(1, min(50, k))
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = _blocks(queries.select(F.col("id").cast("long"), "vector"), QUERY_BLOCK, "q").select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    r = _blocks(rows.select(F.col("id").cast("long"), "vector"), ROW_BLOCK, "r").withColumn("part", F.pmod(F.xxhash64(F.get("r_ids", F.lit(0))), F.lit(parts)).cast("int"))
    near = r.join(q, "part").mapInArrow(_top(k), "query_id long, row_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return near.withColumn("place", place).where(F.col("place") <= k)


def hits(near: DataFrame, payload: DataFrame, longest: int = 1500) -> DataFrame:
    """Search results with the title and the start of the content of each row; ``payload`` has row_id, title and content."""
    return near.join(payload.select("row_id", "title", F.substring("content", 1, longest).alias("content")), "row_id", "left")


def search_text(text: str, embedder: Callable[[list[str]], np.ndarray], rows: DataFrame, k: int = 10) -> DataFrame:
    """The nearest rows to a text; a blank text or an empty index is an error."""
    if not text or not text.strip():
        raise ValueError("the query is empty")
    if rows.isEmpty():
        raise LookupError("nothing is indexed")
    vector = [float(x) for x in embedder([text])[0]]
    query = rows.sparkSession.createDataFrame([(0, vector)], "id long, vector array<float>")
    return search(query, rows, k).drop("query_id")


# --- building the index --------------------------------------------------------------------------------------------------


def build_plan(packages: DataFrame, bodies: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, state) of every package: stale if its body's hash isn't the one it was chunked from, empty without chunks, else ready.

    ``packages`` has doc_id and content_hash, ``bodies`` doc_id and body_hash, ``counts`` doc_id and n_chunks.
    """
    joined = packages.join(bodies, "doc_id", "left").join(counts, "doc_id", "left")
    fresh = F.col("content_hash").eqNullSafe(F.col("body_hash"))
    return joined.select("doc_id", F.when(~fresh, "stale").when(F.coalesce("n_chunks", F.lit(0)) == 0, "empty").otherwise("ready").alias("state"))


def write_index(rows: DataFrame, folder: str) -> None:
    """The index as a table (chunk_id, doc_id, chunk_type, page, vector): a folder for each type, sorted by document and page.

    A filter on the type reads its folder alone; one on document or page skips row groups by their bounds.
    """
    placed = rows.select("chunk_id", "doc_id", F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type"), "page", "vector")
    spread = placed.repartition("chunk_type", F.substring(F.md5("doc_id"), 1, 2)).sortWithinPartitions("chunk_type", "doc_id", "page")
    spread.write.mode("overwrite").partitionBy("chunk_type").parquet(folder)


def filtered(index: DataFrame, doc_id: str | None = None, chunk_type: str | None = None, first_page: int | None = None, last_page: int | None = None) -> DataFrame:
    """Rows of the index that the given conditions leave; an unknown page is on none."""
    if doc_id is not None:
        index = index.where(F.col("doc_id") == doc_id)
    if chunk_type is not None:
        index = index.where(F.col("chunk_type") == chunk_type)
    if first_page is not None:
        index = index.where(F.col("page") >= first_page)
    return index if last_page is None else index.where(F.col("page") <= last_page)


def build_report(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row (embedded, unchanged, deleted, total) of what a sync does."""
    now, then = current.select("chunk_id", F.lit(True).alias("now")).distinct(), indexed.select("chunk_id", F.lit(True).alias("then")).distinct()
    both = now.join(then, "chunk_id", "full")
    return both.agg(
        F.count_if(F.col("then").isNull()).alias("embedded"), F.count_if(F.col("now") & F.col("then")).alias("unchanged"), F.count_if(F.col("now").isNull()).alias("deleted"),
        F.count_if(F.col("now").isNotNull()).alias("total"),
    )


def sync_ready(current: DataFrame, indexed: DataFrame, plan: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """The index after a sync of the ready packages alone (doc_id, chunk_id, vector); those of refused packages stay as they are."""
    ready = plan.where("state = 'ready'").select("doc_id")
    kept = indexed.join(ready, "doc_id", "left_anti").select("doc_id", "chunk_id", "vector")
    chosen, before = current.join(ready, "doc_id", "left_semi"), indexed.join(ready, "doc_id", "left_semi")
    owners = chosen.select("chunk_id", "doc_id").dropDuplicates(["chunk_id"])
    return kept.unionByName(sync(chosen, before, embedder).join(owners, "chunk_id").select("doc_id", "chunk_id", "vector"))


# --- inverted-file index -------------------------------------------------------------------------------------------------


MOST_CENTRES, ROWS_A_CENTRE = 8192, 32  # bounds of the fit: at most 8,192 lists from 262,144 rows


def list_count(n_rows: int) -> int:
    """As many lists as rows in each, up to the bound."""
    return max(1, min(MOST_CENTRES, round(max(1, n_rows) ** 0.5)))


def fit_centres(rows: DataFrame, n_centres: int | None = None, steps: int = 15) -> np.ndarray:
    """Centres of spherical k-means on at most ``ROWS_A_CENTRE`` rows for each, picked by hash of their id (a documented bound)."""
    n_centres = n_centres or list_count(rows.count())
    drawn = rows.where("vector is not null").orderBy(F.xxhash64("id"), "id").select("vector").limit(ROWS_A_CENTRE * n_centres).collect()
    x = np.array([r[0] for r in drawn], dtype=np.float64)
    if not len(x):
        return np.zeros((1, 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.linspace(0, len(x) - 1, min(n_centres, len(x))).astype(int)]
    for _ in range(steps):
        owner = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        lost = np.bincount(owner, minlength=len(centres)) == 0
        sums[lost] = centres[lost]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def needed_probes(queries: DataFrame, rows: DataFrame, centres: np.ndarray, k: int, recall: float = 0.95, sample: int = 64) -> int:
    """In how many lists nearest to a query so large a share of its true neighbours lies, over at most ``sample`` queries."""
    drawn = queries.where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
    truth = search(drawn, rows, k).select("query_id", F.col("row_id").alias("id"))
    lists = assign_lists(rows.join(truth.select("id").distinct(), "id", "left_semi"), centres, 1).select("id", "list_no")
    found = truth.join(lists, "id").join(drawn.select(F.col("id").cast("long").alias("query_id"), "vector"), "query_id").select("vector", "list_no").collect()
    if not found:
        return len(centres)
    near = np.argsort(-(np.array([r[0] for r in found], dtype=np.float64) @ centres.T), axis=1, kind="stable")
    ranks = np.sort((near == np.array([[r[1]] for r in found])).argmax(axis=1))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def assign_lists(rows: DataFrame, centres: np.ndarray, n_lists: int) -> DataFrame:
    """(id, vector, list_no): each row in its ``n_lists`` nearest lists; every row is indexed."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # n_centres vectors, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            vectors = b.column(1).to_pylist()
            x = np.array([v if v else np.zeros(c.shape[1]) for v in vectors], dtype=np.float64).reshape(len(vectors), -1)
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n_lists] if len(x) else np.zeros((0, 0), int)
            lists = pa.array([row.tolist() for row in near], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "vector", "lists"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select(F.col("id").cast("long"), "vector").mapInArrow(run, f"id long, vector {kind}, lists array<int>").select("id", "vector", F.explode("lists").alias("list_no"))


def search_lists(queries: DataFrame, rows: DataFrame, k: int = 10, n_centres: int | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, row_id, score, place): approximate search in the lists nearest to each query.

    Every row is in one list. The number of lists grows with the square root of the rows; how many of
    them are searched is measured on a sample of the queries, so that nine of ten true neighbours and
    more are found (``needed_probes``). Long lists are split, so that no list's rows are one hot key.
    """
    centres = fit_centres(rows, n_centres)
    probes = probes or needed_probes(queries, rows, centres, k)
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inverted = assign_lists(rows, centres, 1).select("list_no", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.col("id").alias("row_id"), F.col("vector").alias("r"))
    probed = assign_lists(queries, centres, probes).select("list_no", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("id").alias("query_id"), F.col("vector").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    near = probed.join(inverted, ["list_no", "salt"])
    lengths = F.sqrt(dot("q", "q")) * F.sqrt(dot("r", "r"))
    score = F.round(F.try_divide(dot("q", "r"), lengths), 4)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return near.select("query_id", "row_id", score.alias("score")).where("score is not null").withColumn("place", place).where(F.col("place") <= k)
