"""Windows, checkpoints, outcomes of attempts, and packages written again."""

import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import unicode as U
from tessera.operators import jobs as J
from tessera.operators import packaging as P
from tessera.operators import vectors as V


def test_windows(spark):
    docs = spark.createDataFrame([("a", 100), ("b", 101), ("c", None), ("d", 200), ("e", 1)], "doc string, page_count int")
    out = {}
    for r in J.page_windows(docs, "doc").collect():
        out.setdefault(r["doc"], []).append((r["first"], r["last"]))
    assert {d: sorted(w) for d, w in out.items()} == {"a": [(0, 99)], "b": [(0, 79), (80, 100)], "c": [(0, 0)], "d": [(0, 79), (80, 159), (160, 199)], "e": [(0, 0)]}
    half = sorted(tuple(r)[2:] for r in J.halves(J.page_windows(docs, "doc").where("doc in ('e', 'b')"), "doc").collect())
    assert half == [(0, 0, 0), (0, 0, 39), (0, 80, 90), (1, 40, 79), (1, 91, 100)]


def test_ladder(spark):
    schema = "doc string, window_no int, first int, last int, step int, ok boolean, text string, layer_chars int"
    rows = [
        ("first", 0, 0, 9, 1, True, "one", 0), ("first", 0, 0, 9, 2, True, "two", 0), ("again", 0, 0, 9, 1, False, None, 0), ("again", 0, 0, 9, 2, True, "two", 0),
        ("layer", 0, 0, 1, 1, False, None, 300), ("layer", 0, 0, 1, 3, True, "t" * 100, 300), ("thin", 0, 0, 1, 1, False, None, 300), ("thin", 0, 0, 1, 3, True, "t" * 99, 300),
        ("halves", 0, 0, 9, 1, False, None, 10), ("halves", 0, 0, 4, 4, True, "left", 10), ("halves", 0, 5, 9, 4, True, "right", 10),
        ("part", 0, 0, 9, 1, False, None, 10), ("part", 0, 0, 4, 4, False, None, 10), ("part", 0, 5, 9, 4, True, "right", 10), ("gone", 0, 0, 9, 1, False, None, None),
    ]
    out = {r["doc"]: (r["status"], r["text"]) for r in J.settle(spark.createDataFrame(rows, schema), "doc").collect()}
    assert out == {
        "first": ("ok", "one"), "again": ("ok", "two"), "layer": ("degraded", "t" * 100), "thin": ("missing", "[pages 1-2 are missing]"), "halves": ("ok", "left\n\nright"),
        "part": ("missing", "[pages 1-5 are missing]\n\nright"), "gone": ("missing", "[pages 1-10 are missing]"),
    }


def test_states_and_checkpoints(spark):
    schema = "job_id string, kind string, status string, stage string, params string, created_at double, started_at double, finished_at double, error string"
    rows = [("a", "k", "running", "x", "{}", 1.0, 2.0, None, None), ("b", "k", "running", "x", "{}", 99.0, 100.0, None, None), ("c", "k", "queued", "x", "{}", 1.0, None, None, None), ("c", "k", "done", "x", "{}", 1.0, 2.0, 3.0, None), (None, "k", "done", "x", "{}", 1.0, 2.0, 3.0, None)]
    jobs = J.job_states(spark.createDataFrame(rows, schema), F.lit(50.0))
    assert {r["job_id"]: (r["status"], r["error"]) for r in jobs.collect()} == {"a": ("failed", "interrupted"), "b": ("running", None), "c": ("done", None)}
    assert {r["job_id"] for r in J.retained(jobs, F.lit(40 * 86400.0)).collect()} == {"b"}
    windows = spark.createDataFrame([("d", 0, "p"), ("d", 1, "p")], "doc string, window_no int, params_hash string")
    done = spark.createDataFrame([("d", 0, "p"), ("d", 0, "p"), ("d", 1, "q")], "doc string, window_no int, params_hash string")
    assert [r["window_no"] for r in J.to_do(windows, done, "doc").collect()] == [1]


def test_packages_written_again(spark, tmp_path):
    titles = spark.createDataFrame([("d1", "a"), ("d2", "a"), ("d3", "b"), ("d4", "c"), ("d5", "e")], "doc_id string, slug string")
    folders = spark.createDataFrame([("a-old", "d1"), ("b", "x9"), ("c", None), ("e", "d5")], "slug string, doc_id string")
    assert {r["doc_id"]: r["slug"] for r in P.assemble_slugs(titles, folders).collect()} == {"d1": "a-old", "d2": "a", "d3": "b-d3", "d4": "c-d4", "d5": "e"}
    files = spark.createDataFrame([("s1", "a.md", "one"), ("s2", "a.md", "two")], "slug string, path string, content string")
    P.write_packages(files, str(tmp_path / "out"))
    P.write_packages(files.where("slug = 's1'").withColumn("content", F.lit("new")), str(tmp_path / "out"))
    assert {r["slug"]: r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"s1": "new", "s2": "two"}
    packages = spark.createDataFrame([("s1", "1"), ("s2", "2")], "slug string, hash string")
    vault = spark.createDataFrame([("s1", "1")], "slug string, hash string")
    actions = P.export_packages(files, packages, vault, str(tmp_path / "vault"))
    assert {r["slug"]: r["action"] for r in actions.collect()} == {"s1": "skip", "s2": "copy"} and [r["slug"] for r in spark.read.parquet(str(tmp_path / "vault")).collect()] == ["s2"]


def test_digest_tells_order_and_not_delivery(spark):
    rows = [("d", i, f"text {i}") for i in range(50)]
    random.Random(1).shuffle(rows)
    make = lambda rs: P.digest(spark.createDataFrame(rs, "k string, seq int, t string").repartition(5), "k", F.col("seq"), F.col("t")).first()["digest"]
    swapped = [(k, 1 if i == 0 else 0 if i == 1 else i, t) for k, i, t in rows]
    assert make(rows) == make(rows[::-1]) != make(swapped)


def greedy(text):
    """The definition of an echo, word by word."""
    words = unicodedata.normalize("NFKC", text).split()
    out, at = [], 0
    while at < len(words):
        n = next((n for n in (6, 5, 4, 3, 2) if at + 2 * n <= len(words) and words[at : at + n] == words[at + n : at + 2 * n]), 0)
        out += words[at : at + (n or 1)]
        at += 2 * n or 1
    return " ".join(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("a b c ﬁ fi".split()), max_size=40))
def test_echoes_go_as_defined(words):
    text = " ".join(words)
    assert U._without_echo(text) == greedy(text)


def test_index_builds_refuse_and_report(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "doc_id string, content_hash string")
    bodies = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "doc_id string, body_hash string")
    counts = spark.createDataFrame([("a", 2), ("b", 1)], "doc_id string, n_chunks int")
    plan = V.build_plan(p, bodies, counts)
    assert {r["doc_id"]: r["state"] for r in plan.collect()} == {"a": "ready", "b": "stale", "c": "empty", "d": "empty"}
    now = spark.createDataFrame([("a", "c1", "x"), ("a", "c2", "y"), ("b", "c3", "z")], "doc_id string, chunk_id string, embed_text string")
    then = spark.createDataFrame([("a", "c1", [1.0]), ("a", "c9", [1.0]), ("b", "c8", [1.0])], "doc_id string, chunk_id string, vector array<float>")
    assert sorted((r["doc_id"], r["chunk_id"]) for r in V.sync_ready(now, then, plan).collect()) == [("a", "c1"), ("a", "c2"), ("b", "c8")]
    assert tuple(V.build_report(now, then).first()) == (2, 1, 2, 3)


def test_searching_a_text(spark):
    import pytest

    embed = V.hash_embedder()
    rows = V.embed(spark.createDataFrame([("1", "red pump"), ("2", "blue valve")], "chunk_id string, embed_text string"), embed).select(F.col("chunk_id").cast("long").alias("id"), "vector")
    assert V.search_text("blue valve", embed, rows, 1).first()["row_id"] == 2
    with pytest.raises(ValueError):
        V.search_text("  ", embed, rows)
    with pytest.raises(LookupError):
        V.search_text("x", embed, rows.limit(0))
    payload = spark.createDataFrame([(2, "t", "c" * 2000)], "row_id long, title string, content string")
    hit = V.hits(V.search_text("blue valve", embed, rows, 1), payload).first()
    assert hit["title"] == "t" and len(hit["content"]) == 1500
