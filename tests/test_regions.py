"""Tables and their pages, small and by hand."""

from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import pipeline as W
from tessera.operators import regions as X

WORDS = "doc string, page_no int, word_no long, x0 double, y0 double, x1 double, y1 double, word string"


def lines(spark, texts):
    return spark.createDataFrame([(d, i + 1, r) for d, rows in texts.items() for i, r in enumerate(rows)], "doc string, line_no long, line string")


def words(spark, pages):
    """{doc: [(page, y, [(x, word), ...]), ...]}"""
    rows = []
    for doc, placed in pages.items():
        for page, y, found in placed:
            for x, word in found:
                rows.append((doc, page, len(rows), float(x), float(y), float(x + 6 * len(word)), float(y + 10), word))
    return spark.createDataFrame(rows, WORDS)


TORN = ["| name | sum | | | |", "|---|---|---|---|---|", "| alpha | 6 | 0 | × 10 | - 4 |", "| beta | 5 | 1 | × 10 | - 3 |"]


def test_torn_numbers_are_merged_only_if_all_are_found(spark):
    pages = {"good": [(0, 100, [(60, "name"), (200, "sum")]), (0, 118, [(60, "alpha"), (200, "6.0"), (230, "×"), (250, "10"), (280, "-4")]), (0, 136, [(60, "beta"), (200, "5.1"), (230, "×"), (250, "10"), (280, "-3")])]}
    pages["bad"] = pages["good"][:2] + [(0, 136, [(60, "beta"), (200, "5.7"), (230, "×"), (250, "10"), (280, "-3")])]
    pages["elsewhere"] = pages["good"][:2] + [(0, 136, [(60, "gamma"), (200, "5.1"), (230, "×"), (250, "10"), (280, "-3")])]
    texts = {d: TORN for d in pages} | {"none": TORN, "whole": ["| a | b |", "|---|---|", "| 1 | 2 |"]}
    out = X.merge_torn_columns(B.table_blocks(lines(spark, texts), "doc"), words(spark, pages), "doc").collect()
    got = {d: [r["line"] for r in sorted(out, key=lambda r: r["line_no"]) if r["doc"] == d] for d in texts}
    assert got["good"] == ["| name | sum |", "| --- | --- |", "| alpha | 6.0 × 10 -4 |", "| beta | 5.1 × 10 -3 |"]
    assert got["bad"] == got["elsewhere"] == got["none"] == TORN and got["whole"] == []
    assert {r["doc"]: r["status"] for r in out} == {"good": "repaired", "bad": "reported", "elsewhere": "reported", "none": "reported"}


def test_fused_headers_are_built_again_or_reported(spark):
    fused = ["| name alpha | size 12 | mass 3.5 |", "|---|---|---|", "| beta | 13 | 4.5 |"]
    page = [(0, 60, [(60, "Body"), (100, "text")]), (0, 100, [(60, "name"), (200, "size"), (340, "mass")]), (0, 118, [(60, "alpha"), (200, "12"), (340, "3.5")]), (0, 136, [(60, "beta"), (200, "13"), (340, "4.5")])]
    texts = {"good": fused, "lost": fused, "headless": fused, "plain": ["| name | size |", "|---|---|", "| a | 1 |"]}
    pages = {"good": page, "lost": page[:3], "headless": page[:1] + [(0, 100, [(60, "alpha"), (200, "12"), (340, "3.5")])], "plain": page}
    out = {r["doc"]: (r["status"], r["table"]) for r in X.rebuild_fused(B.table_blocks(lines(spark, texts), "doc"), words(spark, pages), "doc").collect()}
    assert out == {"good": ("repaired", "| name | size | mass |\n| --- | --- | --- |\n| alpha | 12 | 3.5 |\n| beta | 13 | 4.5 |"), "lost": ("reported", None), "headless": ("reported", None)}


def test_tables_torn_by_a_page_break(spark):
    a, b = ["| name | size |", "|---|---|", "| alpha | 12345 |", "| gamma | 333 |"], ["| delta | 777 |", "| omega | 888 |", "| kappa | 999 |"]
    low, high = [(0, y, w) for y, w in ((744, [(60, "name"), (200, "size")]), (762, [(60, "alpha"), (200, "12345")]), (780, [(60, "gamma"), (200, "333")]))], [(1, y, w) for y, w in ((60, [(60, "delta"), (200, "777")]), (78, [(60, "omega"), (200, "888")]), (96, [(60, "kappa"), (200, "999")]))]
    foot = [(0, 800, [(60, "foot")]), (1, 800, [(60, "foot")])]
    texts = {"torn": [*a, "", *b], "heading": [*a, "# Part", *b], "text": [*a, "Some text", *b], "columns": [*a, "", "| a | b | c |", "| d | e | f |"], "middle": [*a, "", *b], "caption": [*a, "", *b]}
    pages = {d: low + high + foot for d in texts} | {"middle": [(p, y - 400 if p == 0 else y, w) for p, y, w in low] + high + foot, "caption": low + high + foot + [(1, 30, [(60, "Table"), (100, "2:")])]}
    ln, wd = lines(spark, texts), words(spark, pages)
    blocks = B.table_blocks(ln, "doc")
    pairs = X.split_pairs(ln, blocks, wd, "doc")
    assert {r["doc"]: r["state"] for r in pairs.collect()} == {"torn": "merge", "heading": "merge", "middle": "report", "caption": "report"}
    assert {r["line_no"] for r in X.without_gaps(ln, pairs, "doc").where("doc = 'torn'").collect()} == {1, 2, 3, 4, 6, 7, 8}
    at = {(r["doc"], r["block"]): (r["page_no"], r["hits"]) for r in X.locate(blocks, wd, "doc").collect()}
    assert at["torn", 1] == (0, 6) and at["torn", 6] == (1, 6) and ("columns", 6) not in at
    region = {(r["doc"], r["block"]): (r["x0"], r["y0"], r["x1"], r["y1"]) for r in X.regions(blocks, wd, "doc").collect()}
    assert region["torn", 6] == (50.0, 52.0, 228.0, 114.0)


def test_tables_from_boxes(spark):
    page = [(0, 100, [(60, "name"), (200, "size")]), (0, 118, [(60, "alpha"), (200, "12")]), (0, 136, [(60, "beta")])]
    wd = words(spark, {"aligned": page, "framed": [(0, 20, [(60, "note")]), *page], "line": [(0, 20, [(60, "one")])], "column": [(0, 20, [(60, "one")]), (0, 40, [(60, "two")])]})
    frames = spark.createDataFrame([("framed", 0, 50.0, 90.0, 400.0, 150.0)], "doc string, page_no int, x0 double, y0 double, x1 double, y1 double")
    out = {r["doc"]: (r["strategy"], r["score"], r["table"]) for r in X.extract_tables(wd, frames, "doc").collect()}
    table = "| name | size |\n| --- | --- |\n| alpha | 12 |\n| beta |  |"
    assert out == {"aligned": ("aligned", 0.933, table), "framed": ("ruled", 0.933, table)}
    assert X.extract_tables(wd, None, "doc", most=1).count() == 2 and X.extract_tables(wd.limit(0), frames, "doc").count() == 0


def test_block_around_a_line_and_notes(spark):
    ln = lines(spark, {"d": ["| a |", "", "| b |", "| c |", "text"]})
    at = spark.createDataFrame([("d", 1), ("d", 4), ("d", 5)], "doc string, at long")
    assert sorted(tuple(r) for r in B.block_around(ln, at, "doc").collect()) == [("d", 1, 1, 1), ("d", 4, 3, 4)]
    ln = lines(spark, {"d": ["#### 3", "", "  The note.", "#### 4", "| a |", "##### 5"], "e": ["# 7", "text"]})
    out = sorted(tuple(r) for r in B.note_prefixes(ln, "doc").collect())
    assert out == [("d", 3, "3. The note."), ("d", 4, "4"), ("d", 5, "| a |"), ("d", 6, "5"), ("e", 1, "# 7"), ("e", 2, "text")]


def test_the_whole_chain(spark):
    fused = "| name alpha | size 12 | mass 3.5 |\n|---|---|---|\n| beta | 13 | 4.5 |"
    body = "# A title\n\n" + "Words of the text that are many enough. " * 20
    rows = [
        ("good", f"{body}\n\n\x02{fused}\n\n![](a.png)", 1, 1, 0, "ok", None), ("lost", f"{body}\n\n{fused}", 1, 1, 0, "ok", None), ("short", "x", 3, 0, 0, "ok", None), ("blank", " \n", 1, 0, 0, "ok", None),
        ("failed", None, None, None, None, "missing", "no text layer"), ("degraded", body + "\n## b\n## c\n## d\n## e", 1, 0, 2, "degraded", None), (None, "x", 1, 0, 0, "ok", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id string, text string, page_count int, expected_tables int, n_degraded int, status string, error string")
    page = [(0, 100, [(60, "name"), (200, "size"), (340, "mass")]), (0, 118, [(60, "alpha"), (200, "12"), (340, "3.5")]), (0, 136, [(60, "beta"), (200, "13"), (340, "4.5")])]
    boxes = words(spark, {"good": page, "lost": page[:2]}).withColumnRenamed("doc", "doc_id")
    layer = spark.createDataFrame([("degraded", body.split())], "doc_id string, words array<string>")
    files = spark.createDataFrame([("good", "images/a.png")], "doc_id string, path string")
    result = W.run(docs, boxes, layer, files)
    status = {r["doc_id"]: r for r in result.status.collect()}
    got = {d: (r["critical_before"], r["critical_after"], r["n_repaired"], r["n_reported"], r["verdict"], r["n_chunks"] > 0) for d, r in status.items()}
    assert got["good"][:4] == (1, 0, 1, 0) and got["lost"][:4] == (1, 1, 0, 1) and got["good"][4:] == ("PASS", True) or got["good"][4] == "WARN"
    assert got["lost"][4] == "WARN" and got["short"][4:] == ("HALT", False) and got["blank"][4:] == ("HALT", False) and got["degraded"][4] == "WARN" and status["failed"]["verdict"] == "FAILED" and status["failed"]["error"] == "no text layer"
    text = {r["doc_id"]: r["text"] for r in result.texts.collect()}
    assert "| alpha | 12 | 3.5 |" in text["good"] and "\x02" not in text["good"] and "![](images/a.png)" in text["good"] and set(text) == {"good", "lost", "degraded"}
    assert {r["doc_id"] for r in result.chunks.select("doc_id").distinct().collect()} == set(text)
    assert W.run(docs.limit(0)).status.count() == 0
    plain = W.run(docs).status.select("doc_id", (F.col("n_repaired") + F.col("n_reported")).alias("n")).collect()
    assert all(r["n"] == 0 for r in plain)
