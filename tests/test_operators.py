import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.functions import unicode as U
from tessera.operators import audit as A
from tessera.operators import blocks as B
from tessera.operators import classify as K
from tessera.operators import coverage as C
from tessera.operators import geometry as G
from tessera.operators import packaging as P
from tessera.operators import repair as R
from tessera.operators import vectors as V


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, tokens", [("abcd", 1), ("中文字abcde", 4), ("", 0), ("<b>中</b>", 2), (None, None)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, T.estimate_tokens(F.col("t")), t=text) == tokens


def test_scalars(spark):
    assert one(spark, T.strip_front_matter(F.col("t")), t="---\na: 1\n---\n\nbody") == "body"
    assert one(spark, T.strip_front_matter(F.col("t")), t="---\nno end") == "---\nno end"
    assert one(spark, F.array_join(T.cells(F.col("t")), "~"), t=" || a | b|| c | ") == "a~b~~c"
    assert one(spark, T.squash(F.col("t")), t="6 − 4 × 10 A") == "6-4x10a"
    assert one(spark, T.point_id(F.col("t")), t="abc") == str(uuid.uuid5(uuid.NAMESPACE_OID, "abc"))
    assert one(spark, U.slug(F.col("t"), F.lit("id")), t=" a/b: c?  -.") == "a-b-c" and one(spark, U.slug(F.col("t"), F.lit("id")), t="???") == "id"
    assert one(spark, F.array_join(T.page_range(F.col("t")), ","), t="5-7, 0,2,6") == "0,2,5,6,7"
    assert one(spark, T.page_range(F.col("t")), t="1-x") is None
    assert one(spark, U.drop_echo(F.col("t")), t="a b a b c") == "a b c"
    assert one(spark, U.close_spaced_indices(F.col("t")), t="x _ { 1 } and $a _ { 1 }$") == "x _ { 1 } and $a_{1}$"
    assert one(spark, T.strip_reply(F.col("t")), t="<think>no</think>```html\n<b>\n```") == "<b>"
    assert one(spark, T.derive_title(F.col("t"), F.lit("stem")), t="paper.docx") == "stem"
    assert one(spark, F.array_join(T.split_lines(F.col("t")), "~"), t="a\r\nb\x0cc\n") == "a~b~c"


def lines(spark, rows):
    return spark.createDataFrame([("d", i + 1, r) for i, r in enumerate(rows)], "doc string, line_no long, line string")


def test_detectors_and_their_twins(spark):
    torn = ["| v | a | b | c |", "|---|---|---|---|", "| 6 | 0 | x 10 | - 4 |", "| 5 | 1 | × 10 | - 3 |"]
    whole = ["| v | a |", "|---|---|", "| 6.0 x 10-4 | b |", "| 5.1 x 10-3 | c |"]
    count = lambda rule, rows: rule(B.table_blocks(lines(spark, rows), "doc"), "doc").count()
    assert count(A.torn_numbers, torn) == 1 and count(A.torn_numbers, whole) == 0
    assert count(A.fused_header, ["| a 12 | b 3.5% |", "| x | y |"]) == 1 and count(A.fused_header, ["| F1 | a_2 |", "| x | y |"]) == 0
    assert count(A.empty_header, ["|  | |", "| x | y |"]) == 1 and count(A.empty_header, ["| a | |", "| x | y |"]) == 0
    assert count(A.flattened_header, ["| big net price | my net price |", "| x | y |"]) == 1 and count(A.flattened_header, ["| net price | net price |", "| x | y |"]) == 0
    assert A.garbled(lines(spark, ["ok", "bad �", ""]), "doc").first()["n"] == 2
    assert A.math_collision(lines(spark, [r"\[x\] [a](#p)", r"\[x^2\]"]), "doc").first()["n"] == 1
    dirty = "a\x02b\t<span></span>[\\[X,](#p) \\[x\\]"
    assert one(spark, A.sanitize(F.col("t")), t=dirty) == "ab\t[[X,](#p) \\[x\\]"
    files = spark.createDataFrame([("d", "images/a.png"), ("d", "b.png")], "doc string, path string")
    refs = lines(spark, ["![](a.png) ![](b.png)", "![x](http://h/c.png) ![](gone.png)"])
    assert {r["ref"]: r["state"] for r in A.image_links(refs, files, "doc").collect()} == {"a.png": "rewritten", "b.png": "ok", "http://h/c.png": "remote", "gone.png": "broken"}


def test_quality_gate(spark):
    scores = {"text": F.col("t").cast("double"), "headings": F.lit(0.4), "formulas": F.lit(1.0), "tables": F.lit(0.5)}
    verdict, failed, warned = A.gate(scores, F.lit(False), F.lit("some text"))
    for t, v in (("0.29", "HALT"), ("0.3", "WARN"), ("0.6", "PASS")):
        assert one(spark, verdict, t=t) == v


def test_heading_paths_against_a_stack(spark):
    rng = random.Random(2)
    rows = [(f"d{k}", i, rng.randint(1, 4), rng.choice("abc")) for k in range(12) for i in range(25)]
    df = spark.createDataFrame(rows, "doc string, line_no long, level int, title string")
    got = {(r["doc"], r["line_no"]): list(r["path"]) for r in B.heading_paths(df, "doc").collect()}
    for k in range(12):
        stack, seen = [], {}
        for doc, i, level, title in (r for r in rows if r[0] == f"d{k}"):
            while stack and stack[-1][0] >= level:
                stack.pop()
            parent = tuple(t for _, t in stack)
            seen[parent, title] = seen.get((parent, title), 0) + 1
            stack.append((level, title if seen[parent, title] == 1 else f"{title}#{seen[parent, title]}"))
            assert got[doc, i] == [t for _, t in stack]


def test_dehyphenation_against_a_scan(spark):
    rng = random.Random(4)
    rows = [(p, i, rng.choice(["a", "b-", "c-", "-", "de"])) for p in range(30) for i in range(12)]
    got = {}
    for r in C.dehyphenate(spark.createDataFrame(rows, "page int, word_no long, word string"), ["page"]).orderBy("page", "word_no").collect():
        got.setdefault(r["page"], []).append(r["word"])
    for p in range(30):
        words, want, i = [w for q, _, w in rows if q == p], [], 0
        while i < len(words):
            if words[i].endswith("-") and len(words[i]) > 1 and i + 1 < len(words):
                want.append(words[i][:-1] + words[i + 1])
                i += 2
            else:
                want.append(words[i])
                i += 1
        assert got[p] == want


def test_coverage(spark):
    layer = spark.createDataFrame([("d", "alpha beta alpha gamma")], "doc string, text string")
    text = spark.createDataFrame([("d", "alpha beta")], "doc string, text string")
    row = C.deficit(C.bag(layer, "doc"), C.bag(text, "doc"), "doc").first()
    assert (row["missing"], row["total"], row["severity"], row["examples"]) == (2, 4, "critical", "alpha,gamma")
    assert C.deficit(C.bag(text, "doc"), C.bag(layer, "doc"), "doc").count() == 0


def test_boxes(spark):
    schema = "doc string, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double"
    rng = random.Random(1)
    rows = [("d", p, i, x := rng.random() * 300, y := rng.random() * 300, x + 10, y + 10) for p in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    merged = G.merge_boxes(df).collect()
    for p in range(4):
        boxes = [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in merged if r["page_no"] == p]
        for i, a in enumerate(boxes):  # a fixpoint: no two are near, and every word is covered
            for b in boxes[i + 1 :]:
                assert a[2] + 5 <= b[0] or b[2] + 5 <= a[0] or a[3] + 5 <= b[1] or b[3] + 5 <= a[1]
        for r in rows:
            if r[1] == p:
                assert any(a[0] <= r[3] and a[1] <= r[4] and a[2] >= r[5] and a[3] >= r[6] for a in boxes)
    cols = G.columns(df).where("page_no = 0").orderBy("left").collect()
    assert all(a["right"] + 6 < b["left"] for a, b in zip(cols, cols[1:]))
    band = spark.createDataFrame([("d", 0, i, 0.0, y, 1.0, y + 5) for i, y in enumerate([80.0] + [600 + 12.0 * k for k in range(8)])], schema)
    assert G.densest_band(band).first()["top"] == 600


@pytest.mark.parametrize(
    "html, region, block, context, status",
    [
        ("<td>1.5</td><td>22</td><td>3</td><td>44</td>", "1.5 22 3 44", "1 5 22 3 44", "", "pass"), ("<td>1</td>", "1 2", "1 2", "", "fail"), ("<td>1</td><td>99</td><td>2</td><td>3</td><td>4</td>", "1 2 3 4", "1 2 3 4", "", "fail"),
        ("<td>1</td><td>99</td>", "1", "1", "", "verify"), ("<td>1</td><td>99</td><td>2</td><td>3</td><td>4</td>", "", "1 2 3 4", "", "verify"), ("<td>1</td><td>99</td>", "1", "1", "99", "pass"),
    ],
)
def test_numeric_gate(spark, html, region, block, context, status):
    s, _ = R.numeric_gate(F.col("h"), F.col("r"), F.col("b"), F.col("c"))
    assert one(spark, s, h=html, r=region, b=block, c=context) == status


def test_missing_runs_are_put_back_or_refused():
    words = ("Authors Quenby Marrowgate wrote this paper about pumps and valves in cold conditions with many other words " * 1).split() + [f"word{chr(97 + i)}" for i in range(26)] * 3
    text = " ".join(words).replace("Quenby ", "", 1)
    done, n = R.inject_missing(words, text)
    assert n == 1 and "Authors Quenby Marrowgate" in done
    assert R.inject_missing(words, "gutted") == ("gutted", 0) and R.missing_runs(words, "gutted") == [] and R.missing_runs(words, "gutted", capped=False)
    assert R.inject_missing(words, " ".join(words)) == (" ".join(words), 0)


def test_search_is_exact_and_the_index_finds_nine_of_ten(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    x = (base[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16)], "id long, vector array<float>").repartition(5)
    queries = df.where("id % 100 = 0 and id < 1500")
    truth = {(r["query_id"], r["row_id"]) for r in V.search(queries, df, 10).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 1500, 100):
        scores = np.round(unit[q].astype(float) @ unit.T.astype(float), 4)
        want = sorted(range(1500), key=lambda i: (-scores[i], i))[:10]
        got = {r for a, r in truth if a == q}
        assert len(got & set(want)) >= 9 and len(got) == 10  # the last digit may round apart
    found = {(r["query_id"], r["row_id"]) for r in V.search_lists(queries, df, 10).collect()}
    assert len(found & truth) / len(truth) >= 0.9


def test_sync_twice_changes_nothing(spark):
    now = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", None), ("a", "x y")], "chunk_id string, embed_text string")
    state = V.sync(now, spark.createDataFrame([], "chunk_id string, vector array<float>")).cache()
    assert sorted(r["chunk_id"] for r in state.collect()) == ["a", "b", "c"]
    add, gone, same = V.diff(now, state)
    assert (add.count(), gone.count(), same.count()) == (0, 0, 3)
    add, gone, same = V.diff(now.where("chunk_id <> 'b'"), state)
    assert (add.count(), gone.count(), same.count()) == (0, 1, 2)


def test_export_and_front_matter(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "slug string, hash string")
    v = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("z", "9")], "slug string, hash string")
    want = {"a": "skip", "b": "conflict", "c": "conflict", "d": "copy", "z": "keep"}
    assert {r["slug"]: r["action"] for r in P.export_actions(p, v).collect()} == want
    assert {r["slug"]: r["action"] for r in P.export_actions(p, v, True).collect()} == want | {"b": "copy", "c": "copy"}
    assert one(spark, P.quoted(F.col("t")), t='a "b" \\c') == '"a \\"b\\" \\\\c"'


def test_classes(spark):
    rows = [("a", "ieee_paper", "$x$", 10), ("b", "notes", "plain", 3), ("c", "market outlook", "| a |", 60), ("d", None, "", None)]
    out = {r["doc_id"]: (r["doc_type"], r["source"]) for r in K.classify(spark.createDataFrame(rows, "doc_id string, name string, sample string, pages int")).collect()}
    assert out["a"] == ("academic_paper", "filename") and out["b"] == ("general", "content") and out["c"] == ("industry_report", "filename") and out["d"] == ("general", "content")


def best_by_counting(rows):
    pages = {}
    for page, tokens, _ in rows:
        if page is not None:
            pages.setdefault(page, set()).update(tokens)
    for row, (_, tokens, asks) in enumerate(rows):
        hits = {page: len(set(tokens) & found) for page, found in pages.items()}
        if asks and any(hits.values()):
            page = min(hits, key=lambda p: (-hits[p], p))
            yield row, page, hits[page]


@pytest.mark.parametrize("at_once", [1, 3, 8192])
def test_pages_of_probes(at_once):
    rng = random.Random(at_once)
    for n_words in (4, 12, 60):
        words = [f"w{i}" for i in range(n_words)]
        rows = [(rng.choice([None, -2, *range(9)]), rng.sample(words, rng.randint(0, 4)), rng.random() < 0.7) for _ in range(120)]
        rows.append((None, ["nowhere"], True))
        assert sorted(C.pages_of_probes(rows, at_once)) == sorted(best_by_counting(rows))
    assert not list(C.pages_of_probes([(None, ["a"], True)], at_once))


def test_best_page_of_many_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    docs = {f"d{d}": [(rng.choice([None, *range(5)]), [rng.choice([*words, None]) for _ in range(rng.randint(0, 9))], rng.random() < 0.8) for _ in range(rng.randint(1, 90))] for d in range(40)}
    lines = [(doc, n, page, tokens, asks) for doc, rows in docs.items() for n, (page, tokens, asks) in enumerate(rows)]
    lines += [(None, 0, 1, ["w1"], True), ("d0", 1000, 1, None, True)]
    rng.shuffle(lines)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = C.best_page(spark.createDataFrame(lines, "doc string, n int, page_no long, tokens array<string>, asks boolean"), ["doc", "n"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = [(doc, *x) for doc, rows in docs.items() for x in best_by_counting([(page, [t for t in tokens if t], asks) for page, tokens, asks in rows])]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_best_page_reads_reports_once(spark, sf):
    """Every exchange, join and scan of a plan is kept by the driver until it ends."""
    from tessera.plans import layers

    plan = layers.jon_best_page(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
