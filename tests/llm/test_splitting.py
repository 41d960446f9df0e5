from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.splitting import CAP, OVERLAP, Sizes, split_oversized, split_text

ALPHABET = st.sampled_from(list("ab .\n#|<>/td中文。！") + ["\n\n", "# h\n", "<td>", "</tr>", ". A"])


def brute_estimate(text, table):
    import re

    text = re.sub(r"<[^>]+>", " ", text) if table else text
    cjk = len(re.findall("[\u4e00-\u9fff\u3400-\u4dbf\u3000-\u30ff\uf900-\ufaff]", text))
    return cjk + (len(text) - cjk) // 4


@settings(max_examples=60, deadline=None)
@given(st.lists(ALPHABET, min_size=0, max_size=400), st.booleans(), st.integers(6, 40), st.integers(0, 4))
def test_pieces_cover_the_text_and_stay_under_the_cap(parts, table, cap, overlap):
    text = "".join(parts)
    pieces = split_text(text, table, cap, overlap)
    assert "".join(text[a:b] for _, a, b in pieces) == text
    for start, a, b in pieces:
        assert start <= a < b
        assert Sizes(text, table).estimate(start, b) <= cap or len(pieces) == 1
        assert Sizes(text, table).estimate(start, a) <= max(overlap, 0)


@given(st.text(max_size=80), st.booleans())
@settings(max_examples=60, deadline=None)
def test_estimate_is_the_formula(text, table):
    assert Sizes(text, table).estimate(0, len(text)) == brute_estimate(text, table)


def test_headings_are_preferred_to_paragraphs_and_sentences():
    section = "# Title\n\n" + "One sentence of some words. " * 60 + "\n\n"
    text = section * 3
    pieces = split_text(text, cap=500, overlap=0)
    assert [text[a : a + 7] for _, a, _ in pieces] == ["# Title"] * 3


def test_a_text_without_any_boundary_is_cut_by_code_points():
    pieces = split_text("中" * 2000, cap=300, overlap=20)
    assert all(b - a <= 279 for _, a, b in pieces) and pieces[-1][2] == 2000


def test_table_tags_are_not_cut():
    text = "<table>" + "<tr><td align='right'>12</td></tr>" * 900 + "</table>"
    for _, a, b in split_text(text, True):
        assert text[a:b].count("<") == text[a:b].count(">")


def test_no_level_of_the_tree_cuts_a_tag():
    for text in (
        "<table>" + "".join(f'<td class="a b. C {i}" title="One. Two">word {i}.</td>' for i in range(900)),
        "<table>" + "".join(f"<td\n\ndata-x='{i}. A'\n>" for i in range(6000)),
        "<td " + "x. Y " * 3000 + ">" + "tail " * 3000,
    ):
        pieces = split_text(text, True)
        sizes = Sizes(text, True)
        assert len(pieces) > 1 and "".join(text[a:b] for _, a, b in pieces) == text
        assert not any(sizes.inside_tag(a) or sizes.inside_tag(start) for start, a, _ in pieces)


def test_check_query(spark, sf):
    import duckdb

    from tessera.llm import queries_p2 as Q

    duckdb.sql(f"create or replace view chunks as select * from '{sf}/chunks.parquet'")
    got = sorted(tuple(r) for r in Q.p2_check(spark, sf).collect())
    assert got and got == sorted(duckdb.sql(Q.SQL["p2_check"]).fetchall())


def test_frame(spark):
    long = "A sentence of words here. " * 400
    rows = [
        ("a", "text", ["T"], long, 1, "x"), ("a", "text", ["T"], long, 1, "x"), ("b", "text", None, None, 1, "x"), ("c", None, [], "", None, None),
        ("d", "table", ["T"], "<td>" * 2000, 0, "x"), (None, "code", ["T"], "y" * 5000, 0, "x"), ("e", "text", ["T"], "short", 9999, "x"),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_type string, heading_path array<string>, content string, start int, piece_no string")
    out = split_oversized(df).toPandas()
    assert set(out["chunk_id"].dropna()) == {"a"} and out["chunk_id"].isna().any()
    assert (out["token_est"] <= CAP).all() and out[out.chunk_id == "a"].groupby("piece_no").size().eq(2).all()
    one = out[(out.chunk_id == "a")].drop_duplicates("piece_no").sort_values("piece_no")
    assert "".join(long[a:b] for a, b in zip(one.start, one.end)) == long
    assert (one.start - one.overlap_start).iloc[1:].gt(0).all() and ((one.start - one.overlap_start) <= 4 * OVERLAP + 4).all()
    assert split_oversized(df.limit(0)).count() == 0
