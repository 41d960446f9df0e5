import random

from tessera.llm.sentences import QUOTED, candidates, sentence_ends, units

PARAGRAPHS = [
    "The pump was tested. It failed twice. See Fig. 4 for more.", "Dr. Quenby met Mr. Drosk in March. They spoke, etc. The end came.", "It was cooled at 3 p.m. The rest is in Sec. 2.8 of it.",
    "“The seal failed. We fixed it,” said Prof. Aldous. Nobody knew…", "Version 3.7.304 runs. The file a_3.4.pdf is at docs.x.invalid/v3. Stop now!", "Was it cold?! It was. (The pump is on p. 9.) Next came Dr. Dresk.",
]
EXPECTED = {
    1: ["The pump was tested.", "It failed twice.", "See Fig. 4 for more."], 2: ["Dr. Quenby met Mr. Drosk in March.", "They spoke, etc.", "The end came."],
    3: ["It was cooled at 3 p.m.", "The rest is in Sec. 2.8 of it."], 4: ["“The seal failed. We fixed it,” said Prof. Aldous.", "Nobody knew…"],
    5: ["Version 3.7.304 runs.", "The file a_3.4.pdf is at docs.x.invalid/v3.", "Stop now!"], 6: ["Was it cold?!", "It was.", "(The pump is on p. 9.)", "Next came Dr. Dresk."],
}


def split(text, ends):
    out, at = [], 0
    for e in sorted(ends):
        out.append(text[at:e].strip())
        at = e
    return out


def test_labelled_paragraphs(spark):
    rows = [(i, p) for i, p in enumerate(PARAGRAPHS, 1)]
    # the statistics need a corpus: the same kinds of sentences in any order
    rng = random.Random(5)
    sentences = [s for p in EXPECTED.values() for s in p] + ["Fig. 3 shows Dr. Wren and Mr. Moor.", "No. 8 was sold in 1994.", "The pumps run well."]
    rows += [(1000 + k, "\n\n".join(" ".join(rng.choices(sentences, k=3)) for _ in range(6))) for k in range(80)]
    ends = {}
    for r in sentence_ends(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        ends.setdefault(r["doc_id"], []).append(r["sent_end"])
    right = sum(split(PARAGRAPHS[i - 1], ends[i]) == EXPECTED[i] for i in EXPECTED)
    assert right == len(EXPECTED), {i: split(PARAGRAPHS[i - 1], ends[i]) for i in EXPECTED}


def test_certain_units():
    text = "# A heading. Still one\n\n4.3 Numbered heading\n\n- item one. Two.\n- item two\n\n1. first\n2. second\n\nplain text\ngoes on.\n\n  \n"
    assert [text[a:b] for a, b, _ in units(text)] == ["# A heading. Still one", "4.3 Numbered heading", "- item one. Two.", "- item two", "1. first", "2. second", "plain text\ngoes on."]


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "  \n ", 1), (4, "no stop at all", 1), (5, "水泵潮湿。报告写道：“喷嘴均匀。”快检查样品！", 1), (6, "ก ข", 1), (4, "no stop at all", 1), (7, "word " * 200_000, None), (8, "a.\r\n\r\nb", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sent_end int")
    got = {}
    for r in sentence_ends(df).collect():
        got.setdefault(r["doc_id"], []).append(r["sent_end"])
    assert set(got) == {4, 5, 6, 7, 8} and got[4] == [14, 14] and sorted(got[5]) == [5, 17, 23] and sorted(got[6]) == [1, 3] and sorted(got[8]) == [2, 7]
    assert sentence_ends(df.limit(0)).count() == 0


def test_long_quotations_hide_their_stops():
    inner = "The seal failed at noon. " * 80
    text = f"He said “{inner}It was over” and left. Then (see it) he came back."
    quoted = [bool(code & QUOTED) for _, code, _, _ in candidates(text, 0, len(text))]
    assert quoted == [True] * 80 + [False]


def test_tokens_beyond_the_known_ones_decide_alike(spark):
    rng = random.Random(8)
    names = [f"abbr{k}" for k in range(40)]
    rows = []
    for i in range(150):
        lines = [f"The {rng.choice(names)}. Moor pump failed", f"Sure thing went in {rng.choice(names)}", f"{rng.choice('eh so no'.split())} well, they said", "Others ran on"]
        said = [". ".join(rng.choices(lines, k=3)) + "." for _ in range(4)]
        rows.append((i, "\n\n".join(said)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ends = [sorted(tuple(r) for r in sentence_ends(df, kept=kept).collect()) for kept in (1 << 16, 3, 0)]
    assert ends[0] == ends[1] == ends[2] and len(ends[0]) > len(rows) * 4


def test_no_token_is_cut():
    long = "x" * 300
    text = f"{long}a. {long}b said. End"
    words = [(w, t) for _, _, w, t in candidates(text, 0, len(text))]
    other = [(w, t) for _, _, w, t in candidates(text.replace("xa.", "xc."), 0, len(text))]
    assert words[0][0] != other[0][0] and words[0][1] == other[0][1] and words[0][0].startswith("x#")


def test_a_corpus_with_one_kind_of_example_is_decided_by_the_prior(spark):
    df = spark.createDataFrame([(1, "One pump ran. Two failed."), (2, "Three ran.\n\nFour ran.")], "doc_id long, text string")
    assert sorted(tuple(r) for r in sentence_ends(df).collect()) == [(1, 13), (1, 25), (2, 10), (2, 21)]


def test_hostile_texts_end():
    import time

    from tessera.llm.sentences import _turn

    began = time.time()
    for piece in ("。", "字", "字。", "a", "a.", ". ", "“a. ", "x\u00a0", ".)", "1.", "- a\n", "\u0e01 "):
        text = piece * (60_000 // len(piece))
        for a, b, is_open in units(text):
            candidates(text, a, b)
            _turn(text, a, b)
    assert time.time() - began < 8
