import pytest

from tessera.llm import scanned as O

TITLE = "Results of the Pump Trials"


@pytest.mark.parametrize(
    "text, defects",
    [
        ("a word bro-\nken here", {"hyphenation"}), ("hydro‐\n\n[53]\n\ngranule was", {"hyphenation", "page_number"}), ("Both the pre-\nand post-values", set()), ("Pages 12-\n19 list", set()),
        ("model B3-\n7 was", set()), ("text\n— 19 —\nmore", {"page_number"}), ("text\nvi\nmore", {"page_number"}), ("text\n9 / 13\nmore", {"page_number"}), ("Readings in kPa:\n20\n22\n31\nend", set()),
        ("text\nPage 16 of 46\nmore", {"page_number"}), (f"text\nVol. 4   {TITLE}\nmore", {"running_header"}), (f"text\n{TITLE.upper()}   12\nmore", {"running_header"}), (f"{TITLE}\ntext", set()),
        ("one line only", set()), ("", set()), ("text\nmm.\nmore", set()), ("```\n12\n```", set()),
    ],
)
def test_defects_of_lines(text, defects):
    assert O.layout(text, TITLE)[1] == defects


def test_paragraphs_are_continuous():
    text = f"# {TITLE}\n\nThe first line is bro-\nken and goes\n12\n{TITLE}\non here.\n\nA new one."
    assert O.layout(text, TITLE)[0] == f"# {TITLE}\n\nThe first line is broken and goes on here.\n\nA new one."


def test_costs():
    assert O.misreading_cost("modern", "rnodern") == 0.25
    assert O.misreading_cost("channel", "chanriel") == 0.25
    assert O.misreading_cost("filter", "fitler") > 10 and O.misreading_cost("minimum", "rniniınurn") > 10
    assert O.misreading_cost("environmental commemorations".replace(" ", ""), "environrnental cornrnernorations".replace(" ", "")) == 1.0
    assert O.misreading_cost("вода", "вoдa") == 0.5
    assert O.misreading_cost("same", "same") == 0.0
    assert O.fold("rnodern") == O.fold("modern") and O.fold("carrle") == O.fold("carrie")


def test_frame(spark):
    good = "The modern channel carries the elevated filter near the surface. " * 30
    rows = [
        ("ok", good, TITLE, 1), ("bad", "The rnodern channel carr!es the elevatecl filter near the sur-\nface.", TITLE, 1), ("swap", "The mdoern chanenl near it.", TITLE, 1), ("code", "See B80O and Q71O of it.", None, 1),
        ("null", None, TITLE, 1), ("empty", "", None, None), ("bad", "The rnodern channel carr!es the elevatecl filter near the sur-\nface.", TITLE, 1), (None, "x", None, 1), ("long", "word " * 200_000, None, 1),
    ]
    df = spark.createDataFrame(rows, "record_id string, text string, title string, seen int")
    assert {(r[0], r[1]) for r in O.find_defects(df).collect()} == {("bad", "misread"), ("bad", "hyphenation")}
    repaired = {r["record_id"]: r for r in O.repair(df).collect()}
    assert repaired["bad"]["repaired"] == "The modern channel carries the elevated filter near the surface." and repaired["bad"]["n_corrected"] == 3
    assert repaired["swap"]["n_corrected"] == 0 and repaired["code"]["n_corrected"] == 0 and repaired["empty"]["repaired"] == ""
    assert O.find_defects(df.limit(0)).count() == 0 and O.repair(df.limit(0)).count() == 0


def test_misread_edges(spark):
    good = "The annual report carries the indexed cover over the lake. " * 30
    rows = [("end", "The annua| report.", None), ("start", "It (arries the !ndexed cover.", None), ("bracket", "The lake (over the cover) is here.", None)]
    df = spark.createDataFrame([("ok", good, None), *rows], "record_id string, text string, title string")
    assert {(r[0], r[1]) for r in O.find_defects(df).collect()} == {("end", "misread"), ("start", "misread")}
    repaired = {r["record_id"]: r["repaired"] for r in O.repair(df).collect()}
    assert repaired["end"] == "The annual report." and repaired["start"] == "It carries the indexed cover." and repaired["bracket"] == rows[2][1]


def test_misread_capitalised_words(spark):
    good = "In November the local conduit was robust and slow to boil. " * 30
    rows = [
        ("word", "In N0vember the L0cal C0nduit.", "In November the Local Conduit."), ("caps", "THE N0VEMBER OF IT", "THE NOVEMBER OF IT"),
        ("code", "See S10W, B01L, X68A2, B80O, L0C and 10W of it.", "See S10W, B01L, X68A2, B80O, L0C and 10W of it."),
    ]
    df = spark.createDataFrame([("ok", good, None), *((i, text, None) for i, text, _ in rows)], "record_id string, text string, title string")
    assert {(r[0], r[1]) for r in O.find_defects(df).collect()} == {("word", "misread"), ("caps", "misread")}
    assert {r["record_id"]: r["repaired"] for r in O.repair(df).collect()} == {"ok": good, **{i: plain for i, _, plain in rows}}


def test_headers_of_any_length():
    beside = "Proceedings of the Ninth Symposium on Pumps and Valves   Volume 12"
    assert O.layout(f"text\n{beside}   {TITLE}\nmore", TITLE) == ("text more", {"running_header"})
    assert O.layout(f"text\n{TITLE.upper()} | {beside}\nmore", TITLE)[1] == {"running_header"}
    assert O.layout("text\nFAQ   12\nmore FAQ here", "FAQ") == ("text more FAQ here", {"running_header"})
    sentence = f"As the report named {TITLE} has shown, the pump ran well for years and years."
    assert O.layout(f"text\n{sentence}\nmore", TITLE) == (f"text {sentence} more", set())


def test_headers_alone_at_a_page_break():
    beside = "a chapter on the keeping of valves, pumps, pipes and their many smaller parts in the field"
    assert O.layout(f"text\n\n{TITLE} - {beside}\n\nmore", TITLE)[1] == {"running_header"}
    assert O.layout(f"text\n12\n{TITLE} - {beside}\n\nmore", TITLE)[1] == {"running_header", "page_number"}
    assert O.layout(f"text\n\n{TITLE} - {beside}.\n\nmore", TITLE)[1] == set()
    assert O.layout("text\n" + "- " * 20 + "12" + " -" * 20 + "\nmore")[1] == set() and O.layout("text\n[" + " " * 40 + "12 ]\nmore")[1] == {"page_number"}


def test_neighbours_decide_among_words(spark):
    good = "the farm gate was open " * 20 + "the form letter was sent " * 20 + "the firm handshake was given " * 20
    rows = [("ok", good, None), ("a", "the f0rm letter", None), ("b", "the f@rm gate", None), ("c", "a f0rm gate", None)]
    df = spark.createDataFrame(rows, "record_id string, text string, title string")
    options = spark.createDataFrame([("f0rm", "form", 20, 0.25), ("f0rm", "farm", 20, 0.5)], "seen string, word string, word_n long, cost double")
    places = spark.createDataFrame([("a", "f0rm", "the", "letter"), ("c", "f0rm", "a", "gate"), ("d", "f0rm", O._EDGE, O._EDGE)], "record_id string, seen string, before string, after string")
    chosen = {r["record_id"]: r["word"] for r in O.choose(df, places, options).collect()}
    assert chosen == {"a": "form", "c": "farm", "d": "form"}
    needed = spark.createDataFrame([("farm", "gate"), ("form", "gate"), ("the", "form")], "first string, second string")
    assert {tuple(r) for r in O.bigram_counts(df, needed).collect()} == {("farm", "gate", 20), ("the", "form", 20)}


def test_words_of_other_scripts(spark):
    good = "Вода стоит в старом городе " * 30
    df = spark.createDataFrame([("ok", good, None), ("bad", "В старoм гор0де", None)], "record_id string, text string, title string")
    assert {tuple(r) for r in O.find_defects(df).collect()} == {("bad", "misread")}
    assert {r["record_id"]: r["repaired"] for r in O.repair(df).collect()}["bad"] == "В старом городе"


def test_defects_of_layout_are_spread_over_the_join(spark):
    rows = [(f"r{i}", f"text\n{i}\nmore", None) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id string, text string, title string")
    found = O.find_defects(df)
    assert found.count() == 400
