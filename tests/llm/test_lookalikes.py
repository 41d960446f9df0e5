from tessera.llm import lookalikes as L


def test_findings_of_plain_form():
    cases = {
        "Ko\u0308pvald": ("K\u00f6pvald", ["not_composed"]), "ｂｅｆｏｒｅ １２": ("before 12", ["full_width"]), "in\u200bter\ufeff": ("inter", ["invisible"]), "a\u00a0b\u3000c": ("a b c", ["odd_space"]),
        "27\u212a": ("27K", ["not_composed"]), "x\u0304 of 9 m² ½ — “q” № （大）": ("x\u0304 of 9 m² ½ — “q” № （大）", []), "tab\tend\n": ("tab\tend\n", []),
    }
    for text, expected in cases.items():
        assert L.plain_form(text) == expected


def test_joiners_that_belong_to_the_spelling_stay():
    assert L.plain_form("क्\u200dष") == ("क्\u200dष", [])
    assert L.plain_form("👩\u200d🔬")[1] == []


def test_the_dominant_script_is_that_of_the_letters_that_look_like_no_other():
    found = {token: options for token, options in L.mixed_tokens("wеight and Слой α-phase Δt Οnly θ Сloй xлeб λoγoς")}
    assert {t: o[0] for t, o in found.items()} == {"wеight": ("latin", "weight"), "Οnly": ("latin", "Only"), "xлeб": ("cyrillic", "хлеб"), "λoγoς": ("greek", "λογος"), "Δt": ("greek", "Δτ")}
    assert "Сloй" not in found  # both scripts have letters of their own in it
    assert [s for s, _ in L.scripts_of("хоpа")] == ["cyrillic", "latin"] and [s for s, _ in L.scripts_of("аo")][0] == "latin"


def test_repair_goes_both_ways_and_only_to_words(spark):
    texts = {"k1": "хлеб и хора weight cope", "k2": "xлeб", "k3": "wеight", "k4": "хоpа", "k5": "соpе", "k6": "рaх", "k7": "дoм"}
    df = spark.createDataFrame([(k, "content", t) for k, t in texts.items()], "record_id string, field_name string, text string")
    out = {r["record_id"]: (r["canonical"], r["findings"]) for r in L.canonical(df).collect()}
    assert out["k2"] == ("хлеб", []) and out["k3"] == ("weight", ["lookalike"])
    assert out["k4"] == ("хора", []) and out["k5"] == ("cope", ["lookalike"])  # open letters: the corpus decides
    assert out["k6"] == ("рaх", []) and out["k7"] == ("дoм", [])  # no words: kept; most letters are Cyrillic


def test_frame(spark):
    rows = [
        ("a", "content", "the wеight of", 1), ("b", "content", "weight", 1), ("c", "content", "rаrеx", 1), ("d", "title", None, 1), ("e", "title", "", None), (None, "content", "Оnly", 1),
        ("a", "content", "the wеight of", 1), ("long", "content", "x " * 200_000 + "\u200b", 1),
    ]
    df = spark.createDataFrame(rows, "record_id string, field_name string, text string, word int")
    out = {(r["record_id"], r["canonical"][:20], tuple(r["findings"])) for r in L.canonical(df).collect()}
    assert ("a", "the weight of", ("lookalike",)) in out  # the word is in the corpus
    assert ("c", "rаrеx", ("lookalike",)) in out  # this one isn't: kept and reported
    assert ("b", "weight", ()) in out and ("e", "", ()) in out and not any(k == "d" for k, _, _ in out)
    assert (None, "Оnly", ("lookalike",)) in out
    assert any(k == "long" and f == ("invisible",) for k, _, f in out)
    assert L.canonical(df.limit(0)).count() == 0
