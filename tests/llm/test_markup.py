import pytest

from tessera.llm import markup as M

LITERAL = [
    "The difference was small (p < 0.05) and a < b held.", "Prices rose from $40 million to $58 million.", "The grid is 35*8*3 and the field a_b_c has 100$ in it.",
    "A share \\\\server\\folder & a folder ~/x were read.", "Sample #9 was stored under C:\\temp\\new_file.", "It stands at 8° 5' 30'' [sic].", "See [5] and [5, 6].",
    "The tools C# and F# read array[3][2].", 'the text "if x <= y && y >= 42" was', "The check n == 0 failed when 3 * 4 * 9 was above.", "The R&D unit kept file_x_v2.", "within ~8 kPa",
    "The set {a, b} is called B9 and 7 > 4.", "f(x) = 2x + 6", "Both classes (<2 and >46 kPa)", "a stab|e pump", "The pump costs $1,8.50 per dB, incl. the pipe.", "a - b - c", "- 12 -",
]


@pytest.mark.parametrize("text", LITERAL)
def test_literal_signs_are_no_markup(text):
    assert M.kinds(text) == []


MARKED = {
    "x <b>bold</b> y": "x bold y", "# Head\ntext": "# Head\ntext", "a **b** _c_ ~~d~~ `e`": "a b c d e", "* one\n+ two": "- one\n- two", "- [x] done\n- [ ] open": "- done\n- open",
    "see [label](http://x/y) now": "see label now", "![alt](images/a.png)": "alt", "a[^1] b\n\n[^1]: note": "a b\n\n- note", "[[Page|label]] and [[other]]": "label and other",
    "''italic'' '''bold'''": "italic bold", "== Head ==\nx": "## Head\nx", "{{val|5|{{unit|kg}}}} x": "5 kg x", "\\section{Head}\ntext \\textbf{b}": "# Head\ntext b", "no~\\cite{x1999} end": "no end",
    "a &amp; b&nbsp;c": "a & b\xa0c", "x <!-- hidden --> y": "x y", "> quoted": "quoted", "Head\n====\nx": "# Head\nx", '---\ntitle: "T"\n---\nx': "# T\n\nx", "<ul><li>a</li><li>b</li></ul>": "- a\n- b",
    "$$\nx^2\n$$": "$$ x^2 $$", "so \\(k_1\\) is": "so $k_1$ is", "| a | b |\n|---|---|\n| 1 | 2 |": "a | b\n1 | 2", "\\begin{itemize}\n\\item a\n\\end{itemize}": "- a", "text <td class=\"x more": "text  more",
}


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found_and_turned_into_plain_notation(text):
    assert M.kinds(text)
    assert " ".join(M.clean(text).split()) == " ".join(MARKED[text].split())


def test_code_keeps_its_signs_and_language():
    assert M.clean("```python\na_b = x * y * z  # <b>\n```") == "```python\na_b = x * y * z  # <b>\n```"
    assert M.clean("x\n<pre><code>if a &lt; b:</code></pre>") == "x\n\n```\nif a < b:\n```"


def test_lists_keep_levels_and_numbers():
    assert M.clean("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>") == "- a\n  - b\n- c"
    assert M.clean("<ol><li>a</li><li>b</li></ol>") == "1. a\n2. b"
    assert M.clean("- a\n  - b\n* c") == "- a\n  - b\n- c"
    assert M.clean("\\begin{enumerate}\n\\item a\n\\item b\n\\end{enumerate}") == "1. a\n2. b"


def test_nothing_is_held_by_marks_in_the_text():
    text = "a \ue0000\ue001 b \ue0007\ue001 `c` $x^2$"
    assert M.clean(text) == "a \ue0000\ue001 b \ue0007\ue001 c $x^2$"


def test_escaped_tags_are_text():
    assert M.clean("the tag &lt;b&gt;keep&lt;/b&gt; is bold") == "the tag <b>keep</b> is bold"


def test_any_depth():
    wiki, tex = "deep", "deep"
    for _ in range(30):
        wiki, tex = "{{a|" + wiki + "}}", "\\textbf{" + tex + "}"
    assert M.clean(wiki) == "deep" and M.clean(tex) == "deep"
    assert M.clean("<div>" * 3000 + "x" + "</div>" * 3000).strip() == "x"


def test_long_formulas_stay_whole():
    formula = "$" + " + ".join(f"x_{i} < y" for i in range(200)) + "$"
    assert M.clean(f"so {formula} holds <b>here</b>") == f"so {formula} holds here"


@pytest.mark.parametrize("piece", ["<b>", "<ul><li>", "<td>", "- a\n", "  - b\n", "<li><b>", "{", "{{", "<b>{", "[[", "`", "<a href=", "$", "*a", "_b ", "\\textbf{", "|", "| |", "<pre>", "<!--", "''", "<a " + " " * 50, "[x](", "\\begin{a}", "&", "> ", "]]", "a & "])
def test_hostile_texts_end(piece):
    import time

    began = time.time()
    for text in (piece * (60_000 // len(piece)), "\n".join([piece] * (60_000 // len(piece)))):
        M.clean(text)
    assert time.time() - began < 3


def test_subtrees_and_their_removal():
    text = "<div><nav><a>x</a></nav>body</div>"
    assert len({h for _, _, h in M.subtrees(text)}) == 3
    nav = next(h for a, b, h in M.subtrees(text) if text[a:b].startswith("<nav>"))
    assert M.clean(text, {nav}) == "body"
    assert nav in {h for _, _, h in M.subtrees("<p>more</p><nav><a>x</a></nav>")}


def test_templates_recurring_on_pages_of_a_host_go(spark):
    menu = '<div class="menu"><a href="x">home</a></div>'
    rows = [(f"p{i}", "content", "h1", f"{menu} text {i}", "x") for i in range(8)] + [("q1", "content", "h2", f"{menu} only", "x"), ("q1", "content", "h2", f"{menu} only", "x")]
    rows += [(f"o{i}", "content", None, f"{menu} text", "x") for i in range(9)]
    rows += [("n1", "content", None, None, "x"), ("n2", "content", None, "", None), ("n3", "embed_text", "h1", "plain", "x"), ("long", "content", "h2", "<p>" + "word " * 200_000, "x")]
    df = spark.createDataFrame(rows, "record_id string, field_name string, host string, text string, hash string")
    out = {r["record_id"]: r for r in M.clean_texts(df).collect()}
    assert out["p3"]["clean"].strip() == "text 3" and out["p3"]["n_removed"] == 2 and out["p3"]["n_left"] == 0
    assert "home" in out["q1"]["clean"] and out["q1"]["n_removed"] == 0 and out["q1"]["n_left"] == 2
    assert "home" in out["o1"]["clean"]
    assert "n1" not in out and out["n2"]["clean"] == "" and out["n3"]["kinds"] == [] and out["long"]["kinds"]
    assert M.clean_texts(df.limit(0)).count() == 0


def test_a_planted_site_loses_its_templates_through_the_queries(spark, tmp_path):
    """Wiki, HTML and LaTeX boxes on every page of one document: found through them, clean without them."""
    from tessera.llm.queries_p1 import p1_clean, p1_found

    boxes = ["{{nav|home}}", "<footer><p>imprint</p></footer>", "\\begin{center}terms\\end{center}"]
    rows = [(f"{i:016x}", "site", "text", f"{boxes[i % 3]}\nbody {i}", f"body {i}") for i in range(18)] + [("f" * 16, "other", "text", f"{boxes[1]}\nbody", None)]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_type string, content string, embed_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    found = {tuple(r) for r in p1_found(spark, str(tmp_path)).collect()}
    assert found == {(r[0], "content") for r in rows}
    clean = {r["chunk_id"]: r for r in p1_clean(spark, str(tmp_path)).collect() if r["field_name"] == "content"}
    assert all(clean[f"{i:016x}"]["clean"] == f"body {i}" and clean[f"{i:016x}"]["n_removed"] > 0 for i in range(18))
    assert "imprint" in clean["f" * 16]["clean"]
