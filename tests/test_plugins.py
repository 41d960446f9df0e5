"""Plug-ins, settings and models with stand-ins; nothing here needs a network."""

import json
import os
import stat
import sys

import numpy as np
import pytest

from tessera.sources import plugins as P
from tessera.sources import settings as S
from tessera.sources import vision as V


def test_settings_are_kept_private_and_probed(tmp_path):
    older = tmp_path / "old.json"
    older.write_text(json.dumps({"embedding": {"url": "http://h", "model": "m", "enabled": True, "unknown": 1}}))
    path = tmp_path / "new" / "settings.json"
    settings = S.Settings(path, older)
    assert settings.get("embedding").enabled and older.exists() and stat.S_IMODE(os.stat(path).st_mode) == 0o600
    asked = []
    on = settings.enable(S.Setting("vision", "http://v", "m", key_variable="NO_SUCH_KEY", policy="tables_only"), asked.append)
    assert on.enabled and asked and not on.reads_figures() and settings.status()["vision"]["key_is_set"] is False
    assert not settings.disable("vision").enabled and settings.get("vision").url == "http://v"

    def fails(_):
        raise OSError("no answer")

    with pytest.raises(OSError):
        settings.enable(S.Setting("other", "http://v", "m"), fails)
    assert not settings.get("other").enabled
    for bad in (S.Setting("x"), S.Setting("x", "u", "m", policy="all")):
        with pytest.raises(ValueError):
            settings.enable(bad, asked.append)
    assert "engines" in S.describe(settings) and S.Settings(tmp_path / "none.json").status() == {}


def test_flags_have_three_states():
    assert S.tri_state(True, False, False) and not S.tri_state(False, True, True)
    assert S.tri_state(" ON ", False, False) and not S.tri_state("no", True, True)
    assert S.tri_state("auto", True, True) and not S.tri_state(None, True, False) and not S.tri_state("auto", False, True)


def test_answers_of_both_dialects():
    sent = []

    def send(url, request):
        sent.append((url, request))
        texts = request.get("input") or request["texts"]
        rows = [{"index": i, "embedding": [float(i), 1.0]} for i in range(len(texts))]
        return {"data": rows[::-1]} if "input" in request else {"vectors": [r["embedding"] for r in rows]}

    for dialect in ("indexed", "plain"):
        embed = S.remote_embedder(S.Setting("embedding", "http://h", "m", dialect=dialect), send, "query")
        assert np.array_equal(embed(["a", "b"]), np.array([[0, 1], [1, 1]], dtype=np.float32))
    assert sent[1][1]["type"] == "query"
    with pytest.raises(RuntimeError):
        S.remote_embedder(S.Setting("e", "u", "m"), lambda u, r: {"data": []})(["a"])
    with pytest.raises(ValueError):
        S.parse_vectors({}, "other")
    assert S.store_of("http://h/x/") == "http://h/x" and S.store_of("a/b").startswith("file:///") and S.store_of("a/b") is S.store_of("a/b")


def test_engines(tmp_path):
    script = "import sys, pathlib; p, out, first, last = sys.argv[1:]; pathlib.Path(out, 'sub').mkdir(); pathlib.Path(out, 'sub', 'x.md').write_text(f'{pathlib.Path(p).read_text()} {first}-{last}'); pathlib.Path(out, 'y.md').write_text('')"
    source = tmp_path / "a.txt"
    source.write_text("text")
    engine = P.CommandExtractor("command", [sys.executable, "-c", script, "{path}", "{out}", "{first}", "{last}"], 60)
    assert engine.is_available() and engine.extract(f"file:{source}", 0, 3) == "text 0-3"
    with pytest.raises(RuntimeError):
        P.CommandExtractor("bad", [sys.executable, "-c", "raise SystemExit(3)"]).extract(str(source), 0, 1)
    with pytest.raises(FileNotFoundError):
        P.CommandExtractor("bare", [sys.executable, "-c", "pass"]).extract(str(source), 0, 1)
    assert not P.CommandExtractor("none", ["no-such-command"]).is_available() and not P.ModuleExtractor("m", "no_such_module", lambda m, p: []).is_available()
    pages = P.ModuleExtractor("json", "json", lambda module, path: ["one", "two", "three"])
    pages.warm_up()
    assert pages.is_available() and pages.extract("x", 1, 2) == "two\fthree"
    assert P.page_count([{"page_idx": 0}, {"page_idx": 2}, {"page_idx": 0}, {}]) == 2
    box = (0.0, 0.0, 1.0, 1.0)
    assert P.detected_tables([(0, 0.9, box), (1, 0.6, box), (100, 0.9, box)]) == [(0, box)] and len(P.detected_tables([(p % 9, 0.8, box) for p in range(80)])) == 50


def test_timeouts():
    import time

    assert P.with_timeout(lambda: "x", 5) == "x"
    with pytest.raises(TimeoutError):
        P.with_timeout(lambda: time.sleep(5), 0.05)
    with pytest.raises(KeyError):
        P.with_timeout(lambda: {}["x"], 5)


def test_a_model_is_asked_again_and_paced():
    said, slept = iter([OSError(), "yes"]), []

    def model(prompt, image):
        answer = next(said)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert V.ask(model, "?", b"", sleep=slept.append) == "yes" and slept == [2.0]
    assert V.ask(lambda p, i: 1 / 0, "?", b"", sleep=slept.append) == ""
    now, waits = [0.0], []
    pacer = V.Pacer(0.5, lambda: now[0], waits.append)
    for _ in range(3):
        pacer.wait()
    assert waits == [0.5, 1.0]


def test_tables_read_again_only_with_the_right_numbers(spark):
    good = "<think>hm</think>```html\n<table><tr><td>12.5</td><td>7</td><td>30</td><td>41</td></tr></table>\n```"
    replies = {b"good": good, b"lost": "<table><tr><td>7</td></tr></table>", b"none": "no table", b"new": "<table><tr><td>12.5</td><td>7</td><td>30</td><td>41</td><td>99</td></tr></table>", b"weak": "<table><tr><td>12</td><td>99</td></tr></table>"}

    def model(prompt, image):
        if image == b"fails":
            raise OSError
        return "99" if prompt.startswith(V.VERIFY_PROMPT) else replies[image]

    text, layer = "| 12.5 | 7 | 30 | 41 |", "12.5 7 30 41"
    rows = [("d", n, "| 12 |" if name == b"weak" else text, "" if name == b"weak" else layer, "", name) for n, name in enumerate([*replies, b"fails"])]
    df = spark.createDataFrame(rows, "doc string, block long, text string, region string, context string, image binary")
    out = {r["block"]: (r["status"], r["html"]) for r in V.read_tables(df, model, ["doc", "block"]).collect()}
    assert [out[k][0] for k in range(6)] == ["replaced", "kept", "kept", "kept", "replaced", "kept"] and out[0][1].startswith("<table>") and out[1][1] is None
    assert {r["status"] for r in V.read_tables(df, None, ["doc", "block"]).collect()} == {"kept"}
    lines = spark.createDataFrame([("d", 0, text), ("d", 9, "![](a.png)"), ("d", 10, "after"), ("d", 11, "![](b.png)"), ("d", 12, "> **Figure 1:** there")], "doc string, line_no long, line string")
    images = spark.createDataFrame([("d", "a.png", b"x"), ("d", "b.png", b"x")], "doc string, ref string, image binary")
    told = {b"x": "A curve that rises to the right and ends.", b"good": good}
    asked = lambda prompt, image: told[bytes(image)]
    done = {r["line_no"]: r["line"] for r in V.arbitrate(lines, df.where("block = 0"), images, "doc", asked).collect()}
    assert done[0].startswith("<table>") and done[9] == "![](a.png)\n> **Figure:** A curve that rises to the right and ends." and done[11] == "![](b.png)" and len(done) == 5
    assert V.arbitrate(lines, df, images, "doc", None) is lines
    plain = {r["line_no"]: r["line"] for r in V.arbitrate(lines, df.where("block = 0"), images, "doc", asked, figures=False).collect()}
    assert plain[9] == "![](a.png)"


def test_files_of_any_case_and_no_folder(spark, tmp_path):
    from tessera.sources import documents as D

    for name in ("a.pdf", "b.PDF", "._c.pdf", "d.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert {r["path"][-5:] for r in D.scan_files(spark, str(tmp_path)).collect()} == {"a.pdf", "b.PDF"}
    with pytest.raises(Exception):
        D.scan_files(spark, str(tmp_path / "gone")).count()
