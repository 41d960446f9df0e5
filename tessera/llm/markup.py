"""Markup residue: clean text that still shows headings, lists, code blocks and formulas.

Method: site template removal. Each text is parsed into a tree of elements, of HTML, Markdown, wiki
and LaTeX syntax alike. Every block element's subtree is hashed, bottom-up from the hashes of its
children; Spark counts for each host on how many of its pages a subtree occurs; subtrees that recur
across many pages of the host are deleted from the tree, and what is left is written in plain
notation. A text is a case if its tree has an element, one deleted as a template or one left.

The notation of the result: "# " before a heading (as many signs as its level), "- " or a number
before a list item, two spaces more for each level of a list, code between ``` lines with its
language, formulas between dollar signs, table cells joined by " | ".

Defined results: a null text gives no row; an empty text and one without markup stay as they are;
damaged markup (an open tag, comment or link that never ends) is removed up to where its syntax ends.
Escaped signs (&lt;b&gt;) become the signs they stand for, which are text and no tag. Code and
formulas are copied as they are. Characters used literally (comparisons, prices, arithmetic, paths,
code names, angles, numbered citations) are no markup. Nesting may have any depth. Columns of the
input other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

# Element names of HTML and of references in wiki text.
ELEMENTS = (
    "a abbr article aside b blockquote body br button caption center cite code col colgroup dd del details div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main "
    "mark math meta nav noscript ol option p pre q ref references s script section select small span strike strong style sub "
    "summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video nowiki gallery big"
).split()
_NAMES = "|".join(sorted(ELEMENTS, key=len, reverse=True))
_VOID = {"br", "hr", "img", "input", "link", "meta", "col"}
# Elements that hold a part of a page; only these, templates, tables and environments can be a site's template.
_BLOCKS = set("article aside blockquote body button center details div dl figure footer form header iframe main nav noscript ol p section select table ul".split())
_BREAKS = set("p div h1 h2 h3 h4 h5 h6 section article table ul ol dl blockquote header footer nav figure main aside form body html details center".split())
# An element of these ends where the next one of its kind begins.
_SELF_ENDING = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_MATH_NAMES = "equation|align|gather|displaymath|eqnarray|multline|math"
_CODE_NAMES = "verbatim|lstlisting|minted"

# Texts without any of this need no parser.
SUSPECT = (
    r"[<>&\\`|\[\]{}~^$]|--|==|''|\*\S|\S\*|_\S[^\n]*_|(?m)^\s*(?:[-+*#>;!=]|\d{1,3}[.)])\s*\S"
)

_PATH = r"(?<![A-Za-z])[A-Za-z]:\\[^\s,;]*|\\\\[\w.-]++(?:\\[\w.-]++)++"
_LITERAL_PATH = re.compile(_PATH)
_INLINE = r"\$(?!\d[\d.,]*\s)(?=[^\s$])(?:(?=[^$\n]*[\\^_{])[^$\n]+|[A-Za-z])(?<=[^\s$])\$"

# Where an element begins, or a lone mark stands. Each kind's pattern; the first that fits at a place takes it.
_SYNTAX: dict[str, str] = {
    "md_front_matter": r"^---[ \t]*\n(?:[\w -]+:[^\n]*\n)+---[ \t]*$",
    "md_fence": r"^[ \t]*(?:```|~~~)[^\n]*",
    "html_comment": r"<!--|-->",
    "html_tag": rf"(?i:</?(?:{_NAMES})(?:\s[^<>]*+|/)?>|<!doctype[^>]*>)",
    "html_damaged": rf"(?i:<(?:{_NAMES})\s++[\w:-]++\s*+=(?:\s*+[\"']?[^\s<>\"']*+[\"']?)|</(?:{_NAMES})\b)",
    "html_entity": r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});",
    "wiki_template": r"\{\{|\}\}",
    "wiki_heading": r"^(?P<wh>={1,6})[ \t]*[^=\s][^=\n]*(?P=wh)[ \t]*$",
    "md_setext": r"^[^\n|>#;=*+-][^\n]*\S[ \t]*\n(?:={3,}|-{3,})[ \t]*$",
    "md_heading": r"^ {0,3}#{1,6}[ \t]+(?=\S)[^\n]*",
    "md_rule": r"^[ ]{0,3}(?:={3,}|-{3,}|\*{3,}|_{3,})[ \t]*$",
    "md_table": r"^(?:[ \t]*\|[^\n]*\|[ \t]*(?:\n|\Z))+|^[ \t]*+\|?+[ \t]*+:?-{3,}:?[ \t]*\|[-:| \t]*$",
    "wiki_table": r"^\{\|[^\n]*\n?|^\|\}|^\|-[^\n]*",
    "md_list": r"^[ \t]*[-*+][ \t]+(?!\d+[ \t]*-[ \t]*$)(?:\[[ xX]\][ \t]+(?=\S)|(?=\S))",
    "md_quote": r"^(?:>[ \t]?)+(?=\S)",
    "wiki_definition": r"^;[ \t]*\S[^\n]*?[ \t]:[ \t]",
    "md_footnote": r"^\[\^[^\[\]\n]+\]:[ \t]*|\[\^[^\[\]\n]+\]",
    "md_link": r"!?\[[^\[\]\n]*\]\([^()\s]*\)|(?<![\w\]])\[(?!\d+\])[^\[\]\n]+\]\[[^\[\]\n]*\]|^\[[^\[\]\n]+\]:[ \t]+\S+[ \t]*\n?",
    "wiki_link": r"(?<!\w)\[\[[^\[\]\n]*",
    "md_code": r"(?<!`)`[^`\n]+`(?!`)",
    "wiki_quotes": r"(?<![\d'])(?P<wq>'{2,5})(?=[^\s'])[^'\n]+'{2,5}",
    "wiki_magic": r"__[A-Z]{3,}__\n?",
    "md_emphasis": r"(?<![\w*])(?P<em>\*{1,3})(?=[^\s*])[^*\n]*?(?<=[^\s*])(?P=em)(?![\w*])|(?<!\w)(?P<eu>_{1,3})(?=[^\s_])[^_\n]*?(?<=[^\s_])(?P=eu)(?!\w)",
    "md_strike": r"~~(?=\S)[^~\n]+~~",
    "latex_math": rf"\$\$|\\[()\[\]]|{_INLINE}",
    "latex_command": r"~?(?<!\\)\\(?:cite[tp]?|ref|label|eqref|pageref|tag)\*?(?:\[[^\]]*\])?\{[^{}]*\}|(?<!\\)\\[A-Za-z]+",
    "latex_row": r"\\\\[ \t]*$",
}
# Marks that are no element by themselves.
_NEUTRAL = {"path": _PATH, "link_end": r"\]\]", "cell": r"(?<=[ \t])&[ \t]+", "escaped": r"\\[%&#_{}]", "brace": r"[{}]"}
_RULES = [(kind, re.compile(pattern, re.M)) for kind, pattern in _SYNTAX.items() if kind != "md_setext"]
_AT_SIGN = re.compile(
    r"(?:(?=[<&\\`\[\]{}~$*_!'-])|^|(?<![A-Za-z])(?=[A-Za-z]:\\))(?:"
    + "|".join(f"(?P<{kind}>{pattern})" for kind, pattern in ({"path": _PATH} | _SYNTAX | _NEUTRAL).items())
    + ")",
    re.M,
)
_NUMBERED = re.compile(r"^[ \t]*(\d{1,3})[.)][ \t]+\S", re.M)
_TEX_ROW = re.compile(r"^[^\n]*[ \t]&[ \t][^\n]*\\\\[ \t]*$", re.M)
_TEX_GROUP = re.compile(r"\*?(?:\[[^\]\n]*\])?\{")
_TEX_BEGIN = re.compile(r"(\{(\w+\*?)\}(?:\[[^\]\n]*\])?)(\{[^{}\n]*\})?")
_TEX_END = re.compile(r"(\{(\w+\*?)\})")
_TEX_LEVEL = {"\\chapter": 1, "\\section": 1, "\\subsection": 2, "\\subsubsection": 3, "\\paragraph": 4}
_WITH_COLUMNS = ("tabular", "tabularx", "longtable", "array", "minipage")
_TEX_LAYOUT = set("\\hline \\centering \\noindent \\maketitle \\newpage \\clearpage \\toprule \\midrule \\bottomrule \\smallskip \\medskip \\bigskip \\par \\newline".split())
_LISTS = {"ul", "ol", "itemize", "enumerate", "description"}


def has_markup(text: str) -> bool:
    """Whether a tree of the text would have any element: some element's pattern fits somewhere."""
    masked = _LITERAL_PATH.sub(" ", text) if "\\" in text else text
    return any(rule.search(masked) for _, rule in _RULES) or _is_numbered(masked)


def _is_numbered(text: str) -> bool:
    numbers = [int(m[1]) for m in _NUMBERED.finditer(text)]
    return 1 in numbers and any(b == a + 1 for a, b in zip(numbers, numbers[1:]))


class _Kept(str):
    """Code or a formula: copied as it is."""


class _Frame:
    """An open element: its output so far, and what its subtree is hashed from."""

    __slots__ = ("kind", "name", "start", "parts", "seen", "n", "number")

    def __init__(self, kind: str, name: str, start: int) -> None:
        self.kind, self.name, self.start = kind, name, start
        self.parts: list[str] = []
        self.seen: list[str] = []
        self.n = 0
        self.number = 0


def _joined(parts: list[str]) -> list[str]:
    """Neighbouring plain parts as one."""
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if isinstance(part, _Kept):
            if held:
                out.append("".join(held))
                held = []
            out.append(part)
        elif part:
            held.append(part)
    if held:
        out.append("".join(held))
    return out


class Tree:
    """The elements of one text in one pass, written in plain notation without the subtrees in ``drop``.

    ``subtrees`` has (start, end, hash, whether a block) of every closed element, inner ones first;
    ``left`` and ``removed`` count the elements, ``kinds`` names them.
    """

    def __init__(self, text: str, drop: frozenset[str] | set[str] = frozenset()) -> None:
        self.text = text = text.replace("\r\n", "\n")
        self.drop = drop
        self.subtrees: list[tuple[int, int, str, bool]] = []
        self.kinds: set[str] = set()
        self.removed = 0
        self.stack = [_Frame("root", "", 0)]
        self.floor = 1  # elements below it are not ended from within
        self._open_of: Counter = Counter()
        self._lists: list[_Frame] = []
        self._ends: dict = {}
        self._cell_end = self._group_end = -1
        rows = [m.span() for m in _TEX_ROW.finditer(text)] if "\\\\" in text and "&" in text else []
        self._row_starts, self._row_ends = [a for a, _ in rows], [b for _, b in rows]
        if _is_numbered(text):
            self.kinds.add("md_numbered")
            self.stack[0].n += 1
        self._read(0, len(text))
        self._unwind(1)

    @property
    def left(self) -> int:
        return self.stack[0].n

    def plain(self) -> str:
        parts = _joined(self.stack[0].parts)
        out = []
        for k, part in enumerate(parts):
            if not isinstance(part, _Kept):
                part = re.sub(r"(?<=\S)[ \t]{2,}(?=\S)", " ", part)
                part = re.sub(r"(?<![ \t])[ \t]++(?=\n)", "", part)
                part = re.sub(r"(?<=\n) (?=[^\s-])", "", part)
                part = re.sub(r"\n{3,}", "\n\n", part)
                if k == 0 and part[:1] == " " and part[1:2].strip():
                    part = part[1:]
                if k == len(parts) - 1:
                    part = part.rstrip(" \t")
            out.append(part)
        return "".join(out).strip("\n")

    # --- the stack

    def _put(self, plain: str, seen: str | None = None) -> None:
        top = self.stack[-1]
        top.parts.append(plain)
        top.seen.append(plain if seen is None else seen)

    def _open(self, kind: str, name: str, start: int, mark: str) -> _Frame:
        self.kinds.add(kind)
        frame = _Frame(kind, name, start)
        frame.seen.append(mark)
        self.stack.append(frame)
        self._open_of[kind] += 1
        self._open_of[kind, name] += 1
        if name in _LISTS:
            self._lists.append(frame)
        return frame

    def _pop(self) -> _Frame:
        frame = self.stack.pop()
        self._open_of[frame.kind] -= 1
        self._open_of[frame.kind, frame.name] -= 1
        if self._lists and self._lists[-1] is frame:
            self._lists.pop()
        return frame

    def _atom(self, kind: str, plain: str, mark: str) -> None:
        self.kinds.add(kind)
        self.stack[-1].n += 1
        self._put(plain, mark)

    def _close(self, end: int, block: bool, before: str = "", after: str = "", parts: list[str] | None = None) -> None:
        frame = self._pop()
        digest = hashlib.blake2b(" ".join([frame.kind, frame.name, *"".join(frame.seen).split()]).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        self.subtrees.append((frame.start, end, digest, block))
        top = self.stack[-1]
        top.seen.append(f"\0{digest}\0")
        if block and digest in self.drop:
            self.removed += frame.n + 1
            return
        top.n += frame.n + 1
        top.parts.extend(_joined([before, *(frame.parts if parts is None else parts), after]))

    def _unwind(self, depth: int) -> None:
        """Elements above ``depth`` never end: their marks go, what they hold stays."""
        base = self.stack[depth - 1]
        for frame in self.stack[depth:]:
            base.n += frame.n + (frame.name != "{")
            base.seen.extend(frame.seen)
            base.parts.extend(frame.parts)
        while len(self.stack) > depth:
            self._pop()

    def _within(self, kind: str, name: str, start: int, end: int, a: int, b: int, before: str = "", after: str = "", block: bool = False) -> None:
        """An element whose content is a to b."""
        floor, self.floor = self.floor, len(self.stack) + 1
        self._open(kind, name, start, "")
        self._read(a, b)
        self._unwind(self.floor)
        self.floor = floor
        self._close(end, block, before, after)

    def _kept(self, kind: str, start: int, end: int, plain: str, before: str = "", after: str = "", block: bool = False) -> int:
        self._open(kind, "", start, self.text[start:end])
        self._close(end, block, parts=[before, _Kept(plain), after])
        return end

    def _find(self, mark: str, start: int) -> int:
        """The next place of a mark, looked for once in the whole text."""
        at = self._ends.get(mark, -2)
        if at == -2 or -1 < at < start:
            at = self._ends[mark] = self.text.find(mark, start)
        return at

    def _search(self, pattern: str, start: int) -> tuple[int, int]:
        found = self._ends.get(pattern, (-2, -2))
        if found[0] == -2 or -1 < found[0] < start:
            m = re.compile(pattern, re.M | re.I).search(self.text, start)
            found = self._ends[pattern] = m.span() if m else (-1, -1)
        return found

    # --- reading

    def _read(self, at: int, end: int) -> None:
        text, stack = self.text, self.stack
        while at < end:
            m = _AT_SIGN.search(text, at, end)
            if m is None:
                break
            if m.start() > at:
                self._put(text[at : m.start()])
            kind = m.lastgroup
            at = _READERS[kind](self, m, end) if kind in _READERS else m.end()
        if at < end:
            self._put(text[at:end])

    def _path(self, m: re.Match, end: int) -> int:
        self.stack[-1].parts.append(_Kept(m[0]))
        self.stack[-1].seen.append(m[0])
        return m.end()

    def _front_matter(self, m: re.Match, end: int) -> int:
        title = re.search(r"^title:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", m[0], re.M)
        self._atom("md_front_matter", f"# {title[1]}\n" if title else "", m[0])
        return m.end()

    def _fence(self, m: re.Match, end: int) -> int:
        line = m[0].lstrip()
        mark, language = line[:3], line.lstrip("`~").strip()
        start, stop = self._search(rf"^[ \t]*{mark}[ \t]*$", m.end())
        if start < 0 or stop > end:
            start = stop = end
        body = self.text[m.end() : start].removeprefix("\n").rstrip("\n")
        return self._kept("md_fence", m.start(), stop, f"```{language}\n{body}\n```")

    def _comment(self, m: re.Match, end: int) -> int:
        stop = self._find("-->", m.end()) if m[0] == "<!--" else -1
        again = self._find("<!--", m.end()) if stop >= 0 else -1
        if 0 <= stop <= end - 3 and not 0 <= again < stop:
            self._open("html_comment", "", m.start(), self.text[m.start() : stop + 3])
            self._close(stop + 3, True, parts=[])
            return stop + 3
        self._atom("html_comment", "", m[0])
        return m.end()

    def _tag(self, m: re.Match, end: int) -> int:
        mark = m[0]
        name = re.match(r"</?([a-z0-9]+)|<!", mark, re.I)[1]
        if name is None:
            self._atom("html_tag", "", mark)
            return m.end()
        name = name.lower()
        if mark[1] == "/":
            return self._end_tag(name, m)
        if name in ("pre", "script", "style") and not mark.endswith("/>"):
            start, stop = self._search(rf"</{name}\s*>", m.end())
            if 0 <= start and stop <= end:
                if name == "pre":
                    body = re.sub(r"</?code\b[^<>]*>", "", self.text[m.end() : start], flags=re.I)
                    return self._kept("html_tag", m.start(), stop, "```\n" + html.unescape(body).strip("\n") + "\n```", "\n", "\n")
                self._open("html_tag", name, m.start(), self.text[m.start() : stop])
                self._close(stop, True, parts=[])
                return stop
        if mark.endswith("/>") or name in _VOID:
            self._atom("html_tag", "\n" if name in ("br", "hr") else "", mark)
            return m.end()
        ends = _SELF_ENDING.get(name)
        if ends:
            while self.stack[-1].kind == "html_tag" and self.stack[-1].name in ends:
                self._close_html(m.start())
        before = ""
        if name in ("td", "th") and self._cell_end >= 0 and not self.text[self._cell_end : m.start()].strip():
            while self.stack[-1].parts and not self.stack[-1].parts[-1].strip():
                self.stack[-1].parts.pop()
            before = " | "
        elif name == "li":
            lists = self._lists
            while self.stack[-1].parts and not self.stack[-1].parts[-1].strip() and "\n" not in self.stack[-1].parts[-1]:
                self.stack[-1].parts.pop()
            label = "- "
            if lists and lists[-1].name == "ol":
                lists[-1].number += 1
                label = f"{lists[-1].number}. "
            fresh = self.stack[-1].parts and self.stack[-1].parts[-1].endswith("\n")
            before = ("" if fresh else "\n") + _indent(len(lists) - 1) + label
        elif name[0] == "h" and name[1:].isdigit():
            before = "\n\n" + "#" * int(name[1:]) + " "
        elif name in ("ul", "ol") and self._open_of["html_tag", "li"]:
            before = "\n"
        elif name in _BREAKS:
            before = "\n\n"
        elif name in ("tr", "dt", "dd", "caption"):
            before = "\n"
        frame = self._open("html_tag", name, m.start(), mark)
        frame.parts.append(before)
        if name == "li":
            rest = re.compile(r"\s*").match(self.text, m.end(), end)
            return rest.end()
        return m.end()

    def _close_html(self, end: int) -> None:
        name = self.stack[-1].name
        if name == "ref":
            self._close(end, False, parts=[])
        else:
            after = "\n\n" if name in _BREAKS else "\n" if name in ("tr", "dt", "dd", "caption") else ""
            if name in ("ul", "ol") and self._open_of["html_tag", "li"]:
                after = "\n"
            self._close(end, name in _BLOCKS, after=after)
        if name in ("td", "th"):
            self._cell_end = end

    def _end_tag(self, name: str, m: re.Match) -> int:
        for k in range(len(self.stack) - 1, self.floor - 1, -1) if self._open_of["html_tag", name] else ():
            if self.stack[k].kind == "html_tag" and self.stack[k].name == name:
                while len(self.stack) > k + 1:
                    if self.stack[-1].kind == "html_tag" and self.stack[-1].name in _SELF_ENDING:
                        self._close_html(m.start())
                    else:
                        self._unwind(len(self.stack) - 1)
                self.stack[-1].seen.append(m[0])
                self._close_html(m.end())
                return m.end()
        self._atom("html_tag", "\n\n" if name in _BREAKS else "\n" if name in ("tr", "dt", "dd") else "", m[0])
        if name in ("td", "th"):
            self._cell_end = m.end()
        return m.end()

    def _damaged(self, m: re.Match, end: int) -> int:
        self._atom("html_damaged", "", m[0])
        return m.end()

    def _entity(self, m: re.Match, end: int) -> int:
        self._atom("html_entity", html.unescape(m[0]), m[0])
        return m.end()

    def _wiki_table(self, m: re.Match, end: int) -> int:
        if m[0].startswith("{|"):
            self._open("wiki_table", "", m.start(), m[0])
            return m.end()
        k = self._last("wiki_table")
        if m[0].startswith("|}"):
            if k:
                self._unwind(k + 1)
                self._close(m.end(), True, parts=[_table_rows("".join(self.stack[-1].parts))])
            else:
                self._atom("wiki_table", "", m[0])
        elif k:
            self._put(m[0])
        else:
            self._atom("wiki_table", "", m[0])
        return m.end()

    def _last(self, kind: str) -> int:
        if not self._open_of[kind]:
            return 0
        return next((k for k in range(len(self.stack) - 1, self.floor - 1, -1) if self.stack[k].kind == kind), 0)

    def _template(self, m: re.Match, end: int) -> int:
        if m[0] == "{{":
            self._open("wiki_template", "", m.start(), m[0])
            return m.end()
        k = self._last("wiki_template")
        if k:
            self._unwind(k + 1)
            values = "".join(self.stack[-1].parts).split("|")[1:]
            self._close(m.end(), True, parts=[" ".join(v.strip() for v in values if "=" not in v)])
        elif self._last("latex_group"):
            self._end_group(m.start() + 1)
            return m.start() + 1
        else:
            self._atom("wiki_template", "", m[0])
        return m.end()

    def _wiki_link(self, m: re.Match, end: int) -> int:
        self._open("wiki_link", "", m.start(), m[0])
        self.stack[-1].parts.append(m[0][2:])
        return m.end()

    def _link_end(self, m: re.Match, end: int) -> int:
        k = self._last("wiki_link")
        if not k:
            self._put(m[0])
            return m.end()
        self._unwind(k + 1)
        target = "".join(self.stack[-1].parts)
        kind, _, rest = target.partition(":")
        label = target.rpartition("|")[2]
        if kind.strip().lower() in ("category", "kategorie", "catégorie", "categoría"):
            label = ""
        elif kind.strip().lower() in ("file", "image") and "|" not in rest:
            label = ""
        self._close(m.end(), False, parts=[label])
        return m.end()

    def _wiki_quotes(self, m: re.Match, end: int) -> int:
        a, b = m.start() + len(m["wq"]), m.end()
        while self.text[b - 1] == "'":
            b -= 1
        self._within("wiki_quotes", "", m.start(), m.end(), a, b)
        return m.end()

    def _wiki_heading(self, m: re.Match, end: int) -> int:
        n = len(m["wh"])
        body = m[0].rstrip()
        a, b = m.start() + n, m.start() + len(body) - n
        self._within("wiki_heading", str(n), m.start(), m.end(), *self._trim(a, b), "#" * n + " ")
        return m.end()

    def _trim(self, a: int, b: int) -> tuple[int, int]:
        while a < b and self.text[a] in " \t":
            a += 1
        while b > a and self.text[b - 1] in " \t":
            b -= 1
        return a, b

    def _gone(self, m: re.Match, end: int) -> int:
        self._atom(m.lastgroup, "", m[0])
        return m.end()

    def _definition(self, m: re.Match, end: int) -> int:
        a, b = self._trim(m.start() + 1, m.end() - 3)
        self._within("wiki_definition", "", m.start(), m.end(), a, b, "- ", ": ")
        return m.end()

    def _heading(self, m: re.Match, end: int) -> int:
        mark = m[0].lstrip()
        n = len(mark) - len(mark.lstrip("#"))
        a = m.end() - len(mark) + n
        self._within("md_heading", str(n), m.start(), m.end(), *self._trim(a, m.end()), "#" * n + " ")
        return m.end()

    def _setext(self, m: re.Match, end: int) -> int:
        b = self.text.index("\n", m.start())
        n = 1 if self.text[b + 1] == "=" else 2
        self.kinds.add("md_rule")
        self._within("md_heading", str(n), m.start(), m.end(), *self._trim(m.start(), b), "#" * n + " ")
        return m.end()

    def _table(self, m: re.Match, end: int) -> int:
        if self._last("wiki_table"):
            self._put(self.text[m.start()])
            return m.start() + 1
        floor = self.floor
        self._open("md_table", "", m.start(), "")
        at, first = m.start(), True
        while at < m.end():
            stop = self.text.find("\n", at, m.end())
            stop = m.end() if stop < 0 else stop
            a, b = self._trim(at, stop)
            line = self.text[a:b]
            if not re.fullmatch(r"[-:| \t]*", line):
                if not first:
                    self._put("\n")
                first = False
                if line.startswith("|") and line.endswith("|") and len(line) > 1:
                    a, b = self._trim(a + 1, b - 1)
                self._within("md_row", "", at, stop, a, b)
            at = stop + 1
        self.floor = floor
        self._close(m.end(), True, after="\n" if m[0].endswith("\n") and not first else "")
        return m.end()

    def _item(self, m: re.Match, end: int) -> int:
        indent = m[0][: len(m[0]) - len(m[0].lstrip())].expandtabs(4)
        self._atom("md_list", _indent(len(indent) // 2) + "- ", m[0])
        return m.end()

    def _footnote(self, m: re.Match, end: int) -> int:
        self._atom("md_footnote", "- " if "]:" in m[0] else "", m[0])
        return m.end()

    def _link(self, m: re.Match, end: int) -> int:
        mark = m[0]
        if mark.startswith("[") and re.match(r"\[[^\[\]\n]+\]:[ \t]", mark):
            self._atom("md_link", "", mark)
            return m.end()
        a = m.start() + mark.index("[") + 1
        self._within("md_link", mark[mark.index("]") :], m.start(), m.end(), a, m.start() + mark.index("]"))
        return m.end()

    def _code(self, m: re.Match, end: int) -> int:
        return self._kept("md_code", m.start(), m.end(), m[0][1:-1])

    def _emphasis(self, m: re.Match, end: int) -> int:
        n = len(m["em"] or m["eu"])
        self._within("md_emphasis", "", m.start(), m.end(), m.start() + n, m.end() - n)
        return m.end()

    def _strike(self, m: re.Match, end: int) -> int:
        self._within("md_strike", "", m.start(), m.end(), m.start() + 2, m.end() - 2)
        return m.end()

    def _math(self, m: re.Match, end: int) -> int:
        mark = m[0]
        if len(mark) > 2 or mark[0] == "$" != mark[1:]:
            return self._kept("latex_math", m.start(), m.end(), mark)
        close = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}.get(mark)
        stop = self._find(close, m.end()) if close else -1
        if 0 <= stop <= end - 2:
            body = _formula(self.text[m.end() : stop])
            return self._kept("latex_math", m.start(), stop + 2, f"${body}$" if mark == "\\(" else f"$$ {body} $$")
        self._atom("latex_math", "", mark)
        return m.end()

    def _command(self, m: re.Match, end: int) -> int:
        mark = m[0]
        if mark.endswith("}"):
            self._atom("latex_command", "", mark)
            return m.end()
        if mark in ("\\begin", "\\end"):
            name = (_TEX_BEGIN if mark == "\\begin" else _TEX_END).match(self.text, m.end(), end)
            if name:
                return (self._begin if mark == "\\begin" else self._end)(m, name, end)
        if mark == "\\item":
            lists = self._lists
            label = "- "
            if lists and lists[-1].name in ("enumerate", "ol"):
                lists[-1].number += 1
                label = f"{lists[-1].number}. "
            self._atom("latex_command", _indent(len(lists) - 1) + label, mark)
            return re.compile(r"[ \t]*").match(self.text, m.end(), end).end()
        if mark in _TEX_LAYOUT:
            self._atom("latex_command", "", mark)
            return re.compile(r"[ \t]*\n?").match(self.text, m.end(), end).end()
        group = _TEX_GROUP.match(self.text, m.end(), end)
        if group:
            frame = self._open("latex_group", mark, m.start(), mark)
            self.kinds.add("latex_command")
            if mark in _TEX_LEVEL:
                frame.parts.append("#" * _TEX_LEVEL[mark] + " ")
            elif mark == "\\footnote":
                frame.parts.append(" (")
            return group.end()
        self._atom("latex_command", mark, mark)
        return m.end()

    def _begin(self, m: re.Match, name: re.Match, end: int) -> int:
        bare = name[2].rstrip("*")
        self.kinds.add("latex_command")
        if re.fullmatch(f"{_MATH_NAMES}|{_CODE_NAMES}", bare):
            close = f"\\end{{{name[2]}}}"
            stop = self._find(close, name.end(1))
            if 0 <= stop <= end - len(close):
                body = self.text[name.end(1) : stop]
                if re.fullmatch(_CODE_NAMES, bare):
                    return self._kept("latex_environment", m.start(), stop + len(close), "```\n" + body.strip("\n") + "\n```")
                return self._kept("latex_environment", m.start(), stop + len(close), f"$$ {_formula(body)} $$")
        self._open("latex_environment", name[2], m.start(), name[0])
        return name.end() if bare in _WITH_COLUMNS else name.end(1)

    def _end(self, m: re.Match, name: re.Match, end: int) -> int:
        for k in range(len(self.stack) - 1, self.floor - 1, -1) if self._open_of["latex_environment", name[2]] else ():
            if self.stack[k].kind == "latex_environment" and self.stack[k].name == name[2]:
                self._unwind(k + 1)
                self._close(name.end(), True)
                return name.end()
        self._atom("latex_command", "", m[0])
        return name.end()

    def _brace(self, m: re.Match, end: int) -> int:
        if m[0] == "{":
            follows = self._group_end == m.start()
            if follows or self._last("latex_group"):
                frame = self._open("latex_group", "" if follows else "{", m.start(), "{")
                frame.parts.append("" if follows else "{")
                return m.end()
        elif self._last("latex_group"):
            self._end_group(m.end())
            return m.end()
        self._put(m[0])
        return m.end()

    def _end_group(self, end: int) -> None:
        self._unwind(self._last("latex_group") + 1)
        name = self.stack[-1].name
        if name == "{":
            self.stack[-1].n -= 1
            self._close(end, False, after="}")
        else:
            self._close(end, False, after=")" if name == "\\footnote" else "")
            self._group_end = end

    def _cell(self, m: re.Match, end: int) -> int:
        k = bisect_right(self._row_starts, m.start()) - 1
        if k >= 0 and m.start() < self._row_ends[k] or any(self._open_of["latex_environment", n] for n in _WITH_COLUMNS):
            parts = self.stack[-1].parts
            if parts and not isinstance(parts[-1], _Kept):
                parts[-1] = parts[-1].rstrip(" \t")
            self._put(" | ", m[0])
        else:
            self._put(m[0])
        return m.end()

    def _escaped(self, m: re.Match, end: int) -> int:
        self._put(m[0][1:], m[0])
        return m.end()


def _indent(levels: int) -> str:
    """Two spaces for each level of a list, for 16 levels at most, so that no text grows with the square of its length."""
    return "  " * max(0, min(16, levels))


def _formula(body: str) -> str:
    return re.sub(r"\\(?:label|tag)\{[^{}]*\}", "", body).strip()


def _table_rows(body: str) -> str:
    rows = []
    for row in re.split(r"^\|-[^\n]*$", body, flags=re.M):
        cells = [c.strip() for c in re.split(r"\|\||!!|^[|!]", row, flags=re.M) if c.strip()]
        if cells:
            rows.append(" | ".join(cells))
    return "\n" + "\n".join(rows) + "\n"


_READERS = {
    "path": Tree._path, "md_front_matter": Tree._front_matter, "md_fence": Tree._fence, "html_comment": Tree._comment, "html_tag": Tree._tag,
    "html_damaged": Tree._damaged, "html_entity": Tree._entity, "wiki_table": Tree._wiki_table, "wiki_template": Tree._template,
    "wiki_heading": Tree._wiki_heading, "md_setext": Tree._setext, "md_heading": Tree._heading, "md_rule": Tree._gone, "md_table": Tree._table,
    "md_list": Tree._item, "md_quote": Tree._gone, "wiki_definition": Tree._definition, "md_footnote": Tree._footnote, "md_link": Tree._link,
    "wiki_link": Tree._wiki_link, "md_code": Tree._code, "wiki_quotes": Tree._wiki_quotes, "wiki_magic": Tree._gone, "md_emphasis": Tree._emphasis,
    "md_strike": Tree._strike, "latex_math": Tree._math, "latex_command": Tree._command, "latex_row": Tree._gone,
    "link_end": Tree._link_end, "cell": Tree._cell, "escaped": Tree._escaped, "brace": Tree._brace,
}


def kinds(text: str) -> list[str]:
    """Which kinds of elements the text's tree has."""
    return sorted(Tree(text).kinds) if has_markup(text) else []


def subtrees(text: str) -> list[tuple[int, int, str]]:
    """(start, end, hash) of every closed element, inner ones first."""
    return [(a, b, h) for a, b, h, _ in Tree(text).subtrees]


def clean(text: str, drop: frozenset[str] | set[str] = frozenset()) -> str:
    """Plain notation of a text, without the subtrees in ``drop``."""
    tree = Tree(text, drop)
    return tree.plain() if tree.left or tree.removed else text


# --- Spark ------------------------------------------------------------------------------------------------------------

_PARSED = "record_id string, field_name string, host string, text string, n_left int, kinds array<string>, hashes array<string>, clean string"
_CLEANED = "record_id string, field_name string, clean string, kinds array<string>, n_left int, n_removed int"


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for batch in batches:
        found, left, hashes, cleaned, source = [], [], [], [], []
        for text in batch.column(3).to_pylist():
            tree = Tree(text) if has_markup(text) else None
            blocks = sorted({h for _, _, h, block in tree.subtrees if block}) if tree else []
            left.append(tree.left if tree else 0)
            found.append(sorted(tree.kinds) if tree else [])
            hashes.append(blocks)
            cleaned.append(tree.plain() if tree and tree.left else text)
            source.append(text if blocks else None)
        columns = [pa.array(source, pa.string()), pa.array(left, pa.int32()), pa.array(found, strings), pa.array(hashes, strings), pa.array(cleaned, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=_names(_PARSED))


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of pages with templates are read again without these."""
    for batch in batches:
        plain, left, removed = [], [], []
        for text, drop, kept, n in zip(*(batch.column(c).to_pylist() for c in ("text", "drop", "clean", "n_left"))):
            tree = Tree(text, frozenset(drop)) if drop else None
            plain.append(tree.plain() if tree else kept)
            left.append(tree.left if tree else n)
            removed.append(tree.removed if tree else 0)
        columns = [pa.array(plain, pa.string()), batch.column("kinds"), pa.array(left, pa.int32()), pa.array(removed, pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("field_name"), *columns], names=_names(_CLEANED))


def template_subtrees(parsed: DataFrame, pages: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """(host, hash) of block subtrees on at least that many and that share of the host's pages.

    Each page counts once however often it was delivered; counts are combined before they are
    shuffled, so a host with a third of all pages is no hot group.
    """
    on_pages = parsed.select("host", "record_id", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count_distinct("record_id").alias("n"))
    all_pages = pages.groupBy("host").agg(F.count_distinct("record_id").alias("n_pages"))
    return (
        on_pages.where(F.col("n") >= least_pages)
        .join(all_pages, "host")
        .where(F.col("n") >= F.col("n_pages") * F.lit(least_share))
        .select("host", "hash")
    )


def clean_texts(texts: DataFrame, least_pages: int = 5, least_share: float = 0.2) -> DataFrame:
    """(record_id, field_name, clean, kinds, n_left, n_removed) of every text that is not null.

    ``texts`` has record_id (the page), field_name, host and text; a null host's pages belong to no
    site and keep all their elements. ``n_removed`` elements went with templates, ``n_left`` were
    written in plain notation. Only texts with a suspect character reach Python, the others are clean
    as they are.
    """
    texts = texts.select("record_id", "field_name", "host", "text").where(F.col("text").isNotNull())
    parsed = cut(texts.where(F.col("text").rlike(SUSPECT)).mapInArrow(_parse, _PARSED))
    templates = template_subtrees(parsed.where("host is not null"), texts.where("host is not null").select("host", "record_id"), least_pages, least_share)
    to_drop = (
        parsed.select("record_id", "field_name", "host", F.explode("hashes").alias("hash"))
        .join(templates, ["host", "hash"])
        .groupBy("record_id", "field_name")
        .agg(F.collect_set("hash").alias("drop"))
    )
    joined = parsed.join(to_drop, ["record_id", "field_name"], "left").select("record_id", "field_name", "text", "clean", "kinds", "n_left", "drop")
    plain = texts.where(~F.col("text").rlike(SUSPECT)).select(
        "record_id", "field_name", F.col("text").alias("clean"), F.array().cast("array<string>").alias("kinds"), F.lit(0).alias("n_left"), F.lit(0).alias("n_removed")
    )
    return plain.unionByName(joined.mapInArrow(_prune, _CLEANED))
