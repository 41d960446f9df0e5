"""Splitting oversized items at natural boundaries by packing a structure tree.

The text of an item is seen as a tree: heading sections (nested by level), blocks between blank
lines, lines (list items, table rows, code lines), sentences, words, code points. Sibling subtrees
are merged bottom-up while they stay under the limit; only a node that is too large itself is
descended into. Sizes are estimated tokens: code points in the CJK ranges plus a quarter of all
others, and in tables each tag counts as one space.

Defined results: null and empty content give no piece; an item within the limit gives one piece,
its whole content; pieces' cores, put together, are the content again; a tag of a table is never
cut. Input columns other than the named ones are ignored, so clashing names do no harm; rows that
are repeated give their pieces again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.textops import estimate_tokens

CAP = 768
OVERLAP = 48

_HEADING = re.compile(r"^(#{1,6})[ \t]+\S.*$", re.M)
_BLANK = re.compile(r"\n[ \t\r]*\n\s*")
_ROW_END = re.compile(r"</tr>\s*|\n+", re.I)
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？।؟])[」』”’）》]*\s*")
_SPACE = re.compile(r"\s+")
_TAG = re.compile(r"<[^>]+>")


class Sizes:
    """Estimated tokens of any span of one text in constant time."""

    def __init__(self, text: str, table: bool) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cjk = (
            ((points >= 0x4E00) & (points <= 0x9FFF))
            | ((points >= 0x3400) & (points <= 0x4DBF))
            | ((points >= 0x3000) & (points <= 0x30FF))
            | ((points >= 0xF900) & (points <= 0xFAFF))
        )
        other = ~cjk
        self.tags: list[tuple[int, int]] = []
        if table:
            self.tags = [m.span() for m in _TAG.finditer(text)]
            for start, end in self.tags:
                cjk[start:end] = False
                other[start:end] = False
                other[start] = True
        self.cjk = np.concatenate(([0], np.cumsum(cjk)))
        self.other = np.concatenate(([0], np.cumsum(other)))
        self._tag_starts = np.array([s for s, _ in self.tags], dtype=np.int64)

    def estimate(self, start: int, end: int) -> int:
        return int(self.cjk[end] - self.cjk[start] + (self.other[end] - self.other[start]) // 4)

    def tag_around(self, position: int) -> tuple[int, int] | None:
        """The tag that a cut at this position would cut."""
        k = int(np.searchsorted(self._tag_starts, position, side="right")) - 1
        return self.tags[k] if k >= 0 and self.tags[k][0] < position < self.tags[k][1] else None

    def inside_tag(self, position: int) -> bool:
        return self.tag_around(position) is not None


def _cuts(pattern: re.Pattern, text: str, start: int, end: int) -> list[int]:
    return [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]


def _sections(text: str, start: int, end: int, level: int) -> list[int]:
    return [m.start() for m in _HEADING.finditer(text, start, end) if len(m[1]) <= level and start < m.start() < end]


def _children(text: str, sizes: Sizes, start: int, end: int, level: int) -> list[tuple[int, int]]:
    """The subtrees of a node at a level of the tree: 1 to 6 heading sections, then ever smaller units; none begins inside a tag."""
    if level <= 6:
        cuts = _sections(text, start, end, level)
    else:
        cuts = _cuts((_BLANK, _ROW_END, _SENTENCE_END, _SPACE)[level - 7], text, start, end)
    edges = [start, *(c for c in cuts if not sizes.inside_tag(c)), end]
    return list(zip(edges, edges[1:]))


def pack(text: str, sizes: Sizes, limit: int, start: int = 0, end: int | None = None, level: int = 1) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` estimated tokens that cover the text, siblings merged."""
    end = len(text) if end is None else end
    if sizes.estimate(start, end) <= limit:
        return [(start, end)]
    children: list[tuple[int, int]] = []
    while level <= 10:
        children = _children(text, sizes, start, end, level)
        level += 1
        if len(children) > 1:
            break
    if len(children) <= 1:
        return _by_code_points(sizes, limit, start, end)
    merged: list[tuple[int, int]] = []
    for a, b in children:
        if sizes.estimate(a, b) > limit:
            merged.extend(pack(text, sizes, limit, a, b, level))
        elif merged and sizes.estimate(merged[-1][0], b) <= limit:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def _by_code_points(sizes: Sizes, limit: int, start: int, end: int) -> list[tuple[int, int]]:
    spans = []
    while start < end:
        low, high = start + 1, end
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sizes.estimate(start, middle) <= limit else (low, middle - 1)
        if low < end:
            tag = sizes.tag_around(low)
            if tag is not None:  # before the tag, or behind it if nothing is before: a tag counts as one sign only
                low = tag[0] if tag[0] > start else tag[1]
        spans.append((start, low))
        start = low
    return spans


def overlap_start(text: str, sizes: Sizes, start: int, overlap: int) -> int:
    """Where the overlap before ``start`` begins: the farthest line, else sentence, else word within the budget."""
    if overlap <= 0 or start == 0:
        return start
    low = max(0, start - 4 * overlap - 4 - sum(b - a for a, b in sizes.tags if a < start and b > start - 4 * overlap))
    for pattern in (_ROW_END, _SENTENCE_END, _SPACE):
        for cut in _cuts(pattern, text, low, start):
            if sizes.estimate(cut, start) <= overlap and not sizes.inside_tag(cut):
                return cut
    cut = start
    while cut > low and sizes.estimate(cut - 1, start) <= overlap and not sizes.inside_tag(cut - 1):
        cut -= 1
    return cut


def split_text(text: str, table: bool = False, cap: int = CAP, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(overlap start, core start, core end) of each piece; one piece if the text is within the cap."""
    if not text:
        return []
    sizes = Sizes(text, table)
    if sizes.estimate(0, len(text)) <= cap:
        return [(0, 0, len(text))]
    spans = pack(text, sizes, max(1, cap - overlap - 1))
    return [(overlap_start(text, sizes, a, overlap), a, b) for a, b in spans]


SCHEMA = (
    "chunk_id string, piece_no int, n_pieces int, chunk_type string, heading_path array<string>, "
    "overlap_start int, start int, end int, content string, token_est int"
)


def _pieces(cap: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            columns = batch.to_pydict()
            for key, kind, path, text in zip(columns["chunk_id"], columns["chunk_type"], columns["heading_path"], columns["content"]):
                table = kind == "table"
                pieces = split_text(text or "", table, cap, overlap)
                for k, (from_, start, end) in enumerate(pieces):
                    piece = text[from_:end]
                    row = (key, k, len(pieces), kind, path, from_, start, end, piece, Sizes(piece, table).estimate(0, len(piece)))
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column, type)
                    for column, type in zip(
                        out,
                        (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()),
                    )
                ],
                names=["chunk_id", "piece_no", "n_pieces", "chunk_type", "heading_path", "overlap_start", "start", "end", "content", "token_est"],
            )

    return run


def token_estimate(content: Column, chunk_type: Column) -> Column:
    return estimate_tokens(content, strip_tags=F.coalesce(chunk_type, F.lit("")) == "table")


def split_oversized(chunks: DataFrame, cap: int = CAP, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk above ``cap`` estimated tokens; chunks within it are not returned.

    ``overlap`` is at most that many estimated tokens of text before a piece's core, repeated at its start.
    The filter runs in the JVM (an estimate is never above the length), only oversized texts reach Python.
    """
    narrow = chunks.select("chunk_id", "chunk_type", "heading_path", "content").where(F.length("content") > cap)
    oversized = narrow.where(token_estimate(F.col("content"), F.col("chunk_type")) > cap)
    return oversized.mapInArrow(_pieces(cap, overlap), SCHEMA)
