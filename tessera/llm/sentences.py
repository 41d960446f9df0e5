"""Sentence units of documents in many languages and scripts.

Some ends are certain: empty lines, heading lines, list items, the end of the text. Every other
full stop, question or exclamation mark, their like in other scripts, and every space between two
Thai letters is a candidate, which a maximum-entropy model accepts or not by features of its
neighbouring tokens: their case, length, digits and script, how the corpus uses them, and whether a
quotation or bracket is open. The statistics of tokens (how often one ends a paragraph, how often
one begins it) are counted over all documents. The model is trained on reliable boundaries: the last
token of a paragraph with the first of the next is a boundary; a stop after a token that never ends a
paragraph is none. Three kinds of candidates the layout says nothing about are labelled by rule: a
space between Thai letters is a boundary; a stop inside a quotation and one before a small letter
that never begins a paragraph are none. So the model repeats these rules, it did not find them. The
weights are a posterior: the prior's mean is a fixed vector of rounded weights, which decides where a
corpus has no example of a feature.

Fixed bound: the model is fitted on at most ``SAMPLE`` candidates, picked by hash. The ``KEPT`` most
frequent telling tokens of each kind (such as abbreviations) are known to every task; candidates
with other telling tokens are decided by a join with their counts, so all decisions use exact counts
of all documents. A token above 48 signs is known by its hash.

Defined results: null, empty and blank texts have no rows; ends are code points from the start of
the text, inclusive; a text without any stop is one unit per paragraph. Repeated rows repeat their
units. Columns other than key and text are not read.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

SAMPLE = 8_000
KEPT = 1 << 16

_STOPS = ".!?…。！？｡．।॥؟۔‥"
_CLOSERS = "\"'”’»)]}」』）》】〕›“"
_STOP = re.compile(f"[{_STOPS}]+")
_CANDIDATE = re.compile(
    rf"([{_STOPS}]+)((?:['”’»)\]}}」』）》】〕›]|[ \xa0\u202f\u2009]»|“(?=[\s,.;)]|\Z))*)"
    r"(?=(\"?)(\s*)([\"'“”‘’„«»(\[¿¡「『《（【‹›]{0,8})\s*([^\W\d_]+|\d+|\S|))"
)
_THAI_SPACE = re.compile("(?<=[\u0e00-\u0e7f]) +(?=[\u0e00-\u0e7f])")
_QUOTE = re.compile("[\"“”„«»‹›()\\[\\]「」『』（）《》]")
_OPENERS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "《": "》", "‹": "›", '"': '"'}
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_HEADING_MARK = re.compile(r"\s*#{1,6}[ \t]+\S")
_HEADING_NUMBER = regex.compile(r"\s*\d{1,3}(?:\.\d{1,3})+\.?[ \t]+(?=[\p{Lu}\p{Lo}])")
_ITEM = re.compile(r"\s*(?:[-*+•‣▪–]|\d{1,3}[.)]|[(]\d{1,3}[)]|[(]?[a-z][)])[ \t]+(?=\S)")
_LIST_NUMBER = re.compile(r"\s*(\d{1,3})[.)][ \t]")
_FIRST = re.compile(r"[\"'“”‘’„«»(\[¿¡「『《（【‹›]{0,8}\s*([^\W\d_]+|\d+|\S|)")
_LEAD = "\"'“”‘’„«»([¿¡「『《（"

# A candidate's code: class of the stop, case of the next token, and flags.
DOT, ELLIPSIS, QUESTION, WIDE, THAI = range(5)
GAP, QUOTED, CLOSED, OPENS, INITIAL, DIGIT, SHORT, SAYING = (1 << k for k in range(6, 14))


def units(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, open) of the certain units of a text: a heading line, a list item, a paragraph's rest.

    ``open`` is whether stops inside it may end sentences; headings and list items are one unit.
    """
    found: list[tuple[int, int, bool]] = []
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text) if m.end() > m.start()]
    start: int | None = None
    end = 0
    item = False

    def close() -> None:
        nonlocal start, item
        if start is not None:
            found.append((start, end, not item))
        start, item = None, False

    at_paragraph_start = True
    for k, (a, b) in enumerate(lines):
        line = text[a:b]
        body = line.strip()
        if not body:
            close()
            at_paragraph_start = True
            continue
        first, last = a + len(line) - len(line.lstrip()), a + len(line.rstrip())
        alone = at_paragraph_start and (k + 1 == len(lines) or not text[lines[k + 1][0] : lines[k + 1][1]].strip())
        if _HEADING_MARK.match(line) or (alone and _HEADING_NUMBER.match(line) and not _STOP.search(body[-1])):
            close()
            found.append((first, last, False))
            at_paragraph_start = False
            continue
        is_item = bool(_ITEM.match(line))
        if is_item and not at_paragraph_start and not item and start is not None:
            # inside a paragraph a wrapped line may begin like an item; a marked list follows an ended line
            before = text[start:a].rstrip()
            number = _LIST_NUMBER.match(line)
            is_item = before[-1:] in ".!?:…。！？：;।؟" and (number is None or number[1] == "1")
        if is_item and item:
            number = _LIST_NUMBER.match(line)
            previous = _LIST_NUMBER.match(text[start : start + 8]) if start is not None else None
            if number and previous and int(number[1]) != int(previous[1]) + 1:
                is_item = False
            elif bool(number) != bool(previous):
                is_item = False
        if is_item:
            close()
            start, end, item = first, last, True
        elif start is None:
            start, end = first, last
        else:
            end = last
        at_paragraph_start = False
    close()
    return found


def _quotations(text: str, start: int, end: int) -> tuple[list[int], list[int], set[int]]:
    """Starts and ends of the outermost quotations and brackets that close within the unit, and all closers' places."""
    starts, ends, closing = [], [], set()
    stack: list[tuple[str, int]] = []
    waited: dict[str, int] = {}
    for m in _QUOTE.finditer(text, start, end):
        c, at = m[0], m.start()
        if waited.get(c):
            while True:
                awaited, opened = stack.pop()
                waited[awaited] -= 1
                if awaited == c:
                    break
            while starts and starts[-1] > opened:  # within this one
                del starts[-1], ends[-1]
            starts.append(opened)
            ends.append(at)
            closing.add(at)
        elif c in _OPENERS:
            stack.append((_OPENERS[c], at))
            waited[_OPENERS[c]] = waited.get(_OPENERS[c], 0) + 1
    return starts, ends, closing


def _word_before(text: str, start: int, at: int, word: str) -> tuple[str, bool]:
    """The token before a stop, dotted initials as one, and whether it is an initial."""
    begin = at - len(word)
    if len(word) == 1 and word.isalpha():
        dotted = begin
        while dotted - 2 >= start and text[dotted - 1] == "." and text[dotted - 2].isalpha() and (dotted - 3 < start or not text[dotted - 3].isalpha()):
            dotted -= 2
        if dotted < begin:
            return text[dotted:at], True
        return word, word.isupper()
    return word.lstrip(_LEAD), False


def _case(token: str) -> int:
    """0 none, 1 small letter, 2 capital, 3 digit, 4 letter of a script without case, 5 other."""
    if not token:
        return 0
    c = token[0]
    return 3 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 4 if c.isalpha() else 5


def _stop_class(stop: str) -> int:
    if stop == ".":
        return DOT
    last = stop[-1]
    return QUESTION if last in "!?" else ELLIPSIS if last in ".…‥" else WIDE


def _code(kind: int, case: int, word: str, initial: bool, gap: bool, quoted: bool, closed: bool, opens: bool, next_token: str) -> int:
    return (
        kind
        | case << 3
        | (GAP if gap else 0)
        | (QUOTED if quoted else 0)
        | (CLOSED if closed else 0)
        | (OPENS if opens else 0)
        | (INITIAL if initial else 0)
        | (DIGIT if word[-1:].isdigit() else 0)
        | (SHORT if len(word) <= 5 else 0)
        | (SAYING if kind == WIDE and closed and next_token[:1] in ("と", "说", "説") else 0)
    )


def _normal(token: str) -> str:
    token = token.lower()
    return token if len(token) <= 48 else f"{token[0]}#{xxhash.xxh64_hexdigest(token.encode('utf-8', 'surrogatepass'))}"


def _last_word(text: str, start: int, end: int) -> str:
    """What stands between the last white space and ``end``."""
    word = text[max(text.rfind(" ", start, end) + 1, start) : end]
    if word and not word.isalnum():
        parts = word.split()
        word = parts[-1] if parts and not word[-1].isspace() else ""
    return word


def candidates(text: str, start: int, end: int) -> list[tuple[int, int, str, str]]:
    """(end, code, token before, token after) of the uncertain ends within one unit."""
    out = []
    starts: list[int] = []
    ends: list[int] = []
    closing: set[int] = set()
    if _QUOTE.search(text, start, end):
        starts, ends, closing = _quotations(text, start, end)

    def inside(at: int) -> bool:
        k = bisect_left(starts, at)
        return k > 0 and at < ends[k - 1]

    behind = start  # tokens end at stops, so none begins before the last one
    for m in _CANDIDATE.finditer(text, start, end):
        stop, closers, quote, space, opener, token = m.groups()
        a, after, low, behind = m.start(), m.end(), behind, m.end(1)
        closed = bool(closers)
        if quote:
            if after in closing:
                after += 1
                closed = True
            else:
                opener = quote + opener
        if after >= end:
            continue  # the unit's own end
        follows = text[after]
        if follows in ",;:،؛、，；：" or follows in _STOPS:
            continue
        if stop == "." and not space and not closed and (token[:1].isdigit() or token[:1].islower() or token[:1] in "/_"):
            continue  # inside a number, a file name or an address
        word, initial = _word_before(text, start, a, _last_word(text, low, a))
        kind = _stop_class(stop)
        code = _code(kind, _case(token), word, initial, bool(space), bool(starts) and inside(a) and not closed, closed, opener[:1] in _OPENERS or opener[:1] in ("¿", "¡"), token)
        out.append((after, code, _normal(word) if kind == DOT and not code & DIGIT else "", _normal(token) if kind < WIDE else ""))
    if _THAI_SPACE.search(text, start, end):
        out.extend((m.start(), THAI | GAP, "", "") for m in _THAI_SPACE.finditer(text, start, end) if not inside(m.start()))
    return out


def _turn(text: str, start: int, end: int) -> tuple[str, int, bool, bool] | None:
    """How a paragraph ends: token, class of its stop, whether an initial, whether closed by a quote or bracket."""
    tail = _last_word(text, start, end)
    bare = tail.rstrip(_CLOSERS)
    rest = bare.rstrip(_STOPS)
    if len(rest) == len(bare) or end - start <= len(bare):
        return None
    word, initial = _word_before(rest, 0, len(rest), rest[max(map(rest.rfind, _STOPS)) + 1 :])
    return word, _stop_class(bare[len(rest) :]), initial, len(bare) < len(tail)


_ROW = "doc_id {key}, ends array<int>, c_end array<int>, c_code array<int>, c_prev array<string>, c_next array<string>, role string, token string, code int, n array<long>"


def _extract(key_type: pa.DataType, sample: int):
    """One row for each document, then this task's counts of tokens and its share of the sample."""
    ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
    types = [key_type, ints, ints, ints, strings, strings, pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
    names = ["doc_id", "ends", "c_end", "c_code", "c_prev", "c_next", "role", "token", "code", "n"]

    def batch_of(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[str, list[int]] = {}
        after: dict[str, list[int]] = {}
        drawn: list[tuple[int, int, int, str, str]] = []

        def note(base: int, at: int, code: int, word: str, token: str, turn: int) -> None:
            if code & 7 == DOT and not code & DIGIT:
                counts = before.setdefault(word, [0, 0, 0])
                counts[0] += 1
                counts[1] += turn
                counts[2] += not turn and (code >> 3) & 7 in (1, 3)
            if code & 7 < WIDE:
                counts = after.setdefault(token, [0, 0])
                counts[0] += 1
                counts[1] += turn
            h = -(((base ^ at) * 0x9E3779B1 + turn) & 0xFFFFFFFF)
            if len(drawn) < sample:
                heapq.heappush(drawn, (h, turn, code, word, token))
            elif h > drawn[0][0]:
                heapq.heapreplace(drawn, (h, turn, code, word, token))

        def flush() -> Iterator[pa.RecordBatch]:
            for role, counted in (("prev", before), ("next", after)):
                if counted:
                    yield batch_of({"role": [role] * len(counted), "token": list(counted), "n": list(counted.values())}, len(counted))
                    counted.clear()

        for batch in batches:
            rows: dict[str, list] = {c: [] for c in names[:6]}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends: list[int] = []
                found: list[tuple[int, int, str, str]] = []
                last = None
                base = xxhash.xxh32_intdigest(str(key))
                for start, end, is_open in units(text):
                    ends.append(end)
                    if not is_open:
                        last = None
                        continue
                    if last is not None:
                        token = _FIRST.match(text, start, end)[1]
                        opens = text[start] in _OPENERS or text[start] in "¿¡"
                        word, kind, initial, closed = last
                        code = _code(kind, _case(token), word, initial, True, False, closed, opens, token)
                        note(base, start, code, _normal(word) if kind == DOT and not code & DIGIT else "", _normal(token) if kind < WIDE else "", 1)
                    here = candidates(text, start, end)
                    for at, code, word, token in here:
                        note(base, at, code, word, token, 0)
                    found.extend(here)
                    last = _turn(text, start, end)
                for column, value in zip(rows.values(), (key, ends, *([f[i] for f in found] for i in range(4)))):
                    column.append(value)
            yield batch_of(rows, batch.num_rows)
            if len(before) + len(after) > 300_000:
                yield from flush()
        yield from flush()
        if drawn:
            yield batch_of(
                {"role": ["sample"] * len(drawn), "token": [f"{d[3]}\t{d[4]}" for d in drawn], "code": [d[2] for d in drawn], "n": [[-d[0], d[1]] for d in drawn]}, len(drawn)
            )

    return run


# --- features and model ----------------------------------------------------------------------------------------------

FEATURES = [
    "bias", "full_stop", "ellipsis", "question", "wide_stop", "thai", "gap", "no_gap_capital", "no_gap_other", "quoted", "closed", "closed_small", "small_next", "capital_next",
    "digit_after_gap", "digit_at_once", "caseless_next", "other_next", "opens", "digit_before", "saying_after",
    "initial_never_final", "short_never_final", "long_never_final", "final_share", "goes_on", "small_first", "digit_never_first",
]
N_STATIC = FEATURES.index("saying_after") + 1
# The prior's mean: rounded from a fitted model.
PRIOR = np.array(
    [0.5, -1.0, -1.4, 0.2, 1.3, 1.4, 1.3, 0.0, 0.0, -5.1, -0.3, -1.2, -2.4, 0.4, -0.9, 0.0, 0.6, 0.0, 0.7, 0.3, 0.0, -0.3, -4.8, -1.0, 2.5, -1.2, 0.7, -2.4]
)


def static_features(code: int) -> np.ndarray:
    kind, case = code & 7, (code >> 3) & 7
    latin = kind < WIDE
    gap, closed = bool(code & GAP), bool(code & CLOSED)
    return np.array(
        [
            1, kind == DOT, kind == ELLIPSIS, kind == QUESTION, kind == WIDE, kind == THAI, gap,
            not gap and latin and case == 2 and not code & INITIAL, not gap and latin and case != 2, bool(code & QUOTED), closed, closed and case in (1, 5),
            latin and case == 1, latin and case == 2, latin and case == 3 and gap, latin and case == 3 and not gap, latin and case == 4, latin and case == 5,
            bool(code & OPENS), kind == DOT and bool(code & DIGIT), bool(code & SAYING),
        ],
        dtype=float,
    )


class Tokens:
    """What the corpus says about telling tokens: counts before a stop, first small words, words that never come first."""

    def __init__(self, before: dict[str, tuple[int, int, int]], small_first: dict[str, tuple[int, int]], never_first: dict[str, int]) -> None:
        self.before, self.small_first, self.never_first = before, small_first, never_first

    def features(self, code: int, word: str, token: str) -> tuple[float, ...]:
        kind, case = code & 7, (code >> 3) & 7
        initial = short = long = share = on = small = never = 0.0
        if kind == DOT and not code & DIGIT:
            known = self.before.get(word)
            share = 1.0
            if known:
                n, turns, smalls = known
                share, on = min(1.0, 4 * turns / n), smalls / n
                if not turns:
                    often = min(1.0, n / 40)
                    if code & INITIAL:
                        initial = 1.0
                    if code & SHORT:
                        short = often
                    else:
                        long = often
            elif code & INITIAL:
                initial, share = 1.0, 0.0
        if kind < WIDE and case == 1 and code & GAP and token in self.small_first:
            small = 1.0
        if kind == DOT and code & DIGIT and case == 2:
            never = min(1.0, self.never_first.get(token, 0) / 40)
        return initial, short, long, share, on, small, never

    def is_no_end(self, code: int, word: str, token: str) -> bool:
        """Reliably no boundary."""
        kind, case = code & 7, (code >> 3) & 7
        if code & QUOTED or kind < WIDE and case == 1 and token not in self.small_first:
            return True
        if kind != DOT:
            return False
        if code & DIGIT:
            return case == 2 and self.never_first.get(token, 0) >= 20
        n, turns, _ = self.before.get(word, (0, 0, 0))
        return n >= 40 and not turns


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Maximum-entropy weights (two classes) by Newton's method, with a weak normal prior around ``prior``."""
    w = prior.copy()
    if not len(y):
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * (w - prior)
        curvature = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


_TELLING = {
    "before": "role = 'prev' and n0 >= 2 and (n1 * 10 < n0 or n2 > 0)",
    "first": "role = 'next' and small and n1 * 20 > n0",
    "never": "role = 'next' and small and n1 = 0 and n0 >= 2",
}


def _as_tokens(rows: dict[str, list]) -> Tokens:
    return Tokens(
        {r["token"]: (r["n0"], r["n1"], r["n2"]) for r in rows["before"]}, {r["token"]: (r["n0"], r["n1"]) for r in rows["first"]}, {r["token"]: r["n0"] for r in rows["never"]}
    )


def _counts(rows: DataFrame) -> DataFrame:
    """(role, token, n0, n1, n2, small): how often each token stood there, at a paragraph's turn, before a small letter."""
    counts = rows.where("role in ('prev', 'next')").groupBy("role", "token").agg(*(F.sum(F.get("n", F.lit(k))).alias(f"n{k}") for k in range(3)))
    first = F.substring("token", 1, 1)
    return cut(counts.withColumn("small", F.lower(first) != F.upper(first)))


def _known(counts: DataFrame, kept: int) -> tuple[Tokens, DataFrame | None]:
    """The most frequent telling tokens of each kind, and a table (kind, token, n0, n1, n2) of all others, if there are any."""
    found: dict[str, list] = {}
    rest = []
    for kind, telling in _TELLING.items():
        top = counts.where(telling).orderBy(F.desc("n0"), "token").limit(kept + 1).collect()
        found[kind] = top[:kept]
        if len(top) > kept:
            n, token = top[kept]["n0"], top[kept]["token"]
            behind = (F.col("n0") < n) | ((F.col("n0") == n) & (F.col("token") >= token))
            rest.append(counts.where(telling).where(behind).select(F.lit(kind).alias("kind"), "token", "n0", "n1", "n2"))
    return _as_tokens(found), reduce(DataFrame.unionByName, rest) if rest else None


def _train(rows: DataFrame, counts: DataFrame, sample: int) -> np.ndarray:
    """Weights fitted on the sample's reliable candidates, with the exact counts of their tokens."""
    drawn = rows.where("role = 'sample'").orderBy(F.col("n")[0], "token", "code").select("code", "token", F.col("n")[1].alias("turn")).limit(sample).collect()
    parted = [(code, *pair.partition("\t")[::2], turn) for code, pair, turn in drawn]
    wanted = rows.sparkSession.createDataFrame(sorted({("prev", p[1]) for p in parted} | {("next", p[2]) for p in parted}), "role string, token string")
    telling = counts.join(F.broadcast(wanted), ["role", "token"], "left_semi")  # two tokens of a sampled candidate at most
    tokens = _as_tokens({kind: telling.where(condition).collect() for kind, condition in _TELLING.items()})
    x, y = [], []
    for code, word, token, turn in parted:
        if turn or code & 7 == THAI or tokens.is_no_end(code, word, token):
            x.append(np.concatenate((static_features(code), tokens.features(code, word, token))))
            y.append(float(bool(turn) or code & 7 == THAI))
    return fit(np.array(x).reshape(len(x), len(FEATURES)), np.array(y), PRIOR)


REST_BITS = 1 << 24  # a filter of fixed size; it only spares candidates the join


def _bit(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) % REST_BITS


def _bits_of(rest: DataFrame) -> bytes:
    """Filter of the tokens beyond the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_bit(t) for t in batch.column(0).to_pylist()], pa.int64())], names=["bit"])

    words = rest.select("token").mapInArrow(run, "bit long").groupBy(F.floor(F.col("bit") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("held"))
    held = np.zeros(REST_BITS // 32, dtype=np.uint32)
    for word, bits in words.toLocalIterator():
        held[word] = bits
    return held.tobytes()


def _score(tokens: Tokens, weights: np.ndarray, code: int, word: str, token: str) -> float:
    return float(static_features(code) @ weights[:N_STATIC]) + float(np.array(tokens.features(code, word, token)) @ weights[N_STATIC:])


_OPEN = ("doc_id", "sent_end", "code", "word", "token")


def _decide(model):
    """(doc_id, sent_end) of all ends; with a filter of other telling tokens also the candidates that need these (code not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, weights, others = model.value
        # the score is a sum over (code), (code, token before) and (code, token after); each part is worked out once
        static: dict[int, float] = {}
        by_word: dict[tuple[int, str], float] = {}
        by_token: dict[tuple[int, str], float] = {}
        dynamic = weights[N_STATIC:]
        asked: dict[str, bool] = {}

        def part(known: dict, code: int, word: str, token: str, picked: slice) -> float:
            if len(known) > 200_000:
                known.clear()
            return float(np.array(tokens.features(code, word, token)[picked]) @ dynamic[picked])

        def is_other(token: str) -> bool:
            found = asked.get(token)
            if found is None:
                if len(asked) > 200_000:
                    asked.clear()
                bit = _bit(token)
                found = asked[token] = bool(others[bit >> 3] >> (bit & 7) & 1)
            return found

        for batch in batches:
            lists = []
            undecided: list[tuple] = []
            for key, ends, at, codes, words, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ends", "c_end", "c_code", "c_prev", "c_next"))):
                kept = list(ends)
                for end, code, word, token in zip(at, codes, words, following):
                    if others is not None and (word and is_other(word) or token and is_other(token)):
                        undecided.append((key, end, code, word, token))
                        continue
                    score = static.get(code)
                    if score is None:
                        score = static[code] = float(static_features(code) @ weights[:N_STATIC])
                    if word or code & 7 == DOT:
                        more = by_word.get((code, word))
                        if more is None:
                            more = by_word[code, word] = part(by_word, code, word, "", slice(0, 5))
                        score += more
                    if token:
                        more = by_token.get((code, token))
                        if more is None:
                            more = by_token[code, token] = part(by_token, code, "", token, slice(5, 7))
                        score += more
                    if score > 0:
                        kept.append(end)
                lists.append(kept)
            counts = np.array([len(x) for x in lists], dtype=np.int64)
            keys = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(lists)), counts)))
            columns = [keys, pa.array(list(chain.from_iterable(lists)), pa.int64())]
            if others is None:
                yield pa.RecordBatch.from_arrays(columns, names=_OPEN[:2])
                continue
            types = (keys.type, pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(keys), t) for t in types[2:])], names=_OPEN)
            if undecided:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*undecided), types)], names=_OPEN)

    return run


def _decide_open(model):
    """The same for candidates that came with the counts of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, _ = model.value
        for batch in batches:
            keep = []
            for code, word, token, before, first, never in zip(*(batch.column(c).to_pylist() for c in ("code", "word", "token", "before", "first", "never"))):
                tokens = Tokens(
                    {word: tuple(before.values())} if before else {word: known.before[word]} if word in known.before else {},
                    {token: (0, 0)} if first or token in known.small_first else {},
                    {token: never["n0"] if never else known.never_first.get(token, 0)},
                )
                keep.append(_score(tokens, weights, code, word, token) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sent_end")], names=_OPEN[:2]).filter(pa.array(keep, pa.bool_()))

    return run


def sentence_ends(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, kept: int = KEPT) -> DataFrame:
    """(key, sent_end) of every sentence unit of every document."""
    spark = documents.sparkSession
    narrow = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    whole = narrow.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    kind, arrow_kind = ("long", pa.int64()) if whole else ("string", pa.string())
    narrow = narrow.withColumn("doc_id", F.col("doc_id").cast(kind))
    rows = cut(narrow.mapInArrow(_extract(arrow_kind, sample), _ROW.format(key=kind)))
    counts = _counts(rows)
    tokens, rest = _known(counts, kept)
    weights = _train(rows, counts, sample)
    model = spark.sparkContext.broadcast((tokens, weights, _bits_of(rest) if rest is not None else None))
    found = rows.where("role is null").select("doc_id", "ends", "c_end", "c_code", "c_prev", "c_next")
    short = f"doc_id {kind}, sent_end long"
    if rest is None:
        return found.mapInArrow(_decide(model), short).withColumnRenamed("doc_id", key)
    every = cut(found.mapInArrow(_decide(model), f"{short}, code int, word string, token string"))
    undecided = every.where("code is not null")
    for name, by in (("before", "word"), ("first", "token"), ("never", "token")):
        told = rest.where(F.col("kind") == name).select(F.col("token").alias(by), F.struct("n0", "n1", "n2").alias(name))
        undecided = undecided.join(told, by, "left")
    decided = undecided.select("doc_id", "sent_end", "code", "word", "token", "before", "first", "never").mapInArrow(_decide_open(model), short)
    return every.where("code is null").select("doc_id", "sent_end").unionByName(decided).withColumnRenamed("doc_id", key)
