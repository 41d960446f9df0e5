"""Repair of text from scanned pages into continuous paragraphs.

Lines: a running header is a line inside the text that repeats the document's title: by itself, set
apart by a wide gap or a bar, within a line of at most 40 signs more (titles of at least four signs),
or within a line of any length that stands alone at a page break and ends like no sentence. A page
number is a line with nothing else; a word broken at a line end is joined, across headers and page
numbers too. Words: a symmetric-delete index over the corpus lexicon (words folded to the shape of
their letters, with every deletion of one sign) proposes for each rare form the words it may have
been; a weighted edit distance in which a pair of similar shapes costs little decides, with the
counts of both. Which of several words it was, the neighbours decide by the corpus' bigrams; these
are counted exactly, for the places that need them.

A defect is reported where the index and the distance find a word; the bigrams choose among words, so
they change a repair and never whether there is one.

Fixed bounds, documented: words have 3 to 64 signs, of Latin, Greek or Cyrillic script (a longer run is no word); a lexicon
word occurs at least three times, and one that is a misreading itself is proposed only where nothing
else is; a form of letters alone may be at most as frequent as misreading explains (1 % of the word's
count and three deviations); one confusion is allowed and one more for every four signs; a sign at an
edge belongs to the word unless what is inside stands alone more than a quarter as often. Codes are
one to three capitals, digits and at most two more capitals in a row, or digits with one sign after
them.

Defined results: null texts give no row; empty texts have no defect; a text without title has no
running header; repeated rows give the same finding again. Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lookalikes import CYRILLIC, GREEK, plain_form
from tessera.session import cut

# Letters as printed and the basic Latin signs of similar shape they are read as.
CONFUSIONS = [
    ("e", "c"), ("o", "0"), ("a", "o"), ("t", "f"), ("f", "t"), ("i", "l"), ("i", "!"), ("i", "1"), ("l", "|"), ("l", "1"), ("l", "!"),
    ("s", "5"), ("g", "9"), ("b", "8"), ("h", "b"), ("v", "y"), ("c", "("), ("n", "ri"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv"),
    ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"),
]
CONFUSIONS += [(letter.lower(), seen.lower()) for shapes in (CYRILLIC, GREEK) for letter, seen in shapes.items() if seen.isalpha()]
CONFUSIONS += [("о", "0"), ("з", "3"), ("б", "6"), ("ч", "4"), ("ο", "0")]
_BY_SEEN: dict[str, list[str]] = {}
for _true, _seen in CONFUSIONS:
    _BY_SEEN.setdefault(_seen, []).append(_true)
_FOLD = str.maketrans({"e": "c", "(": "c", "0": "o", "a": "o", "1": "l", "i": "l", "!": "l", "|": "l", "f": "t", "5": "s", "9": "g", "h": "b", "8": "b", "y": "v"})
# Other scripts' letters take the shape of the basic Latin signs they are read as.
_FOLD |= {ord(true): _FOLD.get(ord(seen), seen) for true, seen in CONFUSIONS if not true.isascii()}
_FOLD_MULTI = (("rn", "m"), ("rl", "n"), ("cl", "d"), ("ll", "u"), ("vv", "w"))

HYPHENS = "-‐‑¬­"
# Words that continue a suspended hyphen.
_CONJUNCTIONS = {"and", "or", "to", "und", "oder", "bis", "bzw", "et", "ou", "y", "e", "o", "u", "ni"}
_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c]")
_ODD = re.compile("[\u0300-\u036f\u200b-\u200f\u2060\ufeff\uff10-\uff5a\u00a0\u2000-\u200a\u202f]")
_PAGE = re.compile(
    r"\d{1,4}|\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}\s*/\s*\d{1,4}|[ivxl]{1,7}|[IVXL]{2,7}"
    r"|(?:p|pp|pg|S|pág|Pag|стр)\.\s*\d{1,4}|(?:page|seite|página|pagina|страница)\s+\d{1,4}(?:\s*(?:of|von|sur|de|из|/)\s*\d{1,4})?"
    r"|第\s*\d{1,4}\s*[页頁]",
    re.I,
)
_ROMAN = re.compile(r"(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_BARE = re.compile(r"\d{1,4}")
_LOWER_WORD = re.compile(r"([^\W\d_]+)")
_STRUCTURE = re.compile(r"#{1,6} |[-*+•] |\d{1,3}[.)] |\||```|~~~|>|<|\\")
_TOKEN = re.compile(r"[!|(]?[^\W_]+(?:[!|(][^\W_]+)*[!|]?")
_WORD_FORM = re.compile(r"(?=[0-9!|(]*[a-zß-öø-ɏΐ-ώа-џґ])[a-z0-9!|(ß-öø-ɏΐ-ώа-џґ]{3,64}")
_ONE_SCRIPT = r"^(?:\p{IsLatin}+|\p{IsGreek}+|\p{IsCyrillic}+)$"
_LETTERS = re.compile(r"[^\W\d_]+")
# No code: with a lower-case letter or three capitals in a row after the digits, the lexicon is asked.
_CODE = re.compile(r"[A-Z]{1,3}\d++(?!\w*(?:[^\W\d_A-Z]|[A-Z]{3}))\w*|\d+\w?")
_STRIP = "!|("
_SENTENCE_ENDS = ".!?…:;,。！？”»\"')"

BIGRAM_BITS = 1 << 27  # at most so many bits of a filter that spares the counting of bigrams no place needs


def _title_key(title: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", title or "").upper().split())


def _set_apart(key: str) -> re.Pattern:
    """The title by itself, or set apart by a wide gap or a bar from what is printed beside it."""
    title = r"\s+".join(map(re.escape, key.split()))
    return re.compile(rf"(?:^|(?<=\s\s)|(?<=[\t|·•])|(?<=[|·•]\s)){title}(?=$|\s\s|\t|\s?[|·•])")


def _broken_at(line: str) -> int:
    """Where a word broken by a hyphen at the line's end ends; 0 if there is none."""
    bare = line.rstrip()
    return len(bare) - 1 if len(bare) > 1 and bare[-1] in HYPHENS and bare[-2].isalpha() else 0


def layout(text: str, title: str | None = None) -> tuple[str, set[str]]:
    """Continuous paragraphs without headers, page numbers and broken words, and the defects that were there."""
    found: set[str] = set()
    if _ODD.search(text):  # look-alike forms are no misreading
        text = plain_form(text.replace("\u00ad\n", "-\n").replace("\u00ad\r", "-\r"))[0]
    lines = [line.strip() for line in _LINE_END.split(text)]
    if len(lines) < 2:
        return text, found
    key = _title_key(title)
    named = any(c.isalpha() for c in key)
    longest = max(key.split(), key=len, default="")
    filled = [i for i, line in enumerate(lines) if line]
    drop: set[int] = set()
    fenced = False
    for n, i in enumerate(filled):
        line = lines[i]
        if line.startswith(("```", "~~~")):
            fenced = not fenced
        if fenced:
            continue
        if key and n and not line.startswith("#"):
            header = False
            if len(key) >= 4 and len(line) <= len(key) + 60:
                upper = " ".join(line.upper().split())
                if key not in upper:
                    upper = _title_key(line)
                header = key in upper and len(upper) - len(key) <= 40
            if not header and named and not line.startswith("|"):
                upper = (line if line.isascii() else unicodedata.normalize("NFKC", line)).upper()
                if longest in upper and key in " ".join(upper.split()):
                    alone = n + 1 < len(filled) and all(not lines[k] or _PAGE.fullmatch(lines[k]) for k in (i - 1, i + 1))
                    header = (alone and line[-1] not in _SENTENCE_ENDS) or bool(_set_apart(key).search(upper))
            if header:
                drop.add(i)
                found.add("running_header")
                continue
        if _PAGE.fullmatch(line):
            if _BARE.fullmatch(line):
                before = lines[filled[n - 1]] if n else ""
                after = lines[filled[n + 1]] if n + 1 < len(filled) else ""
                if before.endswith((":", "：")) or _BARE.fullmatch(before) or _BARE.fullmatch(after):
                    continue
            elif line[0].isalpha() and line.isalpha() and not _ROMAN.fullmatch(line):
                continue
            drop.add(i)
            found.add("page_number")
    out: list[str] = []
    paragraph: list[str] = []  # its lines, each with the space before it
    page_break = blank = False
    for i, line in enumerate(lines):
        if i in drop:
            page_break = True
            continue
        if not line:
            blank = True
            continue
        structure = bool(_STRUCTURE.match(line))
        if paragraph:
            last = paragraph[-1]
            broken = _broken_at(last) if not blank or page_break else 0
            if broken and line[0].islower() and _LOWER_WORD.match(line)[1] not in _CONJUNCTIONS:
                found.add("hyphenation")
                paragraph[-1] = last[:broken]
                paragraph.append(line)
                page_break = blank = False
                continue
            if not structure and not paragraph[0].startswith("#") and (not blank or (page_break and last[-1] not in ".!?…:。！？»”\"")):
                paragraph.append(" " + line)
                page_break = blank = False
                continue
            out.append("".join(paragraph))
            out.append("\n" if not blank and structure else "\n\n")
        paragraph = [line]
        page_break = blank = False
    out.append("".join(paragraph))
    return "".join(out), found


def fold(word: str) -> str:
    """The word with letters of similar shape made one; contracted until nothing changes."""
    word = word.translate(_FOLD)
    while True:
        shorter = word
        for pair, one in _FOLD_MULTI:
            shorter = shorter.replace(pair, one)
        if shorter == word:
            return word
        word = shorter


def deletions(word: str) -> set[str]:
    """The word and all its forms with one sign less."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


EDIT = 50.0


def most_confusions(word: str) -> int:
    return 1 + len(word) // 4


def misreading_cost(word: str, seen: str) -> float:
    """Weighted edit distance: 0.25 for each pair of similar shapes, ``EDIT`` for any other edit."""
    m, n = len(word), len(seen)
    if abs(m - n) > most_confusions(word):
        return 99.0
    table = [[99.0] * (n + 1) for _ in range(m + 1)]
    table[0][0] = 0.0
    for i in range(m + 1):
        row = table[i]
        for j in range(n + 1):
            best = row[j]
            if i and j:
                best = min(best, table[i - 1][j - 1] + (0.0 if word[i - 1] == seen[j - 1] else EDIT))
            if i:
                best = min(best, table[i - 1][j] + EDIT)
            if j:
                best = min(best, row[j - 1] + EDIT)
                for length in (1, 2):
                    if j >= length:
                        for true in _BY_SEEN.get(seen[j - length : j], ()):
                            k = len(true)
                            if i >= k and word[i - k : i] == true:
                                best = min(best, table[i - k][j - length] + 0.25)
            row[j] = best
    return table[m][n]


def explained(count: int, word_count: int) -> bool:
    """Whether misreading alone explains that a form of letters is as frequent as this."""
    mean = word_count * 0.01
    return count <= mean + 3 * mean**0.5 + 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counted: Counter) -> pa.RecordBatch:
        forms: Counter = Counter()
        for token, n in counted.items():
            if _WORD_FORM.fullmatch(token):
                forms[token] += n
            bare = token.strip(_STRIP)
            if bare != token and _WORD_FORM.fullmatch(bare):
                forms[bare] += n
        alone = [counted[form] for form in forms]
        return pa.RecordBatch.from_arrays([pa.array(list(forms), pa.string()), pa.array(list(forms.values()), pa.int64()), pa.array(alone, pa.int64())], names=["word", "n", "alone"])

    counted: Counter = Counter()
    for batch in batches:
        for text, title in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            counted.update(_TOKEN.findall(layout(text, title)[0].lower()))
        if len(counted) > 300_000:
            yield rows(counted)
            counted.clear()
    if counted:
        yield rows(counted)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, words, counts = [], [], []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for form in deletions(fold(word)):
                hashes.append(xxhash.xxh64_intdigest(form.encode()) - (1 << 63))
                words.append(word)
                counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["key", "word", "n"])


def _accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, costs = [], []
        for seen, count, word, word_count in zip(*(batch.column(c).to_pylist() for c in ("seen", "n", "word", "word_n"))):
            odd = not _LETTERS.fullmatch(seen)
            cost = 99.0
            if (odd and word_count >= count) or (not odd and explained(count, word_count)):
                cost = misreading_cost(word, seen)
            keep.append(0 < cost <= 0.25 * most_confusions(word))
            costs.append(cost)
        table = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("seen", "n", "word", "word_n")), pa.array(costs, pa.float64())], names=["seen", "n", "word", "word_n", "cost"])
        yield table.filter(pa.array(keep))


def corrections(words: DataFrame) -> DataFrame:
    """(seen, word, word_n, cost): what each rare form of ``words`` (word, n, alone) may have been.

    ``alone`` counts a form without those that have a sign more at an edge. Forms and lexicon meet by hash keys, so neither is gathered anywhere.
    """
    key_schema = "key long, word string, n long"
    lexicon = words.where((F.col("n") >= 3) & F.col("word").rlike(_ONE_SCRIPT))
    forms = words.where(F.col("word").rlike(r"[c0oflt|!15(9b8ydmnu]|ri|rn|cl|ii|vv") | F.col("word").rlike(r"(?=.*[^\x00-\x{24F}]).*[\x00-\x7F]"))
    left = forms.mapInArrow(_index, key_schema).select("key", F.col("word").alias("seen"), "n")
    right = lexicon.mapInArrow(_index, key_schema).select("key", "word", F.col("n").alias("word_n"))
    pairs = (
        left.join(right, "key")
        .where((F.col("seen") != F.col("word")) & (F.col("word_n") >= F.col("n")))
        .where(F.abs(F.length("seen") - F.length("word")) <= 1 + F.floor(F.length("word") / 4))
        .select("seen", "n", "word", "word_n")
        .distinct()
    )
    found = pairs.mapInArrow(_accept, "seen string, n long, word string, word_n long, cost double")
    # a word that is a misreading itself is no correction where there is another one
    doubtful = found.select(F.col("seen").alias("word"), F.lit(True).alias("doubtful")).distinct()
    found = found.join(doubtful, "word", "left").withColumn("sure", F.col("doubtful").isNull())
    found = found.withColumn("any_sure", F.max("sure").over(Window.partitionBy("seen"))).where(F.col("sure") | ~F.col("any_sure"))
    bare = F.regexp_replace("seen", r"^[!|(]+|[!|(]+$", "")
    inner = words.select(F.col("word").alias("bare"), F.col("alone").alias("bare_n"))
    return (
        found.withColumn("bare", bare)
        .join(inner, "bare", "left")
        .where((F.col("bare") == F.col("seen")) | (4 * F.coalesce("bare_n", F.lit(0)) <= F.col("n")))
        .select("seen", "word", "word_n", "cost")
    )


def _rare_words(plain: str, usual: frozenset[str]) -> Iterator[tuple[str, int, list[str]]]:
    """(word, its place, all words) of the words that may be misread."""
    tokens = _TOKEN.findall(plain)
    words = [t.lower() for t in tokens]
    for k, (token, word) in enumerate(zip(tokens, words)):
        if word not in usual and not _CODE.fullmatch(token.strip(_STRIP)) and _WORD_FORM.fullmatch(word):
            yield word, k, words


def _defects(common):
    """(record_id, defect, seen): defects of layout, and every rare word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = common.value
        for batch in batches:
            ids, kinds, values = [], [], []
            for key, text, title in zip(*(c.to_pylist() for c in batch.columns)):
                plain, found = layout(text, title)
                here = [(kind, None) for kind in sorted(found)] + [("misread", word) for word in sorted({w for w, _, _ in _rare_words(plain, usual)})]
                for kind, word in here:
                    ids.append(key)
                    kinds.append(kind)
                    values.append(word)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["record_id", "defect", "seen"]
            )

    return run


class Lexicon:
    """Word counts of a corpus and what its rare forms may have been; both are written tables."""

    def __init__(self, texts: DataFrame, usual: int = 1 << 15) -> None:
        texts = _narrow(texts)
        counted = texts.mapInArrow(_count_words, "word string, n long, alone long")
        self.words = cut(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone")))
        self.corrections = cut(corrections(self.words))
        regular = self.words.where(F.col("word").rlike(_ONE_SCRIPT)).join(self.corrections.select(F.col("seen").alias("word")), "word", "left_anti")
        # A fixed number of words; it only spares the join below the usual ones.
        top = regular.orderBy(F.desc("n"), "word").limit(usual).select("word").collect()
        self.usual = texts.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in top))


def _narrow(texts: DataFrame) -> DataFrame:
    return texts.select("record_id", "text", "title").where(F.col("text").isNotNull() & F.col("record_id").isNotNull())


def find_defects(texts: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(record_id, defect) of the texts (record_id, text, title), once for each defect that occurs."""
    lexicon = lexicon or Lexicon(texts)
    rows = _narrow(texts).mapInArrow(_defects(lexicon.usual), "record_id string, defect string, seen string")
    known = lexicon.corrections.select(F.col("seen").alias("key"), F.lit(True).alias("known")).distinct()
    # defects of layout need no word: a key of their own spreads them over the tasks of the join
    rows = rows.withColumn("key", F.coalesce("seen", F.concat(F.lit("\n"), "record_id")))
    return rows.join(known, "key", "left").where((F.col("defect") != "misread") | F.col("known")).select("record_id", "defect").distinct()


# --- repair ----------------------------------------------------------------------------------------------------------

_EDGE = "\n"  # the neighbour of a text's first and last word


def _places(common):
    """(record_id, seen, before, after) of every rare word with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, title in zip(*(c.to_pylist() for c in batch.columns)):
                plain, _ = layout(text, title)
                found = {(w, words[k - 1] if k else _EDGE, words[k + 1] if k + 1 < len(words) else _EDGE) for w, k, words in _rare_words(plain, common.value)}
                rows.extend((key, *place) for place in sorted(found))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["record_id", "seen", "before", "after"])

    return run


def _pair_hash(first: str, second: str) -> int:
    return xxhash.xxh64_intdigest(f"{first}\n{second}".encode("utf-8", "surrogatepass"))


def _hash_pairs(n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_pair_hash(a, b) % n_bits for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], names=["bit"])

    return run


def _count_pairs(filter_bits):
    """This task's counts of the bigrams that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_bits.value
        n_bits = len(bits) * 8
        counted: Counter = Counter()

        def rows() -> pa.RecordBatch:
            pairs = list(counted)
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(list(counted.values()), pa.int64())], names=["first", "second", "n"]
            )

        for batch in batches:
            for text, title in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = _TOKEN.findall(layout(text, title)[0].lower())
                for pair in zip(words, words[1:]):
                    h = _pair_hash(*pair) % n_bits
                    if bits[h >> 3] >> (h & 7) & 1:
                        counted[pair] += 1
            if len(counted) > 300_000:
                yield rows()
                counted.clear()
        if counted:
            yield rows()

    return run


def bigram_counts(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """(first, second, n): how often each pair of ``needed`` (first, second; distinct) occurs in the corpus, exactly.

    A bit filter sized by their number, of at most ``BIGRAM_BITS`` bits, keeps most other pairs out of the shuffle; the join does the rest.
    """
    n_needed = needed.count()
    n_bits = 1 << 16
    while n_bits < min(BIGRAM_BITS, 16 * n_needed):
        n_bits *= 2
    words = needed.mapInArrow(_hash_pairs(n_bits), "bit long").groupBy(F.floor(F.col("bit") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("held"))
    held = np.zeros(n_bits // 32, dtype=np.uint32)
    for word, bits in words.toLocalIterator():  # one at a time, n_bits / 32 at most
        held[word] = bits
    shared = texts.sparkSession.sparkContext.broadcast(held.tobytes())
    counted = texts.mapInArrow(_count_pairs(shared), "first string, second string, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))
    return counted.join(needed, ["first", "second"], "left_semi")


def choose(texts: DataFrame, places: DataFrame, options: DataFrame) -> DataFrame:
    """(record_id, seen, before, after, word): the word that fits best at each place of a form with corrections."""
    at = places.join(options, "seen")
    n_options = options.groupBy("seen").agg(F.count("*").alias("n_options"))
    open_places = at.join(n_options.where("n_options > 1").select("seen"), "seen", "left_semi")
    pairs = open_places.select("before", "word", "after").distinct()
    needed = cut(
        pairs.where(F.col("before") != _EDGE).select(F.col("before").alias("first"), F.col("word").alias("second"))
        .unionByName(pairs.where(F.col("after") != _EDGE).select(F.col("word").alias("first"), F.col("after").alias("second")))
        .distinct()
    )
    counts = cut(bigram_counts(texts, needed))
    left = counts.select(F.col("first").alias("before"), F.col("second").alias("word"), F.col("n").alias("n_before"))
    right = counts.select(F.col("first").alias("word"), F.col("second").alias("after"), F.col("n").alias("n_after"))
    scored = at.join(left, ["before", "word"], "left").join(right, ["word", "after"], "left")
    context = F.log1p(F.coalesce("n_before", F.lit(0))) + F.log1p(F.coalesce("n_after", F.lit(0)))
    score = F.lit(-4.0) * F.col("cost") + context + F.lit(0.5) * F.log1p(F.col("word_n"))
    return scored.groupBy("record_id", "seen", "before", "after").agg(F.max_by("word", F.struct(score.alias("s"), F.col("word"))).alias("word"))


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, changed = [], []
        for text, title, chosen in zip(*(batch.column(c).to_pylist() for c in ("text", "title", "chosen"))):
            plain, _ = layout(text, title)
            plain, n = _correct(plain, {(c["seen"], c["before"], c["after"]): c["word"] for c in chosen}) if chosen else (plain, 0)
            out.append(plain)
            changed.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(out, pa.string()), pa.array(changed, pa.int32())], names=["record_id", "repaired", "n_corrected"])


def _correct(text: str, chosen: dict[tuple[str, str, str], str]) -> tuple[str, int]:
    spans = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    words = [_EDGE, *(w.lower() for _, _, w in spans), _EDGE]
    parts, at, n = [], 0, 0
    for k, (start, end, token) in enumerate(spans, 1):
        best = chosen.get((words[k], words[k - 1], words[k + 1]))
        if best is None or _CODE.fullmatch(token.strip(_STRIP)):
            continue
        if token[:1].isupper():
            best = best.upper() if token.isupper() and len(token) > 1 else best[:1].upper() + best[1:]
        parts.append(text[at:start] + best)
        at = end
        n += 1
    return "".join(parts) + text[at:], n


def repair(texts: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(record_id, repaired, n_corrected) of every text that is not null, as continuous paragraphs."""
    lexicon = lexicon or Lexicon(texts)
    texts = _narrow(texts)
    places = texts.mapInArrow(_places(lexicon.usual), "record_id string, seen string, before string, after string")
    places = cut(places.join(lexicon.corrections.select("seen").distinct(), "seen", "left_semi").distinct())
    chosen = choose(texts, places, lexicon.corrections).groupBy("record_id").agg(F.collect_set(F.struct("seen", "before", "after", "word")).alias("chosen"))
    joined = texts.join(chosen, "record_id", "left").select("record_id", "text", "title", "chosen")
    return joined.mapInArrow(_repair, "record_id string, repaired string, n_corrected int")
