"""One consistent form for texts that look the same.

Canonical composition, full-width letters and digits to plain ones, invisible characters removed,
every space the plain one. Look-alike letters are repaired by script: each token of more than one
script gets a dominant script, that of its letters that look like no other script's. Its other
letters, all of which must be look-alikes, are substituted towards that script, both ways, and only
when the result is a word of the corpus (a token of one script in the same columns). Where every
letter of a token has a look-alike, its letters leave the script open; the corpus decides: the script
in which it is a word, Latin before the others, and else the script of most letters, Latin of equals.

Defined results: null stays null and has no finding; empty and blank texts stay as they are; a token
whose repair is no corpus word keeps its letters; it is reported nevertheless if its dominant script
is Latin. A token with two scripts' own letters has no dominant script and is left alone. Joiners
between letters of Indic or Arabic script and between emoji are part of the spelling. Columns of the
input other than key and text are not read; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

# Letters of other scripts that look like basic Latin letters.
CYRILLIC = dict(zip("АВЕЗКМНОРСТУХаеорсухкѕіјһԁԛԝІЈЅҮԌ", "ABE3KMHOPCTYXaeopcyxksijhdqwIJSYG"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικγτχω", "ABEZHIKMNOPTYXavopuikytxw"))
LOOKALIKE = {**CYRILLIC, **GREEK}
del LOOKALIKE["З"]
# Towards each script: the other scripts' letters that look like one of its own.
_TO_LATIN = LOOKALIKE
_TO_CYRILLIC = {latin: c for c, latin in reversed(CYRILLIC.items()) if latin.isalpha()}
_TO_GREEK = {latin: g for g, latin in reversed(GREEK.items())}
_TO_CYRILLIC |= {g: _TO_CYRILLIC[latin] for g, latin in GREEK.items() if latin in _TO_CYRILLIC}
_TO_GREEK |= {c: _TO_GREEK[latin] for c, latin in CYRILLIC.items() if latin in _TO_GREEK}
_TOWARDS = {"latin": _TO_LATIN, "cyrillic": _TO_CYRILLIC, "greek": _TO_GREEK}

# Texts without any character outside this class need no Python: stable under composition, visible, of one script.
PLAIN = (
    r"\x00-\x7F\xA1-\xAC\xAE-\x{024F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}"
    r"\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}"
)
SUSPECT = f"[^{PLAIN}]"

_FULL_WIDTH = re.compile("[０-９Ａ-Ｚａ-ｚ]")
_FULL_WIDTH_MAP = {c: c - 0xFEE0 for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠍ㅤﾠ]")
_JOINER_IN_WORD = regex.compile(
    r"(?<=[\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Gujarati}\p{Gurmukhi}\p{Arabic}])[‌‍]"
    r"(?=[\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Gujarati}\p{Gurmukhi}\p{Arabic}])"
    r"|(?<=[\p{Extended_Pictographic}️])‍(?=\p{Extended_Pictographic})"
)
_SPACE = regex.compile(r"[\p{Zs}--[ ]]", regex.V1)
_WORD = regex.compile(r"\p{L}+")
_FOREIGN = regex.compile(r"[\p{Greek}\p{Cyrillic}]")
_SCRIPTS = {"latin": regex.compile(r"\p{Latin}"), "cyrillic": regex.compile(r"\p{Cyrillic}"), "greek": regex.compile(r"\p{Greek}")}

FINDINGS = ("not_composed", "full_width", "invisible", "odd_space", "lookalike")


def plain_form(text: str) -> tuple[str, list[str]]:
    """The text without look-alike repair, and which of the first four findings it had."""
    found = []
    if not unicodedata.is_normalized("NFC", text):
        found.append("not_composed")
    if _FULL_WIDTH.search(text):
        found.append("full_width")
        text = text.translate(_FULL_WIDTH_MAP)
    if _INVISIBLE.search(text):
        kept = {m.start() for m in _JOINER_IN_WORD.finditer(text)}
        bare = _INVISIBLE.sub(lambda m: m[0] if m.start() in kept else "", text)
        if bare != text:
            found.append("invisible")
            text = bare
    if _SPACE.search(text):
        found.append("odd_space")
        text = _SPACE.sub(" ", text)
    return unicodedata.normalize("NFC", text), found


def scripts_of(token: str) -> list[tuple[str, str]]:
    """(script, form in it) that a token of mixed script may be meant in: one if its letters tell, several if they leave it open.

    The script of most letters comes first, Latin of equals. None for a token with two scripts' own letters.
    """
    letters = {name: script.findall(token) for name, script in _SCRIPTS.items()}
    if sum(map(len, letters.values())) < len(token) or sum(map(bool, letters.values())) < 2:
        return []
    own = []
    for name, towards in _TOWARDS.items():
        others = [c for other, found in letters.items() if other != name for c in found]
        if letters[name] and all(c in towards for c in others):
            own.append((-len(letters[name]), list(_TOWARDS).index(name), name, "".join(c if c in letters[name] else towards[c] for c in token)))
    return [(name, form) for _, _, name, form in sorted(own)]


def mixed_tokens(text: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """Tokens of letters of more than one script, with what they may be meant to be."""
    if not _FOREIGN.search(text):
        return []
    found = []
    for word in dict.fromkeys(_WORD.findall(text)):
        if _FOREIGN.search(word) and (options := scripts_of(word)):
            found.append((word, options))
    return found


_FIRST = (
    "record_id string, field_name string, form string, findings array<string>, "
    "tokens array<struct<token: string, script: string, form: string, place: int, options: int>>"
)
_FIRST_TYPES = [
    pa.string(),
    pa.string(),
    pa.string(),
    pa.list_(pa.string()),
    pa.list_(pa.struct([("token", pa.string()), ("script", pa.string()), ("form", pa.string()), ("place", pa.int32()), ("options", pa.int32())])),
]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for key, field, text in zip(*(c.to_pylist() for c in batch.columns)):
            form, found = plain_form(text)
            tokens = [
                {"token": token, "script": script, "form": meant, "place": k, "options": len(options)}
                for token, options in mixed_tokens(form)
                for k, (script, meant) in enumerate(options)
            ]
            for column, value in zip(rows, (key, field, form, found, tokens)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _FIRST_TYPES)], names=["record_id", "field_name", "form", "findings", "tokens"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for form, repairs in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
            repaired = {r["token"]: r["form"] for r in repairs or ()}
            out.append(_WORD.sub(lambda m: repaired.get(m[0], m[0]), form) if repaired else form)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.string()), batch.column(3)], names=["record_id", "field_name", "canonical", "findings"]
        )


def _not_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def _is_suspect(text: Column) -> Column:
    """Whether a text needs a look; texts of basic Latin characters only are told by their length in bytes."""
    return _not_ascii(text) & text.rlike(SUSPECT)


def corpus_words(texts: DataFrame) -> DataFrame:
    """Every word of one script of the column ``text``; words are made distinct in each task before they are shuffled."""
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.where(F.col("word").rlike(r"^(?:\p{IsLatin}+|\p{IsCyrillic}+|\p{IsGreek}+)$")).distinct()


def findings(texts: DataFrame) -> DataFrame:
    """(record_id, field_name, form, findings, tokens) of the texts that have any suspect character.

    ``texts`` has record_id, field_name and text. The test for suspect characters runs in the JVM.
    """
    return texts.select("record_id", "field_name", "text").where(_is_suspect(F.col("text"))).mapInArrow(_first_pass, _FIRST)


def meant(first: DataFrame, texts: DataFrame) -> DataFrame:
    """(token, script, form, known): the dominant script of every distinct token of mixed script, and its form in it.

    The form is a word of the corpus if ``known``. Only the tokens' forms are looked up among the words.
    """
    options = first.select(F.explode("tokens").alias("t")).select("t.*").distinct()
    known = options.select(F.col("form").alias("word")).distinct().join(corpus_words(texts), "word", "left_semi").select(F.col("word").alias("form"), F.lit(True).alias("known"))
    rank = F.struct(F.coalesce("known", F.lit(False)).alias("known"), (F.col("known").isNotNull() & (F.col("script") == "latin")).alias("latin"), (-F.col("place")).alias("early"))
    best = F.max_by(F.struct("script", "form", F.coalesce("known", F.lit(False)).alias("known")), rank)
    return options.join(known, "form", "left").groupBy("token").agg(best.alias("b")).select("token", "b.script", "b.form", "b.known")


def canonical(texts: DataFrame) -> DataFrame:
    """(record_id, field_name, canonical, findings) of every row with a text that is not null."""
    texts = texts.select("record_id", "field_name", "text")
    first = cut(findings(texts))
    by_text = (
        first.select("record_id", "field_name", F.explode("tokens.token").alias("token"))
        .join(meant(first, texts), "token")
        .groupBy("record_id", "field_name")
        .agg(F.collect_set(F.struct("token", "script", "form", "known")).alias("meant"))
    )
    latin = F.exists(F.col("meant"), lambda m: m["script"] == "latin")
    by_text = by_text.select(*(F.col(c).alias(f"of_{c}") for c in ("record_id", "field_name")), "meant")
    same = [first[c].eqNullSafe(by_text[f"of_{c}"]) for c in ("record_id", "field_name")]
    joined = first.join(by_text, same, "left").select(
        "record_id",
        "field_name",
        "form",
        F.when(latin, F.concat("findings", F.array(F.lit("lookalike")))).otherwise(F.col("findings")).alias("findings"),
        F.filter("meant", lambda m: m["known"]).alias("repairs"),
    )
    repaired = joined.mapInArrow(_apply, "record_id string, field_name string, canonical string, findings array<string>")
    clean = texts.where(F.col("text").isNotNull() & ~_is_suspect(F.col("text"))).select(
        "record_id", "field_name", F.col("text").alias("canonical"), F.array().cast("array<string>").alias("findings")
    )
    return clean.unionByName(repaired)
