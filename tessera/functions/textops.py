"""Scalar text functions as Column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CJK ranges of the token estimate.
CJK_CLASS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{30FF}\x{F900}-\x{FAFF}]"
TAG = r"<[^>]+>"
# Fixed value: the characters with the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# One line splitter for every operator: all line ends that Unicode text may carry.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def cjk_count(text: Column) -> Column:
    """Number of code points in the CJK ranges."""
    return F.length(text) - F.length(F.regexp_replace(text, CJK_CLASS, ""))


def estimate_tokens(text: Column, strip_tags: Column | bool = False) -> Column:
    """CJK code points plus a quarter, rounded down, of all others; with ``strip_tags`` each tag counts as one space."""
    if strip_tags is not False:
        bare = F.regexp_replace(text, TAG, " ")
        text = bare if strip_tags is True else F.when(strip_tags, bare).otherwise(text)
    cjk = cjk_count(text)
    return (cjk + F.floor((F.length(text) - cjk) / 4)).cast("int")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    lines = F.split(text, LINE_END, -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    )


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only U+0020."""
    return F.btrim(text, F.lit(WHITE_SPACE))


# --- tables ------------------------------------------------------------------------------------------------------------


def cells(row: Column) -> Column:
    """Cells of a pipe row: outer pipes dropped, each cell trimmed."""
    inner = F.regexp_replace(strip(row), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|", -1), strip)


def is_pipe_row(row: Column) -> Column:
    return strip(row).rlike(r"^\|.*\|$")


def is_separator(row: Column) -> Column:
    """Only white space, colons, pipes and hyphens, at least one hyphen."""
    return row.rlike(r"^\s*\|?[\s:|-]+\|?\s*$") & row.contains("-")


def table_score(rows: Column) -> Column:
    """0.6 times the share of rows as wide as the widest plus 0.4 times the share of cells that are not empty."""
    widths = F.transform(rows, lambda r: F.size(r))
    widest = F.array_max(widths)
    regular = F.size(F.filter(widths, lambda w: w == widest)) / F.size(rows)
    all_cells = F.flatten(rows)
    filled = F.size(F.filter(all_cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")) / F.size(all_cells)
    return F.when(F.size(rows) > 0, F.round(0.6 * regular + 0.4 * F.coalesce(filled, F.lit(0.0)), 3)).otherwise(0.0)


def pipe_table(rows: Column) -> Column:
    """Rows as a pipe table: padded to the widest, header and separator first."""
    widest = F.array_max(F.transform(rows, lambda r: F.size(r)))

    def line(r: Column) -> Column:
        padded = F.concat(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), F.array_repeat(F.lit(""), widest - F.size(r)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), widest), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


# --- tokens ------------------------------------------------------------------------------------------------------------


def word_tokens(text: Column) -> Column:
    """Lower-cased words of at least four letters, hyphens and apostrophes; audit and coverage count these."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z\-']{3,}"), F.lit(0)), F.lower)


def anchor_tokens(text: Column) -> Column:
    """Lower-cased runs of at least four basic letters and digits; page anchoring uses these."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]{4,}"), F.lit(0)), F.lower)


def numeric_tokens(text: Column) -> Column:
    """Numbers as they are written; 6.0 and 6 stay different."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def squash(text: Column) -> Column:
    """White space deleted, dashes and multiplication signs made one, lower case."""
    return F.lower(F.translate(F.regexp_replace(text, r"(?U)\s+", ""), "−–—×·", "---xx"))


# --- identifiers -------------------------------------------------------------------------------------------------------


def chunk_id(doc_id: Column, path: Column, duplicate: Column, content: Column) -> Column:
    joined = F.concat_ws("|", F.coalesce(doc_id, F.lit("")), F.coalesce(F.array_join(path, "/"), F.lit("")), duplicate.cast("string"), F.coalesce(content, F.lit("")))
    return F.substring(F.sha1(joined), 1, 16)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def point_id(name: Column, namespace: str = "6ba7b8129dad11d180b400c04fd430c8") -> Column:
    """UUID of version 5 in the OID namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


# --- documents ---------------------------------------------------------------------------------------------------------


def strip_front_matter(text: Column) -> Column:
    """Text after a leading front matter block; unchanged where the block has no end."""
    end = F.locate("\n---", text, 5)
    rest = F.regexp_replace(F.substr(text, end + 4), r"^\n+", "")
    return F.when(text.startswith("---\n") & (end > 0), rest).otherwise(text)


# Parts of the file names of images that only decorate.
DECORATIVE = ("logo", "icon", "bullet", "separator", "decoration", "bg_")


def remove_decorative_images(text: Column, hints: tuple[str, ...] = DECORATIVE) -> Column:
    """Images without alternative text whose source carries one of the hints; long runs of line ends shrink to two."""
    bare = F.regexp_replace(text, rf"(?i)!\[\]\([^)]*(?:{'|'.join(hints)})[^)]*\)", "")
    return F.regexp_replace(bare, r"\n{3,}", "\n\n")


def remove_empty_formulas(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\$\$\s*\$\$", ""), r"\$\s+\$", "")


def strip_reply(text: Column) -> Column:
    """A model's reply without thoughts and code fences."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(F.regexp_replace(strip(bare), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```$", ""))


def page_range(spec: Column) -> Column:
    """'0,2,5-7' as sorted distinct page numbers; null for an empty one, and for one that can't be read."""
    bare = F.regexp_replace(spec, r"\s+", "")
    part = F.split(bare, ",")
    numbers = F.flatten(
        F.transform(
            part,
            lambda p: F.sequence(
                F.regexp_extract(p, r"^(\d+)", 1).cast("int"),
                F.greatest(F.coalesce(F.nullif(F.regexp_extract(p, r"-(\d+)$", 1), F.lit("")), F.regexp_extract(p, r"^(\d+)", 1)).cast("int"), F.regexp_extract(p, r"^(\d+)", 1).cast("int")),
            ),
        )
    )
    return F.when(bare.rlike(r"^\d+(-\d+)?(,\d+(-\d+)?)*$"), F.array_sort(F.array_distinct(numbers)))


def derive_title(title: Column, stem: Column) -> Column:
    """The given title if it is one, else the file's stem."""
    t = strip(title)
    good = F.length(t).between(4, 200) & (F.length(F.regexp_replace(t, r"\P{L}", "")) >= 4) & ~F.lower(t).rlike(r"\.(pdf|docx?|tex|dvi|indd|pptx?|xlsx?)$")
    return F.when(good, t).otherwise(stem)


def language_by_share(text: Column) -> Column:
    """'ch' if CJK letters are more than half the Latin ones, else 'en' if there are Latin ones."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, r"[\x{4E00}-\x{9FFF}]", ""))
    latin = F.length(text) - F.length(F.regexp_replace(text, r"[A-Za-z]", ""))
    return F.when(cjk > 0.5 * latin, "ch").when(latin > 0, "en").otherwise("unknown")


def language_for_engine(text: Column) -> Column:
    """'ch' if there are at least 20 CJK letters and 1.2 times as many as Latin ones, else 'en'."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, r"[\x{4E00}-\x{9FFF}]", ""))
    latin = F.length(text) - F.length(F.regexp_replace(text, r"[A-Za-z]", ""))
    return F.when(cjk >= F.greatest(F.lit(20), F.floor(1.2 * latin)), "ch").otherwise("en")


# --- settings and JSON -------------------------------------------------------------------------------------------------


def tri_state(flag: Column, configured: Column, policy: Column) -> Column:
    """On, off, or by what is configured and the policy allows: for true, on, yes, 1; false, off, no, 0; anything else."""
    said = F.lower(strip(flag.cast("string")))
    return F.when(said.isin("true", "on", "yes", "1"), True).when(said.isin("false", "off", "no", "0"), False).otherwise(configured & policy)


def json_object(*values: Column, names: tuple[str, ...]) -> Column:
    """The values as one JSON object; nulls are written."""
    return F.to_json(F.struct(*(v.alias(n) for v, n in zip(values, names))), {"ignoreNullFields": "false"})
