"""Pieces of SQL that several queries share."""

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

REPORTS = "reports as (select report_id, any_value(doc_id) as doc_id, any_value(full_text_md) as text, max(page_count) as page_count, any_value(metadata) as metadata from extract_reports where full_text_md is not null group by report_id)"

TABLES = "tables as (select chunk_id, any_value(content) as text from chunks where chunk_type = 'table' and content is not null group by chunk_id)"


def lines(source: str, key: str, text: str = "text", name: str = "lines") -> str:
    """A common table expression of (key, line_no, line)."""
    return f"""{name} as (
    select {key}, i as line_no, arr[i] as line from (
        select {key}, case when {text} = '' then [] when parts[len(parts)] = '' then parts[1:len(parts) - 1] else parts end as arr
        from (select {key}, {text}, regexp_split_to_array({text}, '{LINE_END}') as parts from {source} where {text} is not null)
    ), unnest(range(1, len(arr) + 1)) as u(i))"""


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"


def cells(x: str) -> str:
    inner = rf"regexp_replace({strip(x)}, '^\|+|\|+$', '', 'g')"
    return f"list_transform(string_split({inner}, '|'), lambda c: {strip('c')})"
