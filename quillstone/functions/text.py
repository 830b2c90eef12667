"""Text scalars. Patterns use (?U): without it the JVM's \\W, \\w and \\s know ASCII only."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, with every stretch of characters that aren't word characters as one blank, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, r"(?U)\W+", " ")))


def word_count(normalized: Column) -> Column:
    """Words of a normalised text; 0 for an empty one."""
    return F.when(F.length(normalized) == 0, 0).otherwise(F.size(F.split(normalized, " "))).cast("bigint")


def has_min_words(normalized: Column, least: int = 20) -> Column:
    return word_count(normalized) >= least


def collapse_whitespace(text: Column) -> Column:
    """Every stretch of white space as one blank; the ends aren't trimmed."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (trim takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_lines(text: Column) -> Column:
    """Each line stripped."""
    return F.array_join(F.transform(F.split(text, "\n"), strip), "\n")


def flatten_lines(text: Column) -> Column:
    """Stripped lines, joined with nothing between them."""
    return F.array_join(F.transform(F.split(text, "\n"), strip), "")


def clean_filename(name: Column) -> Column:
    """Characters that file systems refuse as underscores, of which runs become one."""
    return F.regexp_replace(F.translate(name, '<>:"?*|', "_" * 7), "_+", "_")


def date_in_path(path: Column) -> Column:
    """The first yyyy-mm-dd that stands alone, unchecked; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"\b(\d{4}(?:-\d\d){2})\b", 1), F.lit(""))


def file_date(path: Column, modified: Column) -> Column:
    """The date in the path, else the day of the last change."""
    return F.coalesce(date_in_path(path), F.date_format(modified, "yyyy-MM-dd"))


def letters(line: Column) -> Column:
    """How many ASCII letters it has."""
    return F.length(F.regexp_replace(line, "[^A-Za-z]", "")).cast("bigint")


def line_guard(text: Column, least: int = 12) -> Column:
    """Only the lines with enough letters for a verdict on gibberish."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: letters(x) >= least), "\n")


def ascii_runs(text: Column) -> Column:
    """Printable ASCII runs of four and more that are longer than three characters once stripped."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[\x20-\x7E]{4,}"), F.lit(0)), lambda x: F.trim(x)), lambda x: F.length(x) > 3)


def yes_no(answer: Column) -> Column:
    """yes or no if that is the first line, else the whole answer, in lower case and stripped."""
    low = F.lower(strip(answer))
    first = strip(F.split(low, "\n").getItem(0))
    return F.when(first.isin("yes", "no"), first).otherwise(low)


def fenced(text: Column, fence: str) -> Column:
    """What stands between the first opening fence of that kind and the next closing one; the text itself without one."""
    open_at = "```" + fence
    inner = F.split(text, re.escape(open_at), 2).getItem(1)
    return F.when(F.contains(text, F.lit(open_at)), strip(F.substring_index(inner, "```", 1))).otherwise(text)


def clean_json(text: Column) -> Column:
    """The outermost braces of an answer, white space collapsed; null if there are none."""
    flat = collapse_whitespace(fenced(text, "json"))
    return F.nullif(F.regexp_extract(flat, r"(?s)(\{.*\})", 1), F.lit(""))


def style_strip(html: Column) -> Column:
    """Without style elements and their contents."""
    return F.regexp_replace(html, r"(?s)<style[^>]*>.*?</style>", "")


def printable_html(html: Column, style: str) -> Column:
    """Own styles instead of the page's: put before the end of the head, or around a fragment without a body."""
    bare, block = style_strip(html), f"<style>{style}</style>"
    at = F.locate("</head>", bare)
    head = F.concat(F.substring(bare, F.lit(1), at - 1), F.lit(block), bare.substr(at, F.length(bare)))
    wrapped = F.concat(F.lit(f"<!DOCTYPE html><html><head>{block}</head><body>"), bare, F.lit("</body></html>"))
    return F.when(at > 0, head).when(~F.contains(bare, F.lit("<body")), wrapped).otherwise(F.concat(F.lit(block), bare))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, tags become blanks, white space collapses, the basic references resolve."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(bare, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(collapse_whitespace(text))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def output_budget(text: Column, window: int, wanted: int) -> Column:
    """Tokens left for an answer: those wanted, unless prompt and answer exceed the window."""
    used = token_estimate(text)
    return F.when(used + wanted > window, F.greatest(F.lit(1024), F.lit(window) - used - 500)).otherwise(F.lit(wanted)).cast("bigint")


def pattern_regex(pattern: str) -> str:
    """A regular expression for a word pattern in which a star at either end lifts the word boundary."""
    tail, head = pattern.endswith("*"), pattern.removesuffix("*").startswith("*")
    core = re.escape(pattern.removesuffix("*").removeprefix("*"))
    return ("" if head else r"\b") + core + ("" if tail else r"\b")


def matches_patterns(name: Column, patterns: list[str]) -> Column:
    """Whether a file name fits one of the patterns: a bare extension is a suffix, all else a glob of the whole name."""
    low, any_of = F.lower(name), F.lit(False)
    for p in patterns:
        if p.startswith(".") and "*" not in p and "?" not in p:
            any_of = any_of | F.endswith(low, F.lit(p.lower()))
        else:
            any_of = any_of | low.rlike(_java(fnmatch.translate(p.lower())))
    return any_of


def _java(regex: str) -> str:
    """Python's translation of a glob in the JVM's dialect: anchored at both ends."""
    return "^" + regex.replace(r"\Z", r"\z").replace(r"\z", "") + r"\z"


def chunk_id(path: Column, index: Column, date: Column) -> Column:
    """date::path#index, without the date where there is none."""
    return F.concat(F.coalesce(F.concat(date, F.lit("::")), F.lit("")), path, F.lit("#"), index.cast("string"))


def chunk_path(chunk: Column) -> Column:
    """The path in a dated chunk id; null where the id has no date or no index."""
    a, b = F.instr(chunk, "::"), F.instr(chunk, "#")
    return F.when((a > 0) & (b > 0), chunk.substr(a + 2, F.greatest(b - a - 2, F.lit(0))))


def context_part(name: Column, date: Column, text: Column) -> Column:
    """One source's share of a context: where it is from, when, and its text."""
    return F.concat(F.lit("From "), F.coalesce(name, F.lit("Unknown")), F.lit(" (Date: "), F.coalesce(date, F.lit("Unknown")), F.lit("):\n"), text, F.lit("\n"))


#: Where a statement is broken for display; longer keywords come first.
_BREAKS = ("LEFT JOIN", "RIGHT JOIN", "INNER JOIN", "OUTER JOIN", "CROSS JOIN", "FULL JOIN", "JOIN", "FROM", "WHERE", "GROUP BY", "ORDER BY", "HAVING", "LIMIT", "UNION", "AND", "OR")


def pretty_sql(sql: Column) -> Column:
    """Line breaks before the main keywords; for display only, as literals aren't spared."""
    words = "|".join(_BREAKS)
    return F.regexp_replace(sql, rf"(?i) ({words}) ", "\n$1 ")
