"""HTML extraction by line-block distribution.

Markup is stripped: comments, scripts, styles, the head and the like go with their contents; a
block-level tag, opening or closing, ends a line; any other tag vanishes; white space of the source counts
as one blank; character references are resolved. The block length at a line is the sum of text lengths over
the BLOCK lines from there on. Where it is zero the distribution dives, where it is zero no longer it
surges; a stretch between a surge and the next dive is content if its greatest block length exceeds
PEAK characters, and its lines are kept. So short menu entries, captions and notices that stand apart
go, and a heading stays with its paragraphs. If no stretch exceeds PEAK, the one of most text stays.

Defined results:
- Null page: null text, 0 lines, 0 stretches. An empty page, or one without text: empty text, 0 and 0.
- Ties for the most text: the earliest stretch. Repeated rows get equal results; a null id is no obstacle.
- Markup that isn't closed: a comment, script or style runs to the end of the page; a "<" without ">" is text.
- Pages of any length are read whole, in time linear in their length, whatever tags are left open.
- A short article, none of whose stretches exceeds PEAK, loses to a longer footer (see README for how many do).
- Only the id and html columns are read. Empty tables give empty results.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

BLOCK, PEAK = 2, 160
SCHEMA = "page_id bigint, text string, lines bigint, stretches bigint"

_STARTS = re.compile(r"<(?:!--|!|\?|(script|style|noscript|template|svg|iframe|object|select|textarea|math)\b|(head)\b)", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "math", "head")}
_ENDS_LINE = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frameset|h[1-6]|header|hgroup|hr|html|legend|li|main|menu|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?=[\s/>])[^>]*>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_SPACE = re.compile(r"\s+")


def without_gone(html: str) -> str:
    """The page without what goes with its contents. Nothing is looked for again once it isn't ahead, so that time is linear."""
    out, at, look, last, none_of = [], 0, 0, html.rfind(">"), set()
    while (m := _STARTS.search(html, look)) is not None:
        start, look = m.start(), m.end()
        if m[0] == "<!--":
            end = html.find("-->", look)
            end = len(html) if end < 0 else end + 3
        elif look > last:
            if html.find("<!--", look) < 0:
                break
            continue  # tags can't end any more, comments may
        else:
            end = html.find(">", look) + 1
            if (name := m[1] or m[2]) is not None:
                name = name.lower()
                close = None if name in none_of else _ENDS[name].search(html, end)
                if close is None:
                    none_of.add(name)
                    if name == "head":
                        continue
                end = len(html) if close is None else close.end()
        out.append(html[at:start])
        at = look = end
    return " ".join([*out, html[at:]])


def _up_to_tags(pattern: re.Pattern, by: str, text: str) -> str:
    """A substitution of tags: behind the last > there are none."""
    last = text.rfind(">") + 1
    return pattern.sub(by, text[:last]) + text[last:]


def lines_of(html: str) -> list[str]:
    """The lines of text of a page, blank ones included."""
    text = _up_to_tags(_TAG, "", _up_to_tags(_ENDS_LINE, "\x00", _SPACE.sub(" ", without_gone(html.replace("\x00", " ")))))
    return [_SPACE.sub(" ", unescape(x)).strip() if "&" in x else x.strip() for x in text.split("\x00")]


def content(lines: list[str], block: int = BLOCK, peak: int = PEAK) -> list[tuple[int, int]]:
    """Stretches (first line, line after the last) between a surge and a dive that reach the peak."""
    n = len(lines)
    length = [len(x) for x in lines]
    sums = [sum(length[i : i + block]) for i in range(n)]
    found, at = [], 0
    while at < n:
        if not sums[at]:
            at += 1
            continue
        surge, top = at, 0
        while at < n and sums[at]:
            top = max(top, sums[at])
            at += 1
        found.append((surge, min(n, at), top))
    kept = [(a, b) for a, b, top in found if top > peak]
    if not kept and found:
        a, b, _ = max(found, key=lambda f: (sum(length[f[0] : f[1]]), -f[0]))
        kept = [(a, b)]
    return kept


def extract_text(html: str, block: int = BLOCK, peak: int = PEAK) -> tuple[str, int, int]:
    """(text, lines kept, stretches kept) of one page."""
    lines = lines_of(html)
    kept = content(lines, block, peak)
    text = [x for a, b in kept for x in lines[a:b] if x]
    return "\n".join(text), len(text), len(kept)


def extract(pages: DataFrame, *, block: int = BLOCK, peak: int = PEAK, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, lines, stretches of every page."""
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(None, 0, 0) if (html := x.as_py()) is None else extract_text(html, block, peak) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], ["page_id", "text", "lines", "stretches"])

    return K.arrow_map(rows, work, SCHEMA)
