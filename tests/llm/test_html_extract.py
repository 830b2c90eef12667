import random
import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import html_extract as H

PARA = "Long paragraph text that tells the whole story of this page, with enough characters to matter. " * 3


class Lines(HTMLParser):
    """An independent reading of the same rules."""

    gone = {"script", "style", "noscript", "head"}
    ends = {"p", "div", "li", "ul", "br", "h1", "nav", "article", "footer", "body", "html", "title", "table", "tr", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.skip = [""], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.gone
        if tag in self.ends and not self.skip:
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag in self.ends and not self.skip:
            self.lines.append("")
        self.skip -= tag in self.gone

    def handle_data(self, data):
        if not self.skip:
            self.lines[-1] += data


def brute(html):
    p = Lines()
    p.feed(html)
    lines = [" ".join(x.split()) for x in p.lines]
    sums = [sum(len(x) for x in lines[i : i + H.BLOCK]) for i in range(len(lines))]
    runs, at = [], 0
    while at < len(lines):
        if not sums[at]:
            at += 1
            continue
        b = at
        while b < len(lines) and sums[b]:
            b += 1
        runs.append((at, b))
        at = b
    big = [r for r in runs if max(sums[r[0] : r[1]]) > H.PEAK] or sorted(runs, key=lambda r: (-sum(len(x) for x in lines[r[0] : r[1]]), r[0]))[:1]
    return "\n".join(x for a, b in big for x in lines[a:b] if x)


def page(seed):
    r = random.Random(seed)
    nav = "".join(f"<li><a href='/{i}'>n{i}</a></li>" for i in range(r.randint(0, 9)))
    body = "".join(f"<p>{PARA[: r.randint(1, 280)]} &amp; <b>bold</b> caf&eacute;</p>" for _ in range(r.randint(1, 6)))
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{nav}</ul></nav><!-- c <p> --><script>var t='</p>';</script><div>short</div><article><h1>Head {seed}</h1>{body}</article><footer>&copy; end</footer></body></html>"


def test_equals_independent_reading(spark):
    data = [(i, page(i)) for i in range(60)]
    out = {r.page_id: r.text for r in H.extract(spark.createDataFrame(data, "page_id long, html string")).collect()}
    assert out == {i: brute(h) for i, h in data}


def test_menu_and_footer_go_heading_stays():
    text, _, stretches = H.extract_text(f"<body><ul><li>Home</li><li>About</li></ul><div></div><h1>Title</h1><p>{PARA}</p><p>{PARA}</p></body><footer><p>imprint</p></footer>")
    assert text.startswith("Title\nLong") and "Home" not in text and "imprint" not in text and stretches == 1


def test_hard_cases(spark):
    long = "<p>" + PARA * 3000 + "</p>"
    data = [(1, None), (2, ""), (3, "<p></p><script>x"), (4, "a < b and c"), (5, long), (6, "<!-- open <p>x</p>"), (7, "one<br>two"), (None, "x"), (7, "one<br>two")]
    out = [(r.page_id, r.text, r.lines, r.stretches) for r in H.extract(spark.createDataFrame([(i, h, "x") for i, h in data], "page_id long, html string, text string")).collect()]
    assert (1, None, 0, 0) in out and (2, "", 0, 0) in out and (3, "", 0, 0) in out and (4, "a < b and c", 1, 1) in out and (6, "", 0, 0) in out and out.count((7, "one\ntwo", 2, 1)) == 2 and (None, "x", 1, 1) in out
    assert next(o for o in out if o[0] == 5)[1] == (PARA * 3000).strip()
    assert H.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|select|textarea|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>.*?</head\s*>|<![^>]*>|<\?[^>]*>", re.I | re.S)
_PARTS = ["<head>", "</head>", "<head", "</HEAD >", "<script>", "</script>", "<script src=x", "<Style a>", "</style", "</style >", "<!--", "-->", "<!", "<!DOCTYPE html>", "<?xml", "?>", ">", "<", "a b", "<p>", "</p>", "<svg>", "</svg>", "<header>", "&amp;", "\n"]


@given(st.lists(st.sampled_from(_PARTS), max_size=14).map("".join))
@settings(max_examples=1500, deadline=None)
def test_what_goes_is_what_the_pattern_matches(html):
    assert H.without_gone(html) == _GONE.sub(" ", html)


@pytest.mark.parametrize("part", ["<head>", "<a", "<!", "<script", "<style>", "<!--", "<p ", "</head", "<svg></style>", "<?", "<head></head ", "&#", "<", "<h1"])
def test_hostile_pages_take_linear_time(part):
    took = []
    for size in (250_000, 2_000_000):
        html = "<p>first</p>" + part * (size // len(part))
        start = time.perf_counter()
        H.extract_text(html)
        took.append(time.perf_counter() - start)
    assert took[1] < max(3, 24 * took[0])  # eight times the length; the quadratic time was over an hour
