"""Readers from bytes to text for every file format that needs no more than the standard library.

Each takes the bytes of one file and returns its text, or None if the format gives none. What needs another package
(PDF, legacy Office, pictures, sound) has a place in READERS that a caller fills with `register`.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Callable
from contextlib import suppress
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

WIDE = ("utf_8", "utf_16", "utf_32")
Reader = Callable[[bytes], "str | None"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
NO_SLIDES = "No text could be read from this presentation."


def best_effort(raw: bytes) -> str:
    """UTF-8 with or without its mark, else the Western code page, else Latin-1, which takes any byte."""
    for name in ("utf_8_sig", "cp1252"):
        with suppress(UnicodeError):
            return raw.decode(name)
    return raw.decode("latin-1")


def any_encoding(raw: bytes) -> str:
    """UTF-8, -16 and -32 before Latin-1; line ends become plain."""
    text = None
    for name in WIDE:
        with suppress(UnicodeError):
            text = raw.decode(name) if text is None else text
    return (raw.decode("latin-1") if text is None else text).replace("\r\n", "\n").replace("\r", "\n")


def as_utf8(text: str) -> str:
    """What text reads as if it is UTF-8 that was decoded in one of the other encodings; else the text."""
    for name in (*WIDE, "latin-1"):
        with suppress(UnicodeError):
            return text.encode(name).decode()
    return text


class _Text(HTMLParser):
    def __init__(self, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.drop, self.depth = drop, 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.drop

    def handle_endtag(self, tag):
        if tag in self.drop and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and (s := data.strip()):
            self.parts.append(s)


def html_text(html: str, separator: str = " ", drop: tuple[str, ...] = ("script", "style")) -> str:
    """The strings of a page, each stripped, joined by the separator."""
    parser = _Text(frozenset(drop))
    parser.feed(html)
    parser.close()
    return separator.join(parser.parts)


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _paragraph(p: ET.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _paragraph_markdown(p: ET.Element, styles: dict[str, str]) -> str | None:
    text = _paragraph(p)
    if not text.strip():
        return None
    style = p.find(f"{_W}pPr/{_W}pStyle")
    name = styles.get(style.get(f"{_W}val", ""), style.get(f"{_W}val", "")) if style is not None else ""
    if m := re.match(r"heading ?([1-6])", name, re.I):
        return f"{'#' * int(m[1])} {text}"
    level = p.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
    if level is None and not name.lower().startswith("list"):
        return text
    depth = level.get(f"{_W}val", "0") if level is not None else "0"
    return f"{'  ' * (int(depth) if depth.isdigit() else 0)}- {text}"


def _table_lines(table: ET.Element, indent: str = "") -> list[str]:
    """Rows as bullets: two cells are a label and its value, others are joined by bars; cells that merge counts once."""
    lines = []
    for row in table.findall(f"{_W}tr"):
        texts, nested = [], []
        for cell in row.findall(f"{_W}tc"):
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            if merge is not None and merge.get(f"{_W}val") != "restart":
                continue
            own = []
            for block in cell:
                if block.tag == f"{_W}tbl":
                    nested += _table_lines(block, indent + "  ")
                elif block.tag == f"{_W}p" and (s := " ".join(_paragraph(block).split())):
                    own.append(s)
            texts.append(" ".join(own))
        texts = texts[: max((k + 1 for k, t in enumerate(texts) if t), default=0)]
        if texts:
            lines.append(f"{indent}- " + (f"{texts[0]}: {texts[1]}" if len(texts) == 2 else " | ".join(texts)))
        lines += nested
    return lines


def docx(raw: bytes) -> str | None:
    """Paragraphs and tables in the order of the document, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).findall(f"{_W}style"):
                if (name := s.find(f"{_W}name")) is not None:
                    styles[s.get(f"{_W}styleId", "")] = name.get(f"{_W}val", "")
    blocks = []
    for x in body if body is not None else ():
        if x.tag == f"{_W}tbl" and (lines := _table_lines(x)):
            blocks.append("\n".join(lines))
        elif x.tag == f"{_W}p" and (md := _paragraph_markdown(x, styles)) is not None:
            blocks.append(md)
    return "\n\n".join(blocks)


def docx_book(raw: bytes) -> str | None:
    """Paragraphs first, then the rows of the tables: the order in which a book is read."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = [t for p in body.findall(f"{_W}p") if (t := _paragraph(p)).strip()] if body is not None else []
    for table in body.findall(f"{_W}tbl") if body is not None else ():
        for row in table.findall(f"{_W}tr"):
            if cells := [c for cell in row.findall(f"{_W}tc") if (c := " ".join(" ".join(map(_paragraph, cell.iter(f"{_W}p"))).split()))]:
                out.append(" ".join(cells))
    return "\n".join(out)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Target parts of a part's relations, by id."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    return {r.get("Id", ""): posixpath.normpath(posixpath.join("" if (t := r.get("Target", "")).startswith("/") else folder, t.lstrip("/"))) for r in ET.fromstring(z.read(rels))}


def xlsx(raw: bytes) -> str | None:
    """Each sheet as a heading and CSV."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        related = _related(z, "xl/workbook.xml")
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            rows: list[list[str]] = []
            for row in ET.fromstring(z.read(related[sheet.get(f"{_R}id", "")])).iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.findall(f"{_S}c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    v, kind = c.find(f"{_S}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else ("True" if v.text == "1" else "False") if kind == "b" else v.text or ""
                rows.append(cells)
            width = max(map(len, rows), default=0)
            text = io.StringIO()
            csv.writer(text, lineterminator="\n").writerows([r + [""] * (width - len(r)) for r in rows])
            out += [f"# {sheet.get('name', '')}", text.getvalue().strip("\n")]
    return "\n".join(out)


def pptx(raw: bytes) -> str | None:
    """The text of each slide's shapes under the slide's number."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        related = _related(z, "ppt/presentation.xml")
        order = [related[s.get(f"{_R}id", "")] for s in ET.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
        for n, part in enumerate(order, 1):
            out.append(f"## Slide {n}\n")
            for body in ET.fromstring(z.read(part)).iter(f"{_P}txBody"):
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in body.findall(f"{_A}p"))
                if text.strip():
                    out.append(text)
    return "\n\n".join(out)


def ppt(raw: bytes) -> str | None:
    """Of the legacy format: its runs of printable characters."""
    try:
        return pptx(raw)
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        found = [s for r in re.findall(r"[\x20-\x7E]{4,}", raw.decode("utf-16-le", "ignore")) if (s := r.strip())]
        return "\n".join(found) or NO_SLIDES


def epub(raw: bytes) -> str | None:
    """The items of the spine in reading order; those in no spine follow."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        roots = [n for n in names if n.lower().endswith(".opf")]
        pages = [n for n in names if n.lower().endswith((".html", ".htm", ".xhtml"))]
        order = []
        if roots:
            order = [n for href in spine(z.read(roots[0])) if (n := posixpath.normpath(posixpath.join(posixpath.dirname(roots[0]), href))) in pages]
        found = [_flat(html_text(z.read(n).decode("utf-8", "ignore"), drop=())) for n in [*order, *[n for n in pages if n not in order]]]
    return "\n\n".join(t for t in found if t)


def spine(opf: bytes) -> list[str]:
    """Of a package file: the hrefs in reading order."""
    root = ET.fromstring(opf)
    local = lambda tag: [x for x in root.iter() if x.tag.rpartition("}")[2] == tag]
    href = {}
    for item in local("item"):
        href.setdefault(item.get("id"), item.get("href"))
    return [href[r.get("idref")] for r in local("itemref") if href.get(r.get("idref"))]


def lit(raw: bytes) -> str | None:
    """A zip of pages, in the order in which they lie in it."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        found = [_flat(html_text(z.read(n).decode("utf-8", "ignore"))) for n in z.namelist() if n.endswith((".html", ".htm", ".xhtml"))]
    return "\n\n".join(t for t in found if t)


def _unpack(block: bytes) -> bytes:
    """PalmDoc compression: literals, stretches of literals, back references, and a blank before a letter."""
    out, i = bytearray(), 0
    while i < len(block):
        c = block[i]
        i += 1
        if 1 <= c <= 8:
            out += block[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c < 0xC0:
            if i >= len(block):
                break
            pair = c << 8 | block[i]
            i += 1
            back, n = (pair >> 3) & 0x7FF, (pair & 7) + 3
            for _ in range(n if 0 < back <= len(out) else 0):
                out.append(out[-back])
        else:
            out += bytes((32, c ^ 0x80))
    return bytes(out)


def mobi(raw: bytes) -> str | None:
    """Text of a book stored plain or with PalmDoc compression; None for others."""
    n = struct.unpack_from(">H", raw, 76)[0]
    at = [struct.unpack_from(">I", raw, 78 + 8 * k)[0] for k in range(n)] + [len(raw)]
    kind, _, _, records = struct.unpack_from(">HHIH", raw, at[0])
    if kind not in (1, 2):
        return None
    blocks = [raw[at[k] : at[k + 1]] for k in range(1, min(records, n - 1) + 1)]
    html = b"".join(_unpack(b) if kind == 2 else b for b in blocks).decode("utf-8", "ignore")
    return re.sub(r"\n\s*\n", "\n", re.sub(r" +", " ", html_text(html, "\n"))).strip() or None


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)
_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr generator themedata listtable listoverridetable datastore xmlnstbl latentstyles rsidtbl mmathPr".split())
_SIGNS = {"par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "row": "\n", "cell": "|", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": "\u2003", "enspace": "\u2002"}


def rtf(raw: bytes) -> str | None:
    """Rich text without its control words and hidden groups."""
    out, stack, hidden, skip, after = [], [], False, 0, 1
    for word, number, code, sign, brace, char in _RTF.findall(any_encoding(raw)):
        if brace:
            skip = 0
            if brace == "{":
                stack.append((hidden, after))
            elif stack:
                hidden, after = stack.pop()
        elif sign:
            skip = 0
            if sign == "~":
                out += [] if hidden else ["\u00a0"]
            elif sign in "{}\\":
                out += [] if hidden else [sign]
            elif sign == "*":
                hidden = True
        elif word:
            skip = 0
            if word in _HIDDEN:
                hidden = True
            elif word == "uc":
                after = int(number or 1)
            elif not hidden and word in _SIGNS:
                out.append(_SIGNS[word])
            elif not hidden and word == "u" and number:
                out.append(chr(int(number) % 0x10000))
                skip = after
        elif code:
            if skip:
                skip -= 1
            elif not hidden:
                out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif char:
            if skip:
                skip -= 1
            elif not hidden:
                out.append(char)
    return "".join(out)


#: By extension without its dot. PDF, legacy Word and Excel, pictures and sound have no reader until one is registered.
READERS: dict[str, Reader] = {
    "docx": docx, "xlsx": xlsx, "pptx": pptx, "ppt": ppt, "epub": epub, "rtf": rtf, "rdf": any_encoding, "lit": lit, "mobi": mobi,
    "html": lambda raw: _flat(html_text(best_effort(raw))), "htm": lambda raw: _flat(html_text(best_effort(raw))),
}
NEEDS_READER = frozenset("pdf doc xls png jpg jpeg gif webp bmp tiff mp3 wav m4a flac ogg".split())
#: What a book may be; any other extension is refused.
BOOKS = frozenset("txt pdf epub lit mobi opf doc docx rtf".split())


def read(name: str, raw: bytes, readers: dict[str, Reader] | None = None) -> str | None:
    """Text of a file by its extension; None if it can't be read."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    table = {**READERS, **(readers or {})}
    if ext in NEEDS_READER and ext not in table:
        return None
    try:
        return table.get(ext, best_effort)(raw)
    except Exception:  # a damaged file must not stop the corpus: its row has no text
        return None


def read_book(name: str, raw: bytes, readers: dict[str, Reader] | None = None) -> str | None:
    """The same for a book; a format that isn't one of BOOKS is a ValueError."""
    ext = name.rpartition(".")[2].lower()
    if ext not in BOOKS:
        raise ValueError(f"no book format: {ext!r}")
    plain = lambda b: any_encoding(b)
    return read(name, raw, {"txt": plain, "docx": docx_book, **(readers or {})})
