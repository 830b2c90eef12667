"""Readers on files made here, folders as tables, configuration, and sinks."""

import io
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.sources import config as G
from quillstone.sources import corpus as C
from quillstone.sources import formats as R
from quillstone.sources import sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def para(text, inner=""):
    return f"<w:p>{inner}<w:r><w:t>{text}</w:t></w:r></w:p>"


def cell(content, inner=""):
    return f"<w:tc>{inner}{content}</w:tc>"


DOCX = zipped({
    "word/document.xml": f"<w:document {W}><w:body>" + para("Title", '<w:pPr><w:pStyle w:val="H1"/></w:pPr>') + para("Body text") + para("") + "<w:tbl>"
    + "<w:tr>" + cell(para("Name")) + cell(para("Ann  B")) + cell(para("")) + "</w:tr><w:tr>" + cell(para("a")) + cell(para("b")) + cell(para("c") + "<w:tbl><w:tr>" + cell(para("in")) + cell(para("ner")) + "</w:tr></w:tbl>") + "</w:tr>"
    + "<w:tr>" + cell(para("one"), '<w:tcPr><w:vMerge/></w:tcPr>') + cell(para("alone")) + "</w:tr></w:tbl>" + para("item", '<w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr>') + "</w:body></w:document>",
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
})
EPUB = zipped({
    "o/b.opf": '<package><manifest><item id="x" href="2.xhtml"/><item id="y" href="1.xhtml"/></manifest><spine><itemref idref="y"/><itemref idref="x"/><itemref idref="gone"/></spine></package>',
    "o/1.xhtml": "<p>First <b>part</b></p>", "o/2.xhtml": "<p>Second\n\n part</p>", "o/3.xhtml": "<p> </p>",
})


def test_docx():
    assert R.docx(DOCX) == "# Title\n\nBody text\n\n- Name: Ann B\n- a | b | c\n  - in: ner\n- alone\n\n  - item"
    assert R.docx_book(DOCX).splitlines()[:3] == ["Title", "Body text", "item"]


def test_epub_follows_the_spine():
    assert R.epub(EPUB) == "First part\n\nSecond part"


def test_xlsx():
    s, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    raw = zipped({
        "xl/workbook.xml": f'<workbook {s} xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>a,b</t></si></sst>",
        "xl/worksheets/s.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    })
    assert R.xlsx(raw) == '# One\n"a,b",,3\n,x,'


def test_pptx_and_legacy():
    a, p, rel = ("http://schemas.openxmlformats.org/" + x for x in ("drawingml/2006/main", "presentationml/2006/main", "officeDocument/2006/relationships"))
    slide = f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:txBody><a:p><a:r><a:t>Hello</a:t></a:r></a:p></p:txBody></p:sld>'
    raw = zipped({"ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{rel}"><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="r1" Target="slides/1.xml"/></R>', "ppt/slides/1.xml": slide})
    assert R.pptx(raw) == "## Slide 1\n\n\nHello"
    assert R.ppt(" Some words \x01\x02ab".encode("utf-16-le")) == "Some words" and R.ppt(b"\x01\x02") == R.NO_SLIDES


def test_rtf():
    raw = rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9 \u8364? \{x\}{\*\generator q;}}"
    assert R.rtf(raw) == "Hello bold\ncafé € {x}"


def test_mobi():
    html = b"<p>One  two</p><script>x</script><p>three</p>"
    head = struct.pack(">HHIH", 1, 0, len(html), 1)
    at = 78 + 16
    raw = b"\0" * 76 + struct.pack(">H", 2) + struct.pack(">II", at, 0) + struct.pack(">II", at + len(head), 0) + head + html
    assert R.mobi(raw) == "One two\nthree"
    assert R._unpack(b"ab\x80\x11\xe3") == b"ababab"[:2] + b"abab"[:4] + b" c"


def test_encodings():
    assert R.best_effort("\ufeffé".encode()) == "é" and R.best_effort(b"caf\xe9 \x93x\x94") == "café “x”" and R.best_effort(b"\x81") == "\x81"
    assert R.any_encoding("é\r\n".encode("utf-16")) == "é\n" and R.any_encoding(b"\xe9") == "é"
    assert R.as_utf8("Ã©") == "Ã©" and R.as_utf8("plain") == "plain"


def test_read_never_fails_and_books_are_checked():
    assert R.read("x.docx", b"no zip") is None and R.read("x.pdf", b"%PDF") is None and R.read("x.pdf", b"p", {"pdf": lambda b: "text"}) == "text"
    assert R.read("noext", b"abc") == "abc"
    with pytest.raises(ValueError):
        R.read_book("x.xyz", b"")


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"caf\xe9")
    (tmp_path / "b.TXT").write_bytes(b"left out")
    (tmp_path / "sub" / "c.docx").write_bytes(DOCX)
    (tmp_path / "sub" / "d.docx").write_bytes(b"damaged")
    files = C.corpus(spark, str(tmp_path))
    assert files.count() == C.file_count(spark, str(tmp_path)) == 3 and C.file_count(spark, None) == 0
    got = {os.path.basename(r.path): r.text for r in C.texts(files).collect()}
    assert got["a.txt"] == "café" and got["c.docx"].startswith("# Title") and got["d.docx"] is None
    assert [r[0] for r in files.where("path like '%a.txt'").select(C.decode_best_effort(F.col("content"))).collect()] == ["café"]
    with pytest.raises(Exception):
        C.corpus(spark, str(tmp_path / "missing")).count()


def test_converted_writes_what_is_stale_and_deletes_what_isnt_kept(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one  two\n three")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "b.txt.cleaned").write_text("old")
    (tmp_path / "c.txt").write_text("fresh")
    (tmp_path / "c.txt.cleaned").write_text("stays")
    for name, at in (("b.txt", 200), ("b.txt.cleaned", 100), ("c.txt", 100), ("c.txt.cleaned", 200)):
        os.utime(tmp_path / name, (at, at))
    files, outs = C.corpus(spark, str(tmp_path)), C.corpus(spark, str(tmp_path), (".cleaned",))
    plan = C.converted(files, outs, keep=lambda t: F.length(t) > 3)
    states = {os.path.basename(r.path): r.state for r in sinks.write_files(plan).collect()}
    assert states == {"a.txt.cleaned": "written", "b.txt.cleaned": "deleted"}
    assert (tmp_path / "a.txt.cleaned").read_text() == "one two three" and not (tmp_path / "b.txt.cleaned").exists() and (tmp_path / "c.txt.cleaned").read_text() == "stays"
    assert {r.text for r in C.cleaned(spark, str(tmp_path)).collect()} == {"one two three", "stays"}


def test_spine_is_an_ordered_join(spark):
    spine = spark.createDataFrame([("b", 1, "y"), ("b", 0, "x"), ("b", 2, "gone"), ("b", 3, "z")], "book string, position int, idref string")
    manifest = spark.createDataFrame([("b", "x", "one"), ("b", "y", "two"), ("b", "z", " ")], "book string, id string, text string")
    assert [tuple(r) for r in C.spine_text(spine, manifest).collect()] == [("b", "one\n\ntwo")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "line\nbreak")], "n int, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in C.read_csv(spark, str(tmp_path / "c")).collect()) == [("1", 'a "q", b'), ("2", "line\nbreak")]


def test_yaml_includes_and_merges(tmp_path, monkeypatch):
    (tmp_path / "a.yaml").write_text("x: INCLUDEFILE(b.yaml)\nl: ['INCLUDEFILE(b.yaml)']\n")
    (tmp_path / "b.yaml").write_text("y: 1\nz: INCLUDEFILE(c.yaml)\n")
    (tmp_path / "c.yaml").write_text("deep: true\n")
    (tmp_path / "sub").mkdir()
    monkeypatch.chdir(tmp_path / "sub")
    assert G.read_yaml("a") == {"x": {"y": 1, "z": {"deep": True}}, "l": ["INCLUDEFILE(b.yaml)"]}
    assert G.find_path("none.yaml", required=False) is None
    assert G.deep_merge({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 0, "c": 3}, "d": {}, "e": "x"}) == {"a": {"b": 1, "c": 3}, "d": 1, "e": "x"}


def test_settings_and_environments():
    config = {"environments": {"p": {"test": {"environment_variable": "E=p"}, "port": 1}, "q": {"test": {"environment_variable": "E=q"}, "alias": "p"}}, "all": {"a": {"x": 1}}, "p": {"a": {"y": 2}}}
    assert G.environment(config, {"E": "q"}) == ("p", config["environments"]["p"]) and G.environment(config, {}) == (None, None)
    assert G.resolved(config, {"all": {"a": {"k": "s"}}}, {"E": "p"})[0] == {"a": {"x": 1, "k": "s", "y": 2}}
    s = G.Settings({"a": {"b": [10, 20]}, "N": None})
    assert s["a"]["b.1"] == 20 and s["a.c", 7] == 7 and s.get("a/b/0") == 10 and s.get("N/x", 1) == 1
    assert G.get_ignoring_case({"Aa": [{"B": 3}]}, "aA/0/b") == 3 and G.lower_keys({"A": [{"B": 1}]}) == {"a": [{"b": 1}]}
    with pytest.raises(KeyError):
        G.get({}, "!a/b")
    assert "|" in G.to_yaml({"a": "x\ny"}) and G.tables_of({"persistence": {"tables": {"t": {"columns": []}}}}) == {"t": {"columns": []}}
