"""The word kernel against its rule, put one character after the other."""

import pyarrow as pa
import pytest
import regex
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import kernel as K

SOME = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZ09 .,_-ßÉéŁłΣσЖж中文かなカナ，。สวัสดี🙂❤\ufe0f①Ⅷ\u0301\u20e3İẞK"), st.characters(min_codepoint=0x80, max_codepoint=0x24FF)), max_size=40)


def kernel(texts, size=K.SLICE_BYTES):
    out = []
    for w in K.words(pa.array(texts, pa.string()), size):
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            out.append([w.low[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])])
    return out


@given(st.lists(SOME, max_size=8), st.sampled_from([1, 40, 1 << 20]))
@settings(max_examples=500, deadline=None)
def test_words_are_those_of_the_rule(texts, size):
    assert kernel(texts, size) == [words(t) for t in texts]


@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FF), max_size=60))
@settings(max_examples=200, deadline=None)
def test_latin_words_are_those_of_the_pattern(text):
    fold = lambda t: "".join(low if len(low := x.lower()) == 1 and len(low.encode()) == len(x.encode()) else x for x in t)
    assert kernel([text]) == [regex.findall(r"[\p{L}\p{N}]+", fold(text))]


def test_scripts():
    assert kernel(["Łódź ŁÓDŹ łódź", "中文，测试。English混合text", "สวัสดี", "❤️ a🙂b", "ÉCOLE STRASSE ΣΑΣ Жук ﬁn", "", None]) == [
        ["łódź"] * 3, ["中", "文", "测", "试", "english", "混", "合", "text"], list("สวัสดี"), ["a", "b"], ["école", "strasse", "σασ", "жук", "ﬁn"], [], [],
    ]


def test_sql_has_the_same_words():
    duckdb = pytest.importorskip("duckdb")
    texts = ["Łódź, ŁÓDŹ!", "中文，测试。English混合text", "สวัสดีครับ 123", "❤️ a🙂b", "ÉCOLE Straße ΣΑΣ", "नमस्ते दुनिया", "𠀀𠀁 x²", "snake_case"]
    db = duckdb.connect()
    got = [db.execute(f"SELECT {K.word_sql('$1::varchar')}", [t]).fetchone()[0] for t in texts]
    assert got == [words(t) for t in texts] == kernel(texts)


def test_equal_words_have_equal_hashes_wherever_they_stand():
    (w,) = K.words(pa.array(["x 中文 Łódź", "łódź，文中 X"]))
    by = {}
    for s, e, h in zip(w.starts, w.ends, w.hashes.tolist()):
        by.setdefault(w.low[s:e].tobytes(), set()).add(h)
    assert all(len(h) == 1 for h in by.values()) and len({next(iter(h)) for h in by.values()}) == len(by) == 4


def test_sizes_in_bytes(spark):
    df = spark.createDataFrame([(1, "ab", [1, 2], [(1, 2)], b"xyz"), (2, None, None, None, None)], "a long, s string, l array<long>, t array<struct<start:int,end:int>>, b binary")
    assert K.size_of(df) == 2 * (16 + 8) + (16 + 2) + 16 + (16 + 16) + 16 + (16 + 24) + 16 + (16 + 3) + 16
    assert K.size_of(df.where("a > 2")) == 0
    assert K.size_of(spark.createDataFrame([(1, [["x", "yy"]])], "a long, s array<array<string>>")) == 16 + 8 + 16 + 16 + 17 + 18
