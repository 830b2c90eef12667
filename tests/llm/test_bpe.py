import base64
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, prose, table
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bpe as B

if not os.path.exists(B.VOCABULARY):
    pytest.skip("no vocabulary here", allow_module_level=True)
with open(B.VOCABULARY, "rb") as f:
    CODER = B.Bpe.load(f.read())
ODD = ["", " ", "  a   b", "a \n b\n \nc  ", "it's we'll   DON'T\t\t x", " lead", "trail ", "a b    c", "🙂🙂 é" * 5, "1234567890123 abc,,,;;  ...\r\n\r\nx", " x  y", "a" * 3000, "İstanbul ſ", "<|endoftext|>"]


def ids(text):
    return np.frombuffer(CODER.encode(text), np.int32).tolist()


def naive(piece):
    """The rule itself: of all neighbouring pairs merge the one of least rank, the leftmost first, until none is left."""
    if piece in CODER.ranks:
        return [CODER.ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        ranked = [(CODER.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in CODER.ranks]
        if not ranked:
            return [CODER.ranks[p] for p in parts]
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["the", "ing", "x", " ", "  ", "\n", "!", "é", "9", "'s", "tion"]), max_size=25).map("".join)))
@settings(max_examples=400, deadline=None)
def test_equals_naive_merging_and_round_trips(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == [t for p in CODER.find(text) for t in naive(p.encode())]
    assert CODER.decode(ids(text)).decode() == text


@pytest.mark.parametrize("text", ODD)
def test_equals_the_public_encoder(text):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})
    assert ids(text) == other.encode_ordinary(text)


@given(st.lists(st.sampled_from(["a", "It's", "é", "中文", "\u3000", "\u00a0", "\u2003", "\u0085", "\x1c", " ", "  ", "\n", "\t", "\r\n", "!", "12", "'ll", "🙂"]), max_size=25).map("".join), st.lists(st.text(max_size=6), max_size=4))
@settings(max_examples=400, deadline=None)
def test_cuts_at_white_space_change_nothing(text, others):
    texts = [text, *(t.encode("utf-8", "ignore").decode() for t in others), text]
    tokens, counts = CODER.encode_all(pa.array(texts))
    want = [[t for p in CODER.find(x) for t in naive(p.encode())] for x in texts]
    assert counts.tolist() == [len(w) for w in want] and tokens.tolist() == [t for w in want for t in w]


@given(st.lists(st.binary(min_size=1, max_size=B.SHORT) | st.sampled_from([b"a" * 50, b"tion" * 9, b" the" * 3, b"x", b"ab" * 20]), min_size=1, max_size=12))
@settings(max_examples=300, deadline=None)
def test_pieces_merged_together_are_as_merged_alone(pieces):
    at = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    sym, piece = CODER.merge_all(np.frombuffer(b"".join(pieces), np.uint8), at)
    assert [sym[(piece == k) & (sym >= 0)].tolist() for k in range(len(pieces))] == [CODER.merge(p) for p in pieces]
    assert all(p in CODER.ranks or CODER.merge(p) == naive(p) for p in pieces)


def test_cache_generations_change_nothing():
    small = B.Bpe(CODER.ranks)
    small.units.limit = 3 * 250
    for k in range(20):
        assert small.encode(prose(k, 50)) == CODER.encode(prose(k, 50))


def test_memory_is_bounded_whatever_is_encoded():
    """10,000 long texts without spaces, and as many new words as the caches can't hold."""
    coder, r = B.Bpe(CODER.ranks), random.Random(1)
    coder.units.limit = 2 << 20
    held = lambda c: sum(sys.getsizeof(k) + sys.getsizeof(v) for g in (c.new, c.old) for k, v in g.items()) + sys.getsizeof(c.new) + sys.getsizeof(c.old)
    for _ in range(20):
        texts = ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(400)) for _ in range(500)]
        coder.encode_all(pa.array(texts))
        coder.encode_all(pa.array([" ".join(str(r.random()) for _ in range(500))]))
        assert held(coder.units) <= coder.units.limit
    assert all(len(k) <= B.SHORT for k in coder.units.new)


def test_a_long_text_without_spaces(spark):
    text = "".join(chr(0x4E00 + k * k % 20000) + ("，" if k % 30 == 0 else "") for k in range(300_000))
    row = B.encode(table(spark, [(1, text), (2, "x" * 100_000)])).collect()
    assert all(r.round_trip for r in row) and {r.doc_id: r.text for r in B.decode(B.encode(table(spark, [(1, text)]))).collect()} == {1: text}


def test_table_round_trip_and_hard_cases(spark):
    data = list(enumerate(ODD)) + [(100, None), (101, LONG), (None, "x y"), (102, "same"), (102, "same")]
    out = B.encode(table(spark, data))
    rows = out.collect()
    assert len(rows) == len(data) and all(r.round_trip for r in rows if r.doc_id != 100)
    null = next(r for r in rows if r.doc_id == 100)
    assert (null.tokens, null.n_tokens, null.round_trip) == (None, None, None)
    empty = next(r for r in rows if r.doc_id == 0)
    assert (empty.tokens, empty.n_tokens, empty.round_trip) == ([], 0, True)
    texts = {r.doc_id: r.text for r in B.decode(out).collect()}
    assert texts[101] == LONG and texts[100] is None and all(texts[k] == t for k, t in enumerate(ODD))
    assert B.encode(table(spark, [])).collect() == []


def test_other_vocabulary_is_a_parameter(spark, tmp_path):
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([bytes([b]) for b in range(256)] + [b"ab", b"abab"])))
    assert [r.tokens for r in B.encode(table(spark, [(1, "ababab")]), vocabulary=str(path)).collect()] == [[257, 256]]
    (tmp_path / "bad").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        B.Bpe.load((tmp_path / "bad").read_bytes())
