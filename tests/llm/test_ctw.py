import random
from math import exp, lgamma, log, log2, pi

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose, table

from quillstone.llm import ctw as C

TEXTS = ["abracadabra", "the cat sat on the mat, the cat", "", "aaaa bbbb é", "abracadabra"]


class Brute:
    """Context trees as dictionaries, by the definition."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, {}
        for t in texts:
            for i, b in self.places(t):
                for bit in range(8):
                    for d in range(depth + 1):
                        self.n.setdefault(((1 << bit) | (b[i] >> (8 - bit)), b[i - d : i]), [0, 0])[b[i] >> (7 - bit) & 1] += 1
        self.kids, self.memo = {}, {}
        for node, c in self.n:
            if c:
                self.kids.setdefault((node, c[1:]), []).append(c)

    def places(self, t):
        b = bytes(self.depth) + t.encode()
        return [(i, b) for i in range(self.depth, len(b))]

    def pw(self, node, c):
        """log Pw of a context."""
        if (node, c) not in self.memo:
            a, b = self.n.get((node, c), (0, 0))
            v = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)
            if len(c) < self.depth:
                q = sum(self.pw(node, x) for x in self.kids.get((node, c), []))
                v = log(0.5) + max(v, q) + log(exp(v - max(v, q)) + exp(q - max(v, q)))
            self.memo[node, c] = v
        return self.memo[node, c]

    def next(self, node, context, one):
        """p(one) as the ratio of Pw at the root with and without one more decision."""
        before = self.pw(node, b"")
        path = [context[len(context) - d :] for d in range(self.depth + 1)]
        for c in path:
            self.n[node, c][one] += 1
            self.memo.pop((node, c), None)
        after = self.pw(node, b"")
        for c in path:
            self.n[node, c][one] -= 1
            self.memo.pop((node, c), None)
        return exp(after - before)

    def bits(self, t):
        return -sum(log2(self.next((1 << k) | (b[i] >> (8 - k)), b[i - self.depth : i], b[i] >> (7 - k) & 1)) for i, b in self.places(t) for k in range(8))


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 6])
def test_code_length_is_the_ratio_of_weighted_probabilities(spark, depth):
    brute = Brute(TEXTS, depth)
    out = sorted((r.doc_id, r.bits) for r in C.score(table(spark, list(enumerate(TEXTS))), depth=depth).collect())
    assert [b for _, b in out] == pytest.approx([brute.bits(t) for t in TEXTS], abs=0.02)


def test_without_broadcast_the_same(spark):
    data = [(k, prose(k, 60)) for k in range(20)] + [(20, None), (21, ""), (None, "x"), (3, prose(3, 60))]
    key = lambda r: (str(r.doc_id), r.bytes, r.bits, r.bits_per_byte)
    assert sorted(map(key, C.score(table(spark, data)).collect())) == sorted(map(key, C.score(table(spark, data), broadcast_grams=10).collect()))


def test_chunks_change_nothing(spark, monkeypatch):
    data = [(k, prose(k, 60)) for k in range(20)]
    whole = sorted(map(tuple, C.score(table(spark, data)).collect()))
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint64))
    batches = [pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.ones(len(k), np.int64))], ["g", "n"]) for k in np.array_split(keys, 40)]
    for chunk in (1, 50, 700, 1 << 20):
        monkeypatch.setattr(C, "CHUNK", chunk)
        parts = list(C._contexts(iter(batches), 16))
        assert np.array_equal(np.concatenate([k for k, _ in parts]), keys) and sum(len(n) for _, n in parts) == 5000
        assert all(not set((a >> 16).tolist()) & set((b >> 16).tolist()) for (a, _), (b, _) in zip(parts, parts[1:]))
    for limit in (1 << 20, 10):
        assert sorted(map(tuple, C.score(table(spark, data).repartition(3), broadcast_grams=limit).collect())) == whole


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 100.5, 1e6, 3e9])
    assert np.allclose(C.log_gamma(x), [lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


def test_odd_text_is_dearer_and_hard_cases(spark):
    data = [(k, prose(k, 80)) for k in range(40)] + [(100, "".join(random.Random(1).choices([chr(c) for c in range(33, 127)], k=400))), (101, None), (102, ""), (103, prose(0, 20000)), (None, prose(1, 9))]
    out = {r.doc_id: r for r in C.score(table(spark, data)).collect()}
    assert len(out) == len(data) and out[100].bits_per_byte > 1.3 * max(out[k].bits_per_byte for k in range(40))
    assert (out[101].bytes, out[101].bits, out[101].bits_per_byte) == (0, 0.0, None) == (out[102].bytes, out[102].bits, out[102].bits_per_byte)
    assert C.score(table(spark, [])).collect() == []
