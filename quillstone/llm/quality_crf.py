"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line that isn't blank is labelled good or bad. Its features are measures of its characters and
words, steps of these measures, and the same of the lines before and after it; the transition weights
couple neighbouring labels. Forward and backward passes give each line's marginal; a document's quality
is 1 minus the mean marginal of "bad", weighted by the lines' lengths.

fit() trains on the driver by L-BFGS with an L2 penalty. Only document labels are given, so that all lines
of a labelled document carry its label. It uses at most MAX_LABELLED labelled rows, those of the
least hash of (id, seed), and of these the first whose texts take at most MAX_BYTES together: the documented bounds of the
sample, which is held on the driver. All else reads every document.

Defined results:
- A labelled id with several texts is fitted by the least of them.
- Long documents are read whole; their lines are walked one after the other, in time linear in their number (100,000
  lines take seconds), together with the other documents of a slice.
- Null or empty text, or one of blank lines only: quality null, 0 lines, not kept.
- Labels that are null, or of ids without a document, are not used; an id with several labels counts with the greatest.
- Without labelled documents of both kinds no weight is learnt: every quality is 0.5, and all with text are kept.
- A quality that ties with the threshold is kept. Repeated rows get the same result each; a null id is no obstacle.
- keep() returns all columns, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm import kernel as K

MAX_LABELLED = 3000
MAX_BYTES = 256 << 20
THRESHOLD = 0.5
L2 = 1.0

SCHEMA = "doc_id bigint, quality double, lines bigint, bad_lines bigint, keep boolean"

_CLASS = np.full(256, 7, np.int64)
_CLASS[:33] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _c in b".?!":
    _CLASS[_c] = 4
for _c in b",;:":
    _CLASS[_c] = 5
for _c in b"'\"()-":
    _CLASS[_c] = 6
_CLASS[128:192], _CLASS[192:] = 9, 8
_MARK = (_CLASS >= 4) & (_CLASS <= 7)
#: Steps of the measures: (measure, values above which the step is 1).
_STEPS = ((1, (0.6, 0.75)), (2, (0.2, 0.5)), (3, (0.1, 0.3)), (4, (0.03, 0.1)), (6, (0.03,)), (7, (0.05, 0.2, 0.5)), (8, (0.4, 0.7)), (9, (0.02, 0.1)), (12, (0.5,)))
_BASE = 14
_OWN = _BASE + sum(len(v) for _, v in _STEPS)
FEATURES = 3 * _OWN + 3


def line_features(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, document) of each line that isn't blank, in order."""
    raw = w.raw
    if not len(raw):
        return np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, np.int64)
    starts = np.unique(np.concatenate((w.at[:-1], np.flatnonzero(raw == 10) + 1)))
    starts = starts[starts < len(raw)]
    n = len(starts)
    line = np.repeat(np.arange(n), np.diff(np.append(starts, len(raw))))
    kind = _CLASS[raw]
    count = np.bincount(line * 10 + kind, minlength=n * 10).reshape(n, 10).astype(float)
    chars = count[:, :9].sum(axis=1) - count[:, 0]
    mark = _MARK[raw]
    double = np.flatnonzero(mark[1:] & (raw[1:] == raw[:-1]))
    doubled = np.bincount(line[double], minlength=n)
    last = np.maximum.reduceat(np.where(kind > 0, np.arange(len(raw)), 0), starts)
    of = line[w.starts]
    words = np.bincount(of, minlength=n)
    same = np.flatnonzero((w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1])) + 1
    repeated = np.bincount(of[same], minlength=n)
    key = np.sort((of.astype(K.U) << K.U(36)) | (w.hashes >> K.U(28)))
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[fresh] >> K.U(36)).astype(np.int64), minlength=n)
    total, per_word = np.maximum(chars, 1), np.maximum(words, 1)
    letters = count[:, 1] + count[:, 2] + count[:, 8]
    x = np.empty((n, _BASE))
    x[:, 0] = np.log1p(chars) / 8
    x[:, 1] = letters / total
    x[:, 2] = count[:, 2] / np.maximum(letters, 1)
    x[:, 3] = count[:, 3] / total
    x[:, 4] = count[:, 7] / total
    x[:, 5] = count[:, 5] / total
    x[:, 6] = doubled / total
    x[:, 7] = repeated / per_word
    x[:, 8] = 1 - distinct / per_word
    x[:, 9] = (count[:, 4] + count[:, 6]) / total
    x[:, 10] = np.minimum(letters / per_word / 10, 2)
    x[:, 11] = kind[last] == 4
    x[:, 12] = count[:, 8] / np.maximum(letters, 1)
    x[:, 13] = words < 4
    full = chars > 0
    x, chars = x[full], chars[full]
    doc = np.searchsorted(w.at, starts[full], side="right") - 1
    x = np.concatenate([x, *[(x[:, [k]] > v).astype(float) for k, vs in _STEPS for v in vs]], axis=1)
    out = np.zeros((len(x), FEATURES))
    out[:, :_OWN] = x
    linked = doc[1:] == doc[:-1]
    out[1:, _OWN : 2 * _OWN] = x[:-1] * linked[:, None]
    out[:-1, 2 * _OWN : 3 * _OWN] = x[1:] * linked[:, None]
    if len(x):
        out[:, -3] = np.concatenate(([True], ~linked))
        out[:, -2] = np.concatenate((~linked, [True]))
    out[:, -1] = 1
    return out, chars, doc


class Chains:
    """Chains of lines of several lengths, walked step by step over all that are long enough."""

    def __init__(self, doc: np.ndarray):
        new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
        self.first, self.length = new, np.diff(np.append(new, len(doc)))
        order = np.argsort(-self.length, kind="stable")
        first, length = new[order], self.length[order]
        top = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(top), side="left")
        self.at = [first[:a] + t for t, a in enumerate(active)]
        self.ends = new + self.length - 1

    def marginals(self, score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of "bad" at each line; the summed marginals of label pairs; the summed log partition.

        score: of "bad" over "good" at each line; trans[i, j]: of label j after i.
        """
        n = len(score)
        e = np.zeros((n, 2))
        e[:, 1] = score
        a, b = e.copy(), np.zeros((n, 2))
        for at in self.at[1:]:
            p = a[at - 1]
            a[at] += np.logaddexp(p[:, [0]] + trans[0], p[:, [1]] + trans[1])
        for at in reversed(self.at[1:]):
            q = e[at] + b[at]
            b[at - 1] = np.logaddexp(q[:, [0]] + trans[:, 0], q[:, [1]] + trans[:, 1])
        z_of = np.logaddexp(a[self.ends, 0], a[self.ends, 1])
        z = np.repeat(z_of, self.length)
        p1 = np.exp(a[:, 1] + b[:, 1] - z)
        inner = np.ones(n, bool)
        inner[self.first] = False
        at = np.flatnonzero(inner)
        pairs = np.exp(a[at - 1][:, :, None] + trans[None] + (e[at] + b[at])[:, None, :] - z[at][:, None, None]).sum(axis=0)
        return p1, pairs, float(z_of.sum())


def train(x: np.ndarray, doc: np.ndarray, bad: np.ndarray, l2: float = L2, steps: int = 80) -> np.ndarray:
    """Weights of the features, then the four of the transitions; bad: the label of each line."""
    chains, f = Chains(doc), x.shape[1]
    inner = np.ones(len(x), bool)
    inner[chains.first] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (bad[at - 1].astype(int), bad[at].astype(int)), 1)
    gold = x.T @ bad

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = v[:f], v[f:].reshape(2, 2)
        p, pairs, z = chains.marginals(x @ w, t)
        return (z - gold @ w - (seen * t).sum() + l2 / 2 * v @ v) / len(x), np.concatenate((x.T @ p - gold, (pairs - seen).ravel())) / len(x) + l2 * v / len(x)

    v = np.zeros(f + 4)
    value, g = loss(v)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alpha = -g.copy(), []
        for s, y in reversed(past):
            alpha.append(s @ d / (s @ y))
            d -= alpha[-1] * y
        if past:
            s, y = past[-1]
            d *= s @ y / (y @ y)
        for (s, y), c in zip(past, reversed(alpha)):
            d += s * (c - y @ d / (s @ y))
        step = 1.0
        while step > 1e-8:
            new, g_new = loss(v + step * d)
            if new <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, y = step * d, g_new - g
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y)]
        done = value - new < 1e-7
        v, value, g = v + s, new, g_new
        if done:
            break
    return v


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", seed: int = 1) -> np.ndarray:
    """Weights learnt from documents labelled 1 (good) or 0 (bad)."""
    chosen = labels.select(F.col(f"`{label_id}`").cast("bigint").alias("_l"), F.col(f"`{label_col}`").cast("int").alias("_y")).where("_l is not null and _y is not null")
    order = F.xxhash64("_l", F.lit(seed))
    chosen = K.cut(chosen.groupBy("_l").agg(F.max("_y").alias("_y")).orderBy(order, "_l").limit(max_labelled))
    rows = K.keyed(docs, id_col, text_col).join(F.broadcast(chosen), F.col("_id") == F.col("_l")).groupBy("_l", "_y").agg(F.min("_text").alias("_text"))
    rows = K.cut(rows)
    upto = F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)).cast("bigint")).over(Window.orderBy(order, "_l"))  # of max_labelled rows at most
    fit_in = rows.select("_l", upto.alias("_upto")).where(F.col("_upto") <= max_bytes).select(F.col("_l").alias("_id"))
    rows = rows.join(F.broadcast(fit_in), F.col("_l") == F.col("_id")).select("_id", "_y", "_text")
    found = sorted(((r["_id"], r["_y"], r["_text"]) for r in rows.collect()), key=lambda r: r[0])
    if len({y > 0 for _, y, _ in found}) < 2:
        return np.zeros(FEATURES + 4)
    xs, docs_of, base = [], [], 0
    for w in K.words(pa.array([t for _, _, t in found], pa.string())):
        x, _, doc = line_features(w)
        xs.append(x.astype(np.float32))
        docs_of.append(doc + w.first)
    doc = np.concatenate(docs_of)
    bad = np.array([y <= 0 for _, y, _ in found], float)[doc]
    return train(np.concatenate(xs), doc, bad)


def scores(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quality, NaN without lines; lines; lines more likely bad than good) of each row."""
    n = len(column)
    quality, lines, bad = np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, np.int64)
    trans = weights[FEATURES:].reshape(2, 2)
    for w in K.words(column):
        x, chars, doc = line_features(w)
        if not len(x):
            continue
        p, _, _ = Chains(doc).marginals(x @ weights[:FEATURES], trans)
        m = len(w.bounds) - 1
        total = np.bincount(doc, chars, m)
        have = np.flatnonzero(total)
        quality[w.first + have] = 1 - np.bincount(doc, chars * p, m)[have] / total[have]
        lines[w.first : w.first + m] = np.bincount(doc, minlength=m)
        bad[w.first : w.first + m] = np.bincount(doc, p > 0.5, m)
    return np.round(quality, 6), lines, bad


def classify(docs: DataFrame, weights: np.ndarray, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, quality, lines, bad_lines, keep of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, lines, bad = scores(batch.column(1), shared.value)
        with np.errstate(invalid="ignore"):
            kept = q >= threshold
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(q, from_pandas=True), pa.array(lines), pa.array(bad), pa.array(kept)], ["doc_id", "quality", "lines", "bad_lines", "keep"])

    return K.arrow_map(rows, work, SCHEMA)


def keep(docs: DataFrame, weights: np.ndarray, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents of at least that quality."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, _, _ = scores(batch.column(batch.schema.get_field_index(text_col)), shared.value)
        with np.errstate(invalid="ignore"):
            return batch.filter(pa.array(q >= threshold))

    return K.arrow_map(docs, work, docs.schema)
