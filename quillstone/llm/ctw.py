"""LM scoring by context-tree weighting over bytes.

A byte is coded by eight binary decisions, from the highest bit; each of the 255 places of this decision tree
has a context tree of its own over the bytes before, the nearest first, down to DEPTH. With n0 and n1
the decisions seen in a context s, the Krichevsky-Trofimov estimate of its sequence is KT(s), and
    Pw(s) = KT(s) / 2 + (product of Pw over the contexts one byte longer) / 2,    Pw = KT at DEPTH,
so that the estimates of all depths are mixed. What the counts of the whole corpus predict next is then
    p(s) = a(s) (n1 + 1/2) / (n0 + n1 + 1) + (1 - a(s)) p(longer context),   a(s) = KT(s) / 2 Pw(s),
from the root down. The code length of a text is the sum of -log2 of its decisions' probabilities.

Every document is counted, none is sampled: each task counts the grams of DEPTH + 1 bytes of its rows, one
shuffle adds them up, and a second one brings the grams of each HEAD bytes before together. From there on every
context of at least HEAD bytes is solved where its grams lie, in chunks of whole contexts of CHUNK grams; Pw at
HEAD is added up by the JVM, exactly, to the 65,280 nodes at depth 1 and the 255 at the root that the driver sees at most,
whatever the corpus holds. A context of HEAD = 2 bytes has at most 256 ** (DEPTH - 1) grams, 16.8 million, which bounds
what a task holds; no group is as large as a byte's share of the corpus.
The result is a code length for every gram seen, in whole units of 2 ** -20 bit, so that sums don't depend on their order.
It is broadcast up to BROADCAST_GRAMS grams of 12 bytes; beyond that, the grams of the texts are joined with it by a shuffle.

Defined results:
- Null or empty text: 0 bytes and 0 bits, bits_per_byte null. Long texts are read as a whole.
- A document starts after DEPTH zero bytes. Every row counts, repeated ones as often as they occur,
  whether their id is null or not; equal texts get equal results. Only the id and text columns are read.
- Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

DEPTH = 4
HEAD = 2
BROADCAST_GRAMS = 4_000_000
CHUNK = 1 << 20
#: Units of code length in a bit.
UNIT = 1 << 20
#: Grams that a task holds before it passes its counts on.
_HOLD = 2_000_000
SCHEMA = "doc_id bigint, bytes bigint, bits double, bits_per_byte double"


def grams_of(raw: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For each byte: the byte before in bits 8 * depth up, those before it below, the byte itself in the last 8."""
    n = len(at) - 1
    own = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1) * depth, np.diff(at))
    padded = np.zeros(len(raw) + n * depth, np.uint8)
    padded[own] = raw
    key = np.zeros(len(raw), K.U)
    for k in range(1, depth + 1):
        key = (key << K.U(8)) | padded[own - k]
    return (key << K.U(8)) | raw


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _counts(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, counts = _tally(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["_g", "_n"])

        size = 0
        for batch in batches:
            at, data = K.buffers(K.plain(batch.column(0)))
            for a, b in K.slices(at, 1 << 21):
                edge = at[a : b + 1]
                keys, counts = np.unique(grams_of(data[edge[0] : edge[-1]], edge - edge[0], depth), return_counts=True)
                held.append((keys, counts))
                size += len(keys)
                if size > _HOLD:
                    keys, counts = _tally(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                    held[:] = [(keys, counts)]
                    size = len(keys)
                    if size > _HOLD // 2:
                        yield out()
                        size = 0
        if held:
            yield out()

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of arguments from 1/2 on: Stirling's series after eight steps of the recurrence."""
    x = np.asarray(x, float)
    p = np.ones_like(x)
    for k in range(8):
        p *= np.where(x < 1e6, x + k, 1)
    y = np.where(x < 1e6, x + 8, x)
    s = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) / y - np.log(p)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


def _levels(keys: np.ndarray, counts: np.ndarray, bit: int, depth: int, head: int):
    """For one of the eight decisions: per depth from DEPTH to head (node of each entry, n0, n1, log KT, log Pw), and each gram's entry."""
    x = (keys & K.U(255)).astype(np.int64)
    node = (1 << bit) | (x >> (8 - bit))
    one = (x >> (7 - bit)) & 1
    ident = ((keys >> K.U(8)) << K.U(8)) | node.astype(K.U)
    new = np.concatenate(([True], ident[1:] != ident[:-1]))
    entry = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    ident = ident[first]
    n0, n1 = np.add.reduceat(counts * (1 - one), first).astype(float), np.add.reduceat(counts * one, first).astype(float)
    kt = log_kt(n0, n1)
    levels = [(None, ident, n0, n1, kt, kt)]
    for d in range(depth - 1, head - 1, -1):
        _, ident, n0, n1, _, pw = levels[-1]
        up = ((ident >> K.U(16)) << K.U(8)) | (ident & K.U(255))
        ident, inverse = np.unique(up, return_inverse=True)
        n0, n1 = np.bincount(inverse, n0), np.bincount(inverse, n1)
        kt = log_kt(n0, n1)
        levels.append((inverse, ident, n0, n1, kt, np.log(0.5) + np.logaddexp(kt, np.bincount(inverse, pw))))
    return levels, entry, one


def heads(keys: np.ndarray, counts: np.ndarray, depth: int, head: int) -> tuple[np.ndarray, ...]:
    """(context of head bytes << 8 | node, n0, n1, log Pw) of sorted grams of whole contexts."""
    rows = [_levels(keys, counts, bit, depth, head)[0][-1] for bit in range(8)]
    return tuple(np.concatenate([r[k] for r in rows]) for k in (1, 2, 3, 5))


def above(ident: np.ndarray, n0: np.ndarray, n1: np.ndarray, pw: np.ndarray, head: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(a, prediction of 1) by context << 8 | node, for depths 0 .. head - 1; given are the summed counts and log Pw of depth head.

    pw is that of all children of a context of head - 1 bytes, added up.
    """
    out = []
    for d in range(head - 1, -1, -1):
        size = 256 ** (d + 1)
        m0, m1, q = np.bincount(ident, n0, size), np.bincount(ident, n1, size), np.bincount(ident, pw, size)
        kt = log_kt(m0, m1)
        whole = np.log(0.5) + np.logaddexp(kt, q)
        out.append((np.exp(np.log(0.5) + kt - whole), (m1 + 0.5) / (m0 + m1 + 1)))
        at = np.flatnonzero(m0 + m1)  # a context that doesn't occur has Pw 1
        ident, n0, n1, pw = ((at >> 16) << 8) | (at & 255), m0[at], m1[at], whole[at]
    return out[::-1]


def code_lengths(keys: np.ndarray, counts: np.ndarray, upper: list[tuple[np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """Bits of each gram's last byte in its context; sorted grams of whole contexts of as many bytes as upper has depths."""
    bits, head = np.zeros(len(keys)), len(upper)
    for bit in range(8):
        levels, entry, one = _levels(keys, counts, bit, depth, head)
        _, ident, n0, n1, _, _ = levels[0]
        p, at, node = (n1 + 0.5) / (n0 + n1 + 1), np.arange(len(ident)), (ident & K.U(255)).astype(np.int64)
        context = (ident >> K.U(8)).astype(np.int64)
        for inverse, _, n0, n1, kt, pw in levels[1:]:
            at = inverse[at]
            a, own = np.exp(np.log(0.5) + kt - pw), (n1 + 0.5) / (n0 + n1 + 1)
            p = a[at] * own[at] + (1 - a[at]) * p
        for d in range(head - 1, -1, -1):
            where = (context >> 8 * (depth - d)) << 8 | node
            a, own = upper[d][0][where], upper[d][1][where]
            p = a * own + (1 - a) * p
        bits -= np.log2(np.where(one == 1, p[entry], 1 - p[entry]))
    return bits


def _contexts(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and counts in chunks of whole contexts (the bits from shift up); the batches are sorted by gram."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy().view(K.U), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= CHUNK:
            keys, counts = (np.concatenate([h[c] for h in held]) for c in range(2))
            last = keys >> K.U(shift)
            cut = int(np.flatnonzero(last != last[-1])[-1]) + 1 if last[0] != last[-1] else 0
            if cut:
                yield keys[:cut], counts[:cut]
            held = [(keys[cut:], counts[cut:])]
            size = 0  # a context of many chunks is put together a chunk at a time
    if held:
        yield tuple(np.concatenate([h[c] for h in held]) for c in range(2))


class Table:
    """Code lengths by gram: open addressing, built where it is first used."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray):
        self.keys, self.bits, self.slots = keys, bits.astype(np.int32), None

    def __getstate__(self):
        return self.keys, self.bits

    def __setstate__(self, state):
        self.keys, self.bits = state
        self.slots = None

    def _build(self) -> None:
        size = 1 << max(4, (3 * len(self.keys)).bit_length())
        self.mask = K.U(size - 1)
        self.slots, self.values = np.full(size, np.iinfo(np.uint64).max, K.U), np.zeros(size, np.int32)
        left, at = np.arange(len(self.keys)), K.mix(self.keys) & self.mask
        while len(left):
            free = self.slots[at] == np.iinfo(np.uint64).max
            _, first = np.unique(np.where(free, at, size + np.arange(len(at)).astype(K.U)), return_index=True)
            won = first[free[first]]
            self.slots[at[won]], self.values[at[won]] = self.keys[left[won]], self.bits[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + K.U(1)) & self.mask

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Code lengths of grams that all are in the table."""
        if self.slots is None:
            self._build()
        at = K.mix(keys) & self.mask
        out = self.values[at]
        left = np.flatnonzero(self.slots[at] != keys)
        while len(left):
            at[left] = (at[left] + K.U(1)) & self.mask
            out[left] = self.values[at[left]]
            left = left[self.slots[at[left]] != keys[left]]
        return out


def model(docs: DataFrame, *, depth: int = DEPTH, text_col: str = "text") -> DataFrame:
    """(_g, _bits): the code length of every gram of the documents in units, from the counts of them all."""
    head = min(HEAD, depth)
    shift = 8 * (depth - head + 1)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"))
    counts = texts.mapInArrow(_counts(depth), "_g bigint, _n bigint").groupBy("_g").agg(F.sum("_n").alias("_n"))
    # the grams of one head lie in one task, for both passes
    counts = K.cut(counts.repartition(F.shiftrightunsigned("_g", shift)).sortWithinPartitions("_g"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _contexts(batches, shift):
            ident, n0, n1, pw = heads(keys, n, depth, head)
            yield pa.RecordBatch.from_arrays([pa.array((ident >> K.U(16) << K.U(8) | ident & K.U(255)).astype(np.int64)), pa.array(n0.astype(np.int64)), pa.array(n1.astype(np.int64)), pa.array(pw)], ["_i", "n0", "n1", "pw"])

    rows = counts.mapInArrow(first, "_i bigint, n0 bigint, n1 bigint, pw double").groupBy("_i")
    # decimals: their sum doesn't depend on which task ends first
    found = rows.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(F.col("pw").cast("decimal(28,9)")).cast("double").alias("pw")).orderBy("_i").toArrow()
    ident, n0, n1, pw = (found.column(c).to_numpy() for c in range(4))
    upper = docs.sparkSession.sparkContext.broadcast(above(ident, n0.astype(float), n1.astype(float), pw, head))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _contexts(batches, shift):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.rint(code_lengths(keys, n, upper.value, depth) * UNIT).astype(np.int32))], ["_g", "_bits"])

    return K.cut(counts.mapInArrow(second, "_g bigint, _bits int"))


def score(docs: DataFrame, *, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, bytes, bits, bits_per_byte of every document."""
    if not 1 <= depth <= 7:
        raise ValueError("needs a depth from 1 to 7")
    table = model(docs, depth=depth, text_col=text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    if table.limit(broadcast_grams + 1).count() > broadcast_grams:
        return _report(_joined(rows, table, depth))
    flat = table.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Table(flat.column(0).to_numpy().view(K.U), flat.column(1).to_numpy()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, data = K.buffers(K.plain(batch.column(1)))
        total = np.zeros(batch.num_rows, np.int64)
        for a, b in K.slices(at):
            edge = at[a : b + 1] - at[a]
            units = np.zeros(int(edge[-1]) + 1, np.int64)
            np.cumsum(shared.value.of(grams_of(data[at[a] : at[b]], edge, depth)), out=units[1:])
            total[a:b] = units[edge[1:]] - units[edge[:-1]]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(total)], ["doc_id", "bytes", "units"])

    return _report(K.arrow_map(rows, work, "doc_id bigint, bytes bigint, units bigint"))


def _report(found: DataFrame) -> DataFrame:
    bits = F.col("units") / UNIT
    return found.select("doc_id", "bytes", F.round(bits, 2).alias("bits"), F.when(F.col("bytes") > 0, F.round(bits / F.col("bytes"), 6)).alias("bits_per_byte"))


def _joined(rows: DataFrame, table: DataFrame, depth: int) -> DataFrame:
    """The same without a broadcast: the grams of each distinct text, told apart by 128 bits, are joined with their code lengths."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, data = K.buffers(K.plain(batch.column(2)))
        keys, parts = [batch.column(c).to_numpy() for c in range(2)], []
        for k in range(batch.num_rows):
            g, n = np.unique(grams_of(data[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]]), depth), return_counts=True)
            parts.append((np.full(len(g), keys[0][k]), np.full(len(g), keys[1][k]), g.view(np.int64), n))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[c] for p in parts])) for c in range(4)], ["_t", "_u", "_g", "_n"])

    tagged = rows.withColumns({"_t": F.xxhash64("_text"), "_u": F.xxhash64(F.lit(1), "_text")})
    texts = tagged.where("_text is not null").select("_t", "_u", "_text").dropDuplicates(["_t", "_u"])
    units = K.arrow_map(texts, spread, "_t bigint, _u bigint, _g bigint, _n bigint").join(table, "_g").groupBy("_t", "_u").agg(F.sum(F.col("_n") * F.col("_bits")).alias("_b"))
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("bigint")
    return tagged.join(units, ["_t", "_u"], "left").select("doc_id", size.alias("bytes"), F.coalesce("_b", F.lit(0)).cast("bigint").alias("units"))
