"""Benchmark decontamination: scan training text for the normalised n-grams of test items.

The n-grams (n words, see kernel) of all benchmark items make a hash set. Every window of n words of
every document is looked up in it, each hit is verified word for word, and the words under verified
windows are taken out. A document of which at least drop_share of the words is hit goes as a whole.
The set is broadcast while it takes at most broadcast_bytes (see kernel.size_of); a larger one is joined with
the windows by a shuffle on the hash, with the same result, behind a Bloom filter of at most 64 MB which
is broadcast, so that of the windows of clean text few are shuffled.

Defined results:
- In scripts without spaces every character is a word (see kernel), so that a gram is n characters.
- An item of fewer than n words counts as one gram of all its words; one of fewer than min_words
  words is ignored (it would be found everywhere), as are null and empty items.
- A null or empty text, and any document without a hit, stays as it is; so does every other column,
  whatever its name. A null id is no obstacle.
- Repeated rows are treated alike, each for itself; repeated items count once for each item id.
- Empty tables: no documents give none, and without items nothing is hit.
- A text of any length is scanned whole, in linear time; what it takes is some 60 bytes a character.
- Words that items share are taken out once; overlapping and touching windows make one span.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

N = 8
MIN_WORDS = 5
DROP_SHARE = 0.5
BROADCAST_BYTES = 64 << 20
_BLOOM_BITS = 29
_BLOCK = 1 << 16
_BITS = 22

REPORT = "doc_id bigint, item_ids array<bigint>, hit_words bigint, words bigint, dropped boolean"


def item_grams(benchmark: DataFrame, n: int, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(_n, _h, _gram, _items): every distinct gram of the items and the items that hold it."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        rows: list[tuple] = []
        for w in K.words(batch.column(1)):
            for k in range(len(w.bounds) - 1):
                a, b = int(w.bounds[k]), int(w.bounds[k + 1])
                m = min(n, b - a)
                if b - a >= max(1, min_words):
                    rows += [(m, w.string(i, i + m), ids[w.first + k]) for i in range(a, b - m + 1)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["_n", "_gram", "_item"])

    found = K.arrow_map(K.keyed(benchmark, id_col, text_col), work, "_n int, _gram binary, _item bigint")
    return found.groupBy("_n", "_gram").agg(F.array_sort(F.collect_set("_item")).alias("_items"))


class Gate:
    """Grams by length, as sorted hashes behind a bitmap, with what verifies a hit."""

    def __init__(self, rows: list[tuple[int, bytes, list[int]]]):
        self.items = {bytes(g): items for _, g, items in rows}
        by_n: dict[int, list[bytes]] = defaultdict(list)
        for m, g, _ in rows:
            by_n[m].append(bytes(g))
        self.tables = []
        for m, found in sorted(by_n.items()):
            # one gram a document: of the windows of a slice, those that fit in a document
            h = np.unique(np.concatenate([K.grams(w, m)[K.fits(w, m)] for w in K.words(pa.array([g.decode() for g in found]))]))
            bits = np.zeros(1 << _BITS, bool)
            bits[h >> K.U(64 - _BITS)] = True
            self.tables.append((m, h, bits))

    def hits(self, w: K.Words) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, words, items) of each verified window."""
        for m, table, bits in self.tables:
            g = K.grams(w, m)
            if not len(g):
                continue
            at = np.flatnonzero(bits[g >> K.U(64 - _BITS)])
            at = at[table[np.minimum(np.searchsorted(table, g[at]), len(table) - 1)] == g[at]]
            if len(at):
                for i in at[K.fits(w, m)[at]].tolist():
                    if (items := self.items.get(w.string(i, i + m))) is not None:
                        yield i, m, items


def _found(column: pa.Array, gate: Gate) -> Iterator[tuple[int, list[tuple[int, int]], set[int], int, int, bytes]]:
    """(row, byte spans, items, words hit, words, bytes) of each document with a hit."""
    for w in K.words(column):
        cover, items = np.zeros(len(w.starts) + 1, np.int32), defaultdict(set)
        for i, m, who in gate.hits(w):
            cover[i] += 1
            cover[i + m] -= 1
            items[int(np.searchsorted(w.bounds, i, side="right")) - 1].update(who)
        hit = np.cumsum(cover)[:-1] > 0
        for k, who in items.items():
            a, b = int(w.bounds[k]), int(w.bounds[k + 1])
            first, last = K.runs(hit[a:b])
            base = int(w.at[k])
            spans = [(int(w.starts[a + s]) - base, int(w.ends[a + e - 1]) - base) for s, e in zip(first, last)]
            yield w.first + k, spans, who, int(hit[a:b].sum()), b - a, w.raw[base : int(w.at[k + 1])].tobytes()


def _gate(docs: DataFrame, benchmark: DataFrame, n: int, min_words: int, item_id: str, item_text: str, limit: int):
    """(broadcast gate, None), or (None, grams) if there are too many to broadcast."""
    found = K.cut(item_grams(benchmark, n, min_words, item_id, item_text))
    if K.size_of(found) > limit:
        return None, found
    gate = Gate([(r[0], r[1], r[2]) for r in found.collect()])
    return docs.sparkSession.sparkContext.broadcast(gate), None


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a Bloom filter of 2 ** bits."""
    return h >> K.U(64 - bits), K.mix(h) >> K.U(64 - bits)


def bloom(table: DataFrame, bits: int) -> np.ndarray:
    """A packed Bloom filter of the column _h: each task fills its own, and blocks of them are joined by OR."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy().view(K.U), bits):
                np.bitwise_or.at(own, at >> K.U(3), (1 << (at & K.U(7)).astype(np.uint8)).astype(np.uint8))
        blocks = own.reshape(-1, min(_BLOCK, len(own)))
        used = np.flatnonzero(blocks.any(axis=1))
        for k in used.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([blocks[k].tobytes()])], ["_k", "_b"])

    def join(t: pa.Table) -> pa.Table:
        return pa.table({"_k": t.column("_k").slice(0, 1), "_b": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in t.column("_b").to_pylist()]).tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, block in table.select("_h").mapInArrow(fill, "_k bigint, _b binary").groupBy("_k").applyInArrow(join, "_k bigint, _b binary").collect():
        out[k * len(block) : (k + 1) * len(block)] = np.frombuffer(block, np.uint8)
    return out


def _with_hits(docs: DataFrame, grams: DataFrame, text_col: str) -> DataFrame:
    """docs and, in _grams, the grams found in each text: the way without a broadcast."""
    lengths = [r[0] for r in grams.select("_n").distinct().collect()]

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        ns, text = batch.column(0).to_numpy(), batch.column(1).cast(pa.string())
        out = np.zeros(len(ns), K.U)
        for w in K.words(text):
            for k in range(len(w.bounds) - 1):
                m = int(ns[w.first + k])
                one = K.Words(0, w.raw, w.low, w.at, w.starts, w.ends, w.hashes[w.bounds[k] : w.bounds[k + 1]], w.bounds)
                out[w.first + k] = K.grams(one, m)[0]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], ["_n", "_gram", "_items", "_h"])

    table = K.cut(K.arrow_map(grams, hashes, "_n int, _gram binary, _items array<bigint>, _h bigint"))
    bits = min(_BLOOM_BITS, max(13, (16 * table.count()).bit_length()))
    known = docs.sparkSession.sparkContext.broadcast(bloom(table, bits))

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, parts = batch.column(0).to_numpy(), []
        for w in K.words(batch.column(1)):
            for m in lengths:
                g, ok = K.grams(w, m), K.fits(w, m)
                for at in _places(g, bits):
                    ok &= (known.value[at >> K.U(3)] >> (at & K.U(7)).astype(np.uint8)) & 1 > 0
                if ok.any():
                    parts.append((key[w.first + w.docs[: len(g)][ok]], np.full(int(ok.sum()), m, np.int32), g[ok].view(np.int64)))
        cols = [np.concatenate([p[c] for p in parts]) for c in range(3)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_key", "_n", "_h"])

    text = F.col(f"`{text_col}`")
    keyed = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("_key"), text.alias("_text"))
    hit = K.arrow_map(keyed, windows, "_key bigint, _n int, _h bigint").distinct().join(table, ["_n", "_h"])
    by_text = hit.groupBy("_key").agg(F.collect_set(F.struct("_n", "_gram", "_items")).alias("_grams"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(text).alias("_key"))
    return packed.join(by_text, "_key", "left").select("_row", "_grams")


def _apply(docs: DataFrame, benchmark: DataFrame, one, schema, text_col: str, n: int, min_words: int, item_id: str, item_text: str, limit: int) -> DataFrame:
    shared, grams = _gate(docs, benchmark, n, min_words, item_id, item_text, limit)
    if grams is None:
        return K.arrow_map(docs, lambda batch: one(batch, list(_found(batch.column(batch.schema.get_field_index(text_col)), shared.value))), schema)

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, grams_of = batch.column(0), batch.column(1).to_pylist()
        flat = pa.RecordBatch.from_struct_array(rows)
        column, found = flat.column(flat.schema.get_field_index(text_col)), []
        for k, mine in enumerate(grams_of):
            if mine:
                gate = Gate([(g["_n"], g["_gram"], g["_items"]) for g in mine])
                found += [(k, *rest) for _, *rest in _found(column.slice(k, 1), gate)]
        return one(flat, found)

    return K.arrow_map(_with_hits(docs, grams, text_col), joined, schema)


def report(docs: DataFrame, benchmark: DataFrame, *, n: int = N, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document with a hit: doc_id, the items, words hit, words, whether it goes as a whole."""
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def one(batch: pa.RecordBatch, found: list) -> pa.RecordBatch | None:
        rows = [f[0] for f in found]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), pa.array([sorted(f[2]) for f in found], pa.list_(pa.int64())), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64()), pa.array([f[3] >= drop_share * f[4] for f in found])],
            ["doc_id", "item_ids", "hit_words", "words", "dropped"],
        )

    return _apply(docs, benchmark, one, REPORT, "text", n, min_words, item_id, item_text, broadcast_bytes)


def clean(docs: DataFrame, benchmark: DataFrame, *, n: int = N, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without the hit spans and without the documents that go; all columns stay."""

    def one(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        gone = {f[0] for f in found if f[3] >= drop_share * f[4]}
        batch = K.swap(batch, text_col, {f[0]: K.without(f[5], f[1]) for f in found if f[0] not in gone})
        return batch.take(pa.array([r for r in range(batch.num_rows) if r not in gone], pa.int64())) if gone else batch

    return _apply(docs, benchmark, one, docs.schema, text_col, n, min_words, item_id, item_text, broadcast_bytes)


def sql(n: int = N, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE) -> str:
    """What report(documents, benchmark) gives, for DuckDB: windows compared word for word, without any hash."""
    words = K.word_sql("text")
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, {words} AS w FROM benchmark),
item AS (SELECT item_id, w, least({n}, len(w)) AS n FROM b WHERE len(w) >= {max(1, min_words)}),
gram AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item)),
size AS (SELECT DISTINCT n FROM gram),
win AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size)),
hit AS (SELECT doc_id, i, n, item_id FROM win JOIN gram USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS hit_words FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
who AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids FROM hit GROUP BY doc_id)
SELECT doc_id, item_ids, hit_words, len(w) AS words, hit_words >= {drop_share} * len(w) AS dropped FROM who JOIN cover USING (doc_id) JOIN d USING (doc_id)"""
