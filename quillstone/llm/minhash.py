"""MinHash near-dedup: universal hash minima, banding, signature verification, components.

A document's set is that of its shingles of SHINGLE words (all its words, if it has fewer). HASHES
functions (a * x + b) >> 32 of the universal multiply-add-shift family give its minima, of which the
signature keeps 16 bits each. Documents of one signature are joined straight away. Of the others,
those that agree on all ROWS minima of one of BANDS bands are compared by signature, within the band's
bucket: a search from member to member links all that are connected by pairs agreeing on at least
THRESHOLD of the minima, so that no pair is dropped however large the bucket, while a bucket of like
copies costs one comparison each. Large-star and small-star join the links to groups.

With 40 bands of 3, a pair of Jaccard similarity 0.5 becomes a candidate with probability 0.995. The
threshold lies below 0.5 by two standard errors, so that such a pair is also verified.

Every row is a vertex of its own, so that texts that share an id are told apart.

Defined results:
- Null id: the row is kept and never grouped. Null or empty text, or one without words: the same.
- Rows of one id and text are one document, which isn't a copy of itself: keep() returns the one whose JSON is least.
- Rows of one id with other texts are documents of their own: each stays unless it is a near copy of
  a document that comes before it, by (id, hash of the text). groups() has a row for each id and group.
- The first document of a group, by (id, hash of the text), stays. Exact copies are groups like any other.
- A text of any length is read whole: its signature has one size. Its shingles are held at once, at 16 bytes a word.
- Only the id and text columns are read; keep() returns all columns, whatever their names.
- Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm import kernel as K
from quillstone.llm.components import components

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 40, 3, 0.4
HASHES = BANDS * ROWS
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=K.U) * K.U(2) + K.U(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=K.U) * K.U(2)


def _shingles(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents that have words, first shingle of each, shingles as 32 bits)."""
    n = np.diff(w.bounds)
    have = np.flatnonzero(n)
    count = np.where(n[have] < SHINGLE, 1, n[have] - SHINGLE + 1)
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), K.U)
    long = n[have] >= SHINGLE
    if long.any():
        out[np.repeat(long, count)] = K.grams(w, SHINGLE)[K.fits(w, SHINGLE)]
    for m in range(1, SHINGLE):
        at = n[have] == m
        if at.any():
            out[first[at]] = K.grams(w, m)[w.bounds[have[at]]]
    return have, first, out >> K.U(32)


def signature(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have words, their minima as rows of 16-bit numbers)."""
    have, first, x = _shingles(w)
    out = np.empty((len(have), HASHES), np.uint16)
    if len(have):
        v = np.empty_like(x)
        for j in range(HASHES):
            np.multiply(x, _A[j], out=v)
            v += _B[j]
            out[:, j] = np.minimum.reduceat(v, first) >> K.U(32)
    return have, out


def signatures(keyed: DataFrame) -> DataFrame:
    """(_v, _id, _t, _sig) of (_id, _text): one row for each that has words; _v numbers them, _t is the text's hash."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, sigs = [], []
        for w in K.words(batch.column(3)):
            have, sig = signature(w)
            rows.append(w.first + have)
            sigs.append(sig)
        sig, at = np.concatenate(sigs), pa.array(np.concatenate(rows))
        data = pa.Array.from_buffers(pa.binary(2 * HASHES), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), data], ["_v", "_id", "_t", "_sig"])

    numbered = keyed.select(F.monotonically_increasing_id().alias("_v"), "_id", F.xxhash64("_text").alias("_t"), "_text")
    return K.arrow_map(numbered, work, "_v bigint, _id bigint, _t bigint, _sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _bands(batch: pa.RecordBatch) -> pa.RecordBatch:
    sig = _matrix(batch.column(1)).astype(K.U).reshape(-1, BANDS, ROWS)
    key = np.full(sig.shape[:2], K.U(0), K.U)
    for r in range(ROWS):
        key = (key << K.U(16)) | sig[:, :, r]
    key = K.mix(key ^ K.mix(np.arange(1, BANDS + 1, dtype=K.U))[None, :])
    return pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["_key", "_id"])


def links(ids: np.ndarray, sigs: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """A star for each set of members connected by pairs that agree in at least so many minima."""
    left = np.arange(len(ids))
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            u = front.pop()
            near = (sigs[left] == sigs[u]).sum(axis=1) >= least
            if near.any():
                found = left[near]
                for v in found.tolist():
                    yield int(ids[root]), int(ids[v])
                front.extend(found.tolist())
                left = left[~near]


def _buckets(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sigs = None, [], []

        def close() -> list[tuple[int, int]]:
            return list(links(np.concatenate(ids), np.concatenate(sigs), least)) if key is not None else []

        for batch in batches:
            if not batch.num_rows:
                continue
            k, i, s = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            cuts = np.flatnonzero(np.diff(k)) + 1
            edges: list[tuple[int, int]] = []
            for a, b in zip([0, *cuts], [*cuts, len(k)]):
                if key is None or k[a] != key:
                    edges += close()
                    key, ids, sigs = k[a], [], []
                ids.append(i[a:b])
                sigs.append(s[a:b])
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])
        if edges := close():
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return run


def groups(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the least id of the group."""
    found = _groups(K.cut(signatures(K.keyed(docs, id_col, text_col))), threshold)
    return found.select(F.col("_id").alias("doc_id"), F.col("_first._id").alias("group_id")).distinct()


def _groups(sigs: DataFrame, threshold: float) -> DataFrame:
    """(_id, _t, _first) of the rows of groups of several documents; _first: the (_id, _t) of the group's first."""
    heads = sigs.groupBy("_sig").agg(F.min("_v").alias("_head"))
    copies = sigs.select("_v", "_sig").join(heads, "_sig").where("_v <> _head").select(F.col("_head").alias("a"), F.col("_v").alias("b"))
    heads = heads.select(F.col("_head").alias("_id"), "_sig")
    bands = K.arrow_map(heads, _bands, "_key bigint, _id bigint")
    shared = bands.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_key"))).where("_n > 1").select("_key", "_id")
    full = shared.join(heads, "_id").select("_key", "_id", "_sig")
    full = full.repartition("_key").sortWithinPartitions("_key", "_id")
    edges = full.mapInArrow(_buckets(int(np.ceil(threshold * HASHES))), "a bigint, b bigint")
    roots = components(edges.union(copies))
    members = K.cut(sigs.select("_v", "_id", "_t").join(roots, F.col("_v") == roots["id"]).select("_id", "_t", "root"))
    one = F.struct("_id", "_t")
    first = K.cut(members.groupBy("root").agg(F.min(one).alias("_first"), F.max(one).alias("_last")).where("_first <> _last").select("root", "_first"))
    return members.join(K.small(first), "root").select("_id", "_t", "_first")


def keep(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the first of each group of near copies; all columns stay."""
    sigs = K.cut(signatures(K.keyed(docs, id_col, text_col)))
    gone = _groups(sigs, threshold).where("_id <> _first._id or _t <> _first._t")
    gone = K.cut(gone.select(F.col("_id").alias("_gone"), F.col("_t").alias("_gone_t")).distinct())
    names = [F.col(f"`{c}`") for c in docs.columns]
    key, text = F.col(f"`{id_col}`").cast("bigint"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    # columns named by their table: docs may have some of the same name
    kept = docs.join(K.small(gone), (key == gone["_gone"]) & (text == gone["_gone_t"]), "left_anti")
    again = K.cut(docs.where(key.isNotNull()).groupBy(key.alias("_again"), text.alias("_again_t")).count().where("count > 1").select("_again", "_again_t"))
    if again.isEmpty():
        return kept
    twice = kept.join(K.small(again), (key == again["_again"]) & (text == again["_again_t"]), "left_semi")
    row = F.to_json(F.struct(*names))
    least = K.cut(twice.groupBy(key.alias("_least"), text.alias("_least_t")).agg(F.min(row).alias("_json")))
    once = twice.join(K.small(least), (key == least["_least"]) & (text == least["_least_t"]) & (row == least["_json"]), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(K.small(again), (key == again["_again"]) & (text == again["_again_t"]), "left_anti").union(once)
