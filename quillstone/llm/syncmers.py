"""Document fingerprints by closed syncmers.

The text is normalised: case folded, every stretch between words one blank (see kernel). A k-mer of K_SIZE
normalised bytes is chosen if, of its inner substrings of S_SIZE bytes, the one with the least hash lies at an
edge, first or last. This depends on nothing but the k-mer, so that equal passages choose equal anchors,
wherever they stand; any K_SIZE - S_SIZE + 1 neighbouring k-mers hold one at least, which makes two passages that
share 2 * K_SIZE - S_SIZE bytes share an anchor.

Result: a row for each document: doc_id, positions (characters of the text, from 0, in order), hashes (of the k-mers), n.
Defined results:
- Null and empty texts, and those of fewer than K_SIZE normalised bytes: empty arrays, 0.
- Texts of any length are read whole, in linear time, at some 40 bytes a character. Words of one character each (see
  kernel) have a blank between them only where the text has something there.
- Ties: an edge whose hash equals the least counts as the least, so that uniform stretches are chosen throughout.
- Repeated rows get equal results; a null id is no obstacle; only the id and text columns are read.
- Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

K_SIZE, S_SIZE = 64, 32
SCHEMA = "doc_id bigint, positions array<int>, hashes array<bigint>, n bigint"


def normal(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes of a slice, place of each in its bytes, where each document starts in them)."""
    mark = np.zeros(len(w.raw) + 1, bool)
    edge = np.zeros(len(w.raw) + 1, np.int8)
    edge[w.starts] += 1
    np.add.at(edge, w.ends, -1)
    mark = np.cumsum(edge) > 0
    value = np.append(w.low, np.uint8(32))
    last = np.zeros(len(w.starts), bool)
    last[w.bounds[1:][np.diff(w.bounds) > 0] - 1] = True
    apart = np.append(w.starts[1:], len(w.raw)) > w.ends  # words of one character each may have nothing between them
    gap = w.ends[~last & apart]
    mark[gap] = True
    value[gap] = 32
    place = np.flatnonzero(mark)
    return value[place], place, np.searchsorted(place, w.at)


def hashes(seq: np.ndarray, size: int) -> np.ndarray:
    """Of every substring of so many bytes."""
    m = len(seq) - size + 1
    if m <= 0:
        return np.zeros(0, K.U)
    sums = np.zeros(len(seq) + 1, K.U)
    np.cumsum(K._BYTE_CODE[seq] * K.powers(K._BASE, len(seq)), out=sums[1:])
    return K.mix((sums[size:] - sums[:-size]) * K.powers(K._inverse(K._BASE), m))


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every so many neighbours, by doubling."""
    have, m = 1, h
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def chosen(seq: np.ndarray, k: int = K_SIZE, s: int = S_SIZE) -> np.ndarray:
    """Starts of the closed syncmers of a byte sequence."""
    if len(seq) < k:
        return np.zeros(0, np.int64)
    h = hashes(seq, s)
    low = least(h, k - s + 1)
    n = len(seq) - k + 1
    return np.flatnonzero((h[:n] == low) | (h[k - s :][:n] == low))


def fingerprints(docs: DataFrame, *, k: int = K_SIZE, s: int = S_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, positions, hashes, n of every document."""
    if not 0 < s < k:
        raise ValueError("needs 0 < s < k")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        count, pos, out = np.zeros(n, np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for w in K.words(batch.column(1)):
            seq, place, edge = normal(w)
            at = chosen(seq, k, s)
            doc = np.searchsorted(edge, at, side="right") - 1
            fit = at + k <= edge[doc + 1] if len(at) else np.zeros(0, bool)
            at, doc = at[fit], doc[fit]
            char = np.concatenate(([0], np.cumsum((w.raw & 0xC0) != 0x80)))
            pos.append((char[place[at] + 1] - 1 - char[w.at[doc]]).astype(np.int32))
            out.append(hashes(seq, k)[at].view(np.int64))
            count[w.first : w.first + len(w.bounds) - 1] = np.bincount(doc, minlength=len(w.bounds) - 1)
        offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pos))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out))), pa.array(count)],
            ["doc_id", "positions", "hashes", "n"],
        )

    return K.arrow_map(rows, work, SCHEMA)


def matches(prints: DataFrame) -> DataFrame:
    """doc_id, other_id, shift, anchors, start, end: passages of documents that an earlier place has, by position.

    prints: doc_id, positions, hashes. Every anchor is held against the first place of its hash, by (doc_id, position), so that a
    passage in any number of documents gives one link for each of them, to where it stands first. The anchors of a document
    that agree in the other document and in the shift (position there less position here) make one row, with the least and
    greatest position of theirs; passages of one shift that lie apart share a row. Places within one document match too.
    Null ids, and documents without anchors, match nothing.
    """
    places = prints.where("doc_id is not null").select("doc_id", F.explode(F.arrays_zip("positions", "hashes")).alias("a")).select("doc_id", F.col("a.positions").alias("p"), F.col("a.hashes").alias("h"))
    first = places.groupBy("h").agg(F.min(F.struct("doc_id", "p")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.col("f.doc_id").alias("other_id"), F.col("f.p").alias("q"))
    both = places.join(first, "h").where("doc_id <> other_id or p <> q").withColumn("shift", F.col("q") - F.col("p"))
    return both.groupBy("doc_id", "other_id", "shift").agg(F.count(F.lit(1)).alias("anchors"), F.min("p").alias("start"), F.max("p").alias("end"))
