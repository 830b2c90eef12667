"""Substring dedup with difference-cover anchors.

COVER is a perfect difference set modulo PERIOD: for any two word positions i and j there is a d below
PERIOD with (i + d) and (j + d) both at cover positions. Windows of WINDOW words are hashed only where
the position modulo PERIOD is in COVER (6 of 31), so any passage of MIN_WORDS = WINDOW + PERIOD - 1
words that occurs twice shares an aligned anchor. The first shuffle groups anchors by hash. Around the
anchors that occur more than once, and nowhere else, the match is extended: every window of MIN_WORDS
words that contains such an anchor is hashed, and a second shuffle finds those that occur before. The
union of the windows that aren't first is what repeats. It is exact up to 64-bit hashes: a word is in a
span if and only if it is in a run of MIN_WORDS words that occurs at an earlier place.

Places are ordered by (id, position), words compared as normalised by kernel. A document whose words are
wholly those of an earlier one is found in the first shuffle and needs no windows.

Defined results:
- Null id: kept as it is, neither source nor copy. Null and empty texts, and those under MIN_WORDS words:
  nothing repeats in them.
- Repeated rows (of one id and text) are one document; rows of one id with other texts are documents of
  their own, whose windows are ordered by their first character, then by the text's hash.
- A passage that repeats within its document, even overlapping itself, keeps its first occurrence.
- clean() drops a document of which no word is left; all columns stay, whatever their names.
- Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

PERIOD, COVER, WINDOW = 31, (0, 1, 3, 8, 12, 18), 20
MIN_WORDS = WINDOW + PERIOD - 1
_AT_COVER = np.isin(np.arange(PERIOD), COVER)

SPANS = "doc_id bigint, spans array<struct<start:int,end:int>>, chars bigint"


def _whole(w: K.Words, docs: np.ndarray) -> np.ndarray:
    """Hashes of all words of some documents."""
    sums = np.zeros(len(w.hashes) + 1, K.U)
    np.cumsum(K.mix(w.hashes) * K.powers(K._GRAM_BASE, len(w.hashes)), out=sums[1:])
    back = K.powers(K._inverse(K._GRAM_BASE), len(w.hashes) + 1)
    return K.mix((sums[w.bounds[docs + 1]] - sums[w.bounds[docs]]) * back[w.bounds[docs]])


def _mark(whole: np.ndarray) -> np.ndarray:
    """In the place of an anchor's position: 31 bits of a whole document's hash, as a negative number."""
    return (-1 - (whole >> K.U(33)).astype(np.int64)).astype(np.int32)


def _anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(_h, _id, _p) of the anchors, and one row with the hash of all words of a document and its mark."""
    ids, parts = batch.column(0).to_numpy(), []
    for w in K.words(batch.column(1)):
        n = np.diff(w.bounds)
        if not (n >= MIN_WORDS).any():
            continue
        h, ok = K.grams(w, WINDOW), K.fits(w, WINDOW)
        docs, place = w.docs[: len(h)], w.place[: len(h)]
        at = np.flatnonzero(ok & _AT_COVER[place % PERIOD] & (n[docs] >= MIN_WORDS))
        parts.append((h[at], ids[w.first + docs[at]], place[at].astype(np.int32)))
        long = np.flatnonzero(n >= MIN_WORDS)
        whole = _whole(w, long)
        parts.append((whole, ids[w.first + long], _mark(whole)))
    cols = [np.concatenate([p[c] for p in parts]) for c in range(3)] if parts else [np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1]), pa.array(cols[2])], ["_h", "_id", "_p"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (_h, _id): the anchors whose hash occurs again; of whole documents, all but the first."""
    held = None  # the last row so far, of which it isn't known whether the next has its hash
    for batch in batches:
        if not batch.num_rows:
            continue
        h, i, p = (batch.column(c).to_numpy() for c in range(3))
        if held is not None:
            h, i, p = (np.concatenate(([x], y)) for x, y in zip(held, (h, i, p)))
        same = h[1:] == h[:-1]
        prev = np.concatenate(([held is not None and held[3]], same))
        again = prev[:-1] | same
        other = np.concatenate(([held is None or held[4]], i[1:] != i[:-1]))  # a repeated row isn't a copy of itself
        at = np.flatnonzero(np.where(p[:-1] < 0, prev[:-1] & other[:-1], again))
        held = (h[-1], i[-1], p[-1], bool(prev[-1]), bool(other[-1]))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(p[at])], ["_id", "_p"])
    if held is not None and held[3] and (held[4] or held[2] >= 0):
        yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int32())], ["_id", "_p"])


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(_h, _id, _t, _s) of the windows around shared anchors; _s: their characters (see _pack), inverted for a whole copy."""
    ids, t, places, parts = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3), []
    for w in K.words(batch.column(1)):
        h, ok = K.grams(w, MIN_WORDS), K.fits(w, MIN_WORDS)
        char = np.cumsum((w.raw & 0xC0) != 0x80)
        near = np.zeros(len(w.hashes) + 1, np.int32)
        copies, mark = [], _mark(_whole(w, np.arange(len(w.bounds) - 1)))
        for k in range(len(w.bounds) - 1):
            a, b = int(w.bounds[k]), int(w.bounds[k + 1])
            p = places[w.first + k].values.to_numpy()
            if b - a < MIN_WORDS:
                continue
            if (p == mark[k]).any():
                copies.append(k)
                continue
            p = p[(p >= 0) & (p <= b - a - WINDOW)]  # rows of one id with other texts have places of their own
            np.add.at(near, a + np.maximum(p - (MIN_WORDS - WINDOW), 0), 1)
            np.add.at(near, a + p + 1, -1)
        at = np.flatnonzero((np.cumsum(near)[: len(h)] > 0) & ok)
        docs = np.searchsorted(w.bounds, at, side="right") - 1
        k = np.array(copies, np.int64)
        docs, first, last = np.concatenate((docs, k)), np.concatenate((at, w.bounds[k])), np.concatenate((at + MIN_WORDS - 1, w.bounds[k + 1] - 1))
        base = char[w.at[docs]] if len(docs) else np.zeros(0, np.int64)
        span = _pack(char[w.starts[first]] - base, char[w.ends[last] - 1] - base + 1)
        span[len(at) :] = ~span[len(at) :]
        parts.append((np.concatenate((h[at], K.mix(ids[w.first + k].astype(K.U)))), ids[w.first + docs], t[w.first + docs], span))
    cols = [np.concatenate([p[c] for p in parts]) for c in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), *map(pa.array, cols[1:])], ["_h", "_id", "_t", "_s"])


def _pack(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two places below 2 ** 31 in one number, which sorts by the first."""
    return start.astype(np.int64) << 32 | end


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (_h, _id, _s, _t): all that aren't the first of their hash, and the whole copies."""
    held = None  # the first row of the last hash
    for batch in batches:
        if not batch.num_rows:
            continue
        h, i, t, s = (batch.column(c).to_numpy() for c in range(4))
        if held is not None:
            h, i, t, s = (np.concatenate(([x], y)) for x, y in zip(held, (h, i, t, s)))
        new = np.concatenate(([True], h[1:] != h[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        out = ((i != i[first]) | (t != t[first]) | (s != s[first])) | (s < 0)
        if held is not None:
            out[0] = False  # has been seen
        at = np.flatnonzero(out)
        f = first[-1]
        held = (h[f], i[f], t[f], s[f])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(t[at]), pa.array(np.where(s[at] < 0, ~s[at], s[at]))], ["_id", "_t", "_s"])


def _merge(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Windows of each document to disjoint spans in order."""
    starts, ends, total, bounds = [], [], [], [0]
    for row in batch.column(2):
        v = np.sort(row.values.to_numpy())
        a, b = (v >> 32).astype(np.int32), np.maximum.accumulate((v & 0xFFFFFFFF).astype(np.int32))
        new = np.concatenate(([True], a[1:] > b[:-1]))
        s, e = a[new], b[np.concatenate((new[1:], [True]))]
        starts.append(s)
        ends.append(e)
        total.append(int((e - s).sum()))
        bounds.append(bounds[-1] + len(s))
    spans = pa.StructArray.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], ["start", "end"])
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans), pa.array(total, pa.int64())], ["_id", "_t", "_spans", "_chars"])


def _spans(keyed: DataFrame) -> DataFrame:
    """(_id, _t, _spans, _chars): the spans that repeat an earlier place; _t is the text's hash."""
    anchors = K.arrow_map(keyed, _anchors, "_h bigint, _id bigint, _p int")
    shared = anchors.repartition("_h").sortWithinPartitions("_h", "_id").mapInArrow(_shared, "_id bigint, _p int")
    places = shared.groupBy("_id").agg(F.collect_list("_p").alias("_ps"))
    suspects = keyed.join(places.hint("shuffle_hash"), "_id").select("_id", "_text", F.xxhash64("_text").alias("_t"), "_ps")
    windows = K.arrow_map(suspects, _windows, "_h bigint, _id bigint, _t bigint, _s bigint")
    later = windows.repartition("_h").sortWithinPartitions("_h", "_id", "_s", "_t").mapInArrow(_later, "_id bigint, _t bigint, _s bigint")
    return K.arrow_map(later.groupBy("_id", "_t").agg(F.collect_list("_s").alias("_w")), _merge, "_id bigint, _t bigint, _spans array<struct<start:int,end:int>>, _chars bigint")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (characters from start up to end) that repeat an earlier place, characters in them."""
    found = _spans(K.keyed(docs, id_col, text_col))
    return found.select(F.col("_id").alias("doc_id"), F.col("_spans").alias("spans"), F.col("_chars").alias("chars"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans."""
    raw = text.encode()
    if len(raw) == len(text):
        return K.without(raw, spans)
    return K.without(raw, [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans])


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the spans that repeat an earlier place."""
    spans = K.cut(_spans(K.keyed(docs, id_col, text_col)).select("_id", "_t", "_spans"))
    text, key = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("bigint")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_i"), F.xxhash64(text).alias("_x"))
    both = packed.join(K.small(spans), (F.col("_i") == F.col("_id")) & (F.col("_x") == F.col("_t")), "left").select("_row", "_spans")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = pa.RecordBatch.from_struct_array(batch.column(0))
        column, found = flat.column(flat.schema.get_field_index(text_col)), batch.column(1)
        changed, gone = {}, set()
        for k in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist():
            changed[k] = cut_spans(column[k].as_py(), [(s["start"], s["end"]) for s in found[k].as_py()])
            if not any(c.isalnum() for c in changed[k]):
                gone.add(k)
        flat = K.swap(flat, text_col, changed)
        return flat.take(pa.array([k for k in range(flat.num_rows) if k not in gone], pa.int64())) if gone else flat

    return K.arrow_map(both, work, docs.schema)
