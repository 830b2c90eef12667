"""Vectorised word and hash kernels over Arrow string columns, and the plumbing the operators share.

Words are maximal runs of letters, digits and marks (Unicode categories L, N, Mn and Mc); all other
characters separate, emoji, signs and full-width punctuation among them, and so do variation selectors and
marks for symbols. Scripts written without spaces (SINGLES: Han, kana, Thai, Lao, Khmer, Myanmar and
the like) have no runs: each of their letters, digits and marks is a word of its own. Upper case is folded
by the table of simple lower-case forms, wherever the lower-case letter has as many bytes, so that a word's byte
positions are those of the text itself; the 25 letters that change their length (such as the Kelvin
sign, the capital sharp s and the dotted capital I) stay as they are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
#: Bytes of text that are worked on at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 19
#: Bytes up to which a table is broadcast to a join; beyond that it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_rng = np.random.default_rng(20240607)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_GRAM_BASE = U(0xD6E8FEB86659FD93)


def _inverse(odd: int) -> U:
    return U(pow(int(odd), -1, 1 << 64))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
#: Code points of scripts without spaces between words, first to last.
SINGLES = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303B), (0x3040, 0x30FF), (0x3100, 0x312F),
    (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA48F), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
#: Marks that belong to symbols, not to words.
NO_MARKS = ((0x20D0, 0x20FF), (0xFE00, 0xFE0F))
_powers: dict[int, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, SLICE_BYTES + 1), base, dtype=U)
        kept[0] = 1
        np.cumprod(kept, out=kept)
        _powers[int(base)] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64 over all (public splitmix64 constants)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@cache
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """By code point below 2 ** 18: 0 for what separates, 1 for what is in runs, 2 for a word of its own; and the folded code point."""
    kind, fold = np.zeros(1 << 18, np.uint8), np.arange(1 << 18, dtype=np.uint32)
    wide = lambda c: 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    for c in range(0x80, 0x20000):
        x = chr(c)
        g = category(x)
        if g[0] in "LN" or g == "Mn" or g == "Mc":
            kind[c] = 1
            if g in ("Lu", "Lt") or g[0] == "N":
                low = x.lower()
                if low != x and len(low) == 1 and wide(ord(low)) == wide(c):
                    fold[c] = ord(low)
    kind[0x20000:] = 1
    for a, b in SINGLES:
        kind[a : b + 1] *= 2
    for a, b in NO_MARKS:
        kind[a : b + 1] = 0
    return kind, fold


def word_sql(text: str) -> str:
    """DuckDB: the words of an expression, by the same rule."""
    span = lambda pairs: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in pairs)
    apart = f"regexp_replace(regexp_replace(lower({text}), '[{span(NO_MARKS)}]', ' ', 'g'), '([{span(SINGLES)}])', ' \\1 ', 'g')"
    return f"regexp_extract_all({apart}, '[\\p{{L}}\\p{{N}}\\p{{Mn}}\\p{{Mc}}{span(SINGLES[-1:])}]+')"


def fold_and_mark(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with case folded, which of them belong to words, and where words of a single character start and end."""
    low = _FOLD[raw]
    word = _WORD[low]
    lead = np.flatnonzero(raw >= 0xC2)
    if not len(lead):
        return low, word, lead, lead
    kind, fold = _unicode()
    first, starts, ends = raw[lead], [], []
    for size, least, most in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF5)):
        at = lead[(first >= least) & (first < most)]
        if not len(at):
            continue
        code = (raw[at] & (0x7F >> size)).astype(np.uint32)
        for k in range(1, size):
            code = code << 6 | (raw[at + k] & 0x3F)
        if size == 4:
            at, code = at[code < len(kind)], code[code < len(kind)]
        own = kind[code]
        inside = at[own > 0]
        for k in range(size):
            word[inside + k] = True
        if len(one := at[own == 2]):
            starts.append(one)
            ends.append(one + size)
        new = fold[code]
        if len(up := np.flatnonzero(new != code)):
            at, new = at[up], new[up]
            for k in range(size - 1, 0, -1):
                low[at + k] = 0x80 | (new & 0x3F)
                new = new >> 6
            low[at] = (0xF00 >> size & 0xFF) | new
    none = lead[:0]
    return low, word, np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none


@dataclass
class Words:
    """The words of the documents first .. first + len(bounds) - 2 of a batch.

    starts, ends: byte positions in low; hashes: one for each word; bounds: document k has the words
    bounds[k] .. bounds[k + 1]; at: the byte at which each document starts.
    """

    first: int
    raw: np.ndarray
    low: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        """The document, counted from first, of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @property
    def place(self) -> np.ndarray:
        """The number of each word in its document, from 0."""
        return np.arange(len(self.starts)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def string(self, a: int, b: int) -> bytes:
        """Words a .. b - 1, normalised and joined by spaces."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b]))


def plain(column: pa.Array) -> pa.StringArray:
    """A contiguous string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a plain array, without a copy."""
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(at: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about size bytes, one document at least."""
    k, n = 0, len(at) - 1
    while k < n:
        to = max(k + 1, int(np.searchsorted(at, at[k] + size, side="right")) - 1)
        yield k, min(to, n)
        k = to


def words(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a string column, slice by slice; every document is in exactly one slice."""
    at, data = buffers(plain(column))
    for a, b in slices(at, size):
        raw = data[at[a] : at[b]]
        edge = at[a : b + 1] - at[a]
        low, mark, single, after_single = fold_and_mark(raw)
        flag = np.empty(len(raw) + 1, np.int8)
        flag[:-1], flag[-1] = mark, 0
        before = np.empty(len(raw) + 1, np.int8)
        before[0], before[1:] = 0, mark
        inner = edge[(edge > 0) & (edge < len(raw))]
        before[inner] = 0  # a document's first byte has no word before it
        before[single] = before[after_single] = 0
        starts = np.flatnonzero((flag == 1) & (before == 0))
        after = np.zeros(len(raw) + 1, np.int8)
        after[:-1] = flag[1:]
        after[inner - 1] = 0
        after[single[single > 0] - 1] = after[after_single - 1] = 0
        ends = np.flatnonzero((flag == 1) & (after == 0)) + 1
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum(_BYTE_CODE[low] * powers(_BASE, len(raw)), out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * powers(_inverse(_BASE), len(raw) + 1)[starts] if len(starts) else np.zeros(0, U))
        yield Words(a, raw, low, edge, starts, ends, h, np.searchsorted(starts, edge))


def grams(w: Words, n: int) -> np.ndarray:
    """Hashes of n words from each word on; those that leave their document are without meaning (see fits)."""
    m = len(w.hashes)
    if m < n:
        return np.zeros(0, U)
    sums = np.zeros(m + 1, U)
    np.cumsum(w.hashes * powers(_GRAM_BASE, m), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(_inverse(_GRAM_BASE), m - n + 1))


def fits(w: Words, n: int) -> np.ndarray:
    """Whether n words from each of the first len - n + 1 words on are in one document."""
    m = len(w.hashes) - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    end = np.repeat(w.bounds[1:], np.diff(w.bounds))[:m]
    return np.arange(m) + n <= end


def give_back() -> None:
    """Returns free memory to the system at the end of a task: workers live on, and so would what they once held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows and (out := work(batch)) is not None:
                    yield out
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def shared(spark: SparkSession) -> None:
    """Makes sure that checkpoints have a folder: the cluster's own, or one of this machine on a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="quillstone-")
    sc.setCheckpointDir(folder)


_open_folders: ContextVar[list[str] | None] = ContextVar("_open_folders", default=None)


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the shared checkpoint folder; later reads depend on no executor."""
    shared(df.sparkSession)
    out = df.checkpoint()
    if (held := _open_folders.get()) is not None:
        held.append(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Takes a folder away, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is cut within is removed at the end: for a block that has written its result."""
    held: list[str] = []
    token = _open_folders.set(held)
    try:
        yield
    finally:
        _open_folders.reset(token)
        for path in held:
            remove(spark, path)


_WIDTH = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.DateType: 4}


def _bytes_of(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(f.dataType, value[f.name]) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        each = kind.elementType
        if isinstance(each, T.StructType) and all(type(f.dataType) in _WIDTH for f in each.fields):
            return 16 + F.coalesce(F.size(value), F.lit(0)) * (8 + sum(8 for _ in each.fields))
        if type(each) in _WIDTH:
            return 16 + F.coalesce(F.size(value), F.lit(0)) * _WIDTH[type(each)]
        return 16 + F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), lambda a, x: a + _bytes_of(each, x)), F.lit(0))
    if isinstance(kind, T.StringType | T.BinaryType):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0))
    return F.lit(_WIDTH[type(kind)])


def size_of(df: DataFrame) -> int:
    """Bytes of the values of a table, at 16 a row more: what it takes when it is held as a whole."""
    row = sum((_bytes_of(f.dataType, F.col(f"`{f.name}`")).cast("bigint") for f in df.schema.fields), F.lit(16).cast("bigint"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def small(table: DataFrame, limit: int | None = None) -> DataFrame:
    """The table with a hint to broadcast it if it has at most limit bytes; the caller has cut it, so that summing is cheap."""
    return F.broadcast(table) if size_of(table) <= (BROADCAST_BYTES if limit is None else limit) else table


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id bigint, _text string) of the rows that have an id: no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).where("_id is not null")


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places, and places after the last, of the stretches where mask holds."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """A document's text without byte spans; of the white space on both sides of a hole one side stays."""
    out, at = [], 0
    for a, b in spans:
        left = raw[at:a]
        if out and left[:1].isspace() and (not out[-1] or out[-1][-1:].isspace()):
            left = left.lstrip()
        out.append(left)
        at = b
    left = raw[at:]
    if out and left[:1].isspace() and (not out[-1] or out[-1][-1:].isspace()):
        left = left.lstrip()
    out.append(left)
    return b"".join(out).decode("utf-8", "replace")


def swap(batch: pa.RecordBatch, name: str, changed: dict[int, str]) -> pa.RecordBatch:
    """The batch with other texts in some rows of a string column."""
    if not changed:
        return batch
    k = batch.schema.get_field_index(name)
    rows = sorted(changed)
    mask = np.zeros(batch.num_rows, bool)
    mask[rows] = True
    column = batch.column(k)
    new = pc.replace_with_mask(column, pa.array(mask), pa.array([changed[r] for r in rows], column.type))
    return batch.set_column(k, batch.schema.field(k), new)
