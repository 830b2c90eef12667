"""BPE encoding and decoding with a given vocabulary.

A piece's symbols form a doubly linked list; a priority queue holds the merge rank and place of every
neighbouring pair that the vocabulary can merge. The least rank is taken, the leftmost first among equals; an
entry whose symbols have since changed is stale and skipped. Decoding concatenates the vocabulary's strings.

The pieces of a slice that are new are merged together: each has its own list and its own queue, held side by side in
arrays, and every round takes the least entry of every queue (merge_all). Pieces of more than SHORT bytes are merged
one by one, with a heap (merge).

Pieces are those of the published byte-level pattern (PATTERN). None of them goes on from a character that isn't white
space to one that is, so that a text may be cut at the start of every stretch of white space (here: of those that
begin with an ASCII blank). The units between these cuts are told apart by Arrow's dictionary encoding; each distinct
unit of a slice is encoded once, and the tokens of all texts are taken by index. Every piece that is merged is
decoded and compared. Units of at most SHORT bytes are kept in a cache of two generations, which takes CACHE_BYTES at
most; longer ones, as in scripts without spaces, are encoded again in every slice.

The vocabulary is a file of base64 tokens and ranks, read on the driver and broadcast (about 1 MB); its
path is a parameter.

Defined results:
- Null text: null tokens, count and round_trip. Empty text: no tokens, 0, true.
- Any text comes back byte for byte; the vocabulary must hold all 256 bytes, or a ValueError is raised.
- A long text is encoded whole. Without white space it is one unit, of which only the pieces' lengths matter: a
  piece of n bytes takes n log n steps and some 200 n bytes.
- Repeated rows get equal results, a null id is no obstacle, only the id and text columns are read.
- Empty tables give empty results.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that the cache of a worker takes at most, by estimate, and the greatest length of what it keeps.
CACHE_BYTES, SHORT = 32 << 20, 64
_ENTRY = 200
#: Bytes of text that are encoded at once; a longer text makes a slice of its own.
SLICE = 2 << 20
_BITS, _PLACE, _NONE = 24, (1 << 32) - 1, np.iinfo(np.int64).max

SCHEMA = "doc_id bigint, tokens array<int>, n_tokens bigint, round_trip boolean"


class _Cache:
    """Encodings by unit; when the bytes of one generation are used up it becomes the old one."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.new, self.old, self.used = limit, {}, {}, 0

    def get(self, key: bytes) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, found: bytes) -> None:
        if len(key) <= SHORT:
            cost = len(key) + len(found) + _ENTRY
            if self.used + cost > self.limit // 2:
                self.old, self.new, self.used = self.new, {}, 0
            self.new[key] = found
            self.used += cost


def _white_ends() -> np.ndarray:
    """Byte strings, packed to 24 bits, with which a character of white space beyond ASCII ends."""
    return np.array(sorted({int.from_bytes(chr(c).encode()[-3:].rjust(3, b"\0"), "big") for c in range(0x80, 0x3001) if chr(c).isspace()}), np.int64)


_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WHITE_ENDS = _white_ends()


def unit_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places at which units start: every text's first byte, and every ASCII blank after a character that isn't white space."""
    white = _ASCII_WHITE[raw]
    start = white.copy()
    start[1:] &= ~white[:-1]
    start[:1] = False
    after = np.flatnonzero(start)
    after = after[raw[after - 1] >= 0x80]
    if len(after):  # the character before may be white space of several bytes
        two = raw[after - 2].astype(np.int64) << 8 | raw[after - 1]
        three = np.where(after > 2, raw[after - 3], 0).astype(np.int64) << 16 | two
        start[after[np.isin(two, _WHITE_ENDS) | np.isin(three, _WHITE_ENDS)]] = False
    start[at[:-1][at[:-1] < len(raw)]] = True
    return np.flatnonzero(start)


class Bpe:
    """Encoder and decoder of one vocabulary: token strings by id, where a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.ranks = ranks
        self.vocabulary = {i: t for t, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        keys, values = array("q"), array("q")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    keys.append(a << _BITS | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self._keys, self._ranks = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        #: by two bytes, the rank and merged symbol of their pair, -1 where there is none
        self.bytes_rank = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self._byte_ranks, self._singles = np.array(self.bytes_rank, np.int64), np.array(self.single, np.int64)
        flat = [self.vocabulary.get(i, b"") for i in range(max(self.vocabulary) + 1)]
        self._size = np.array([len(t) for t in flat], np.int64)
        self._first, self._flat = np.cumsum(self._size) - self._size, np.frombuffer(b"".join(flat), np.uint8)
        self.letters_are_pieces = pattern == PATTERN
        self.find = regex.compile(pattern).findall
        self.units = _Cache()

    @classmethod
    def load(cls, data: bytes, pattern: str = PATTERN) -> Bpe:
        return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        first, ranks, strings = self.bytes_rank, self.ranks.get, self.vocabulary
        # rank[i]: of the pair that starts at symbol i now; -1 without one, and where a symbol has gone
        rank = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        rank.append(-1)
        queue = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        single = self.single
        sym = [single[b] for b in piece]
        if not queue:
            return sym
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, r = entry & _PLACE, entry >> 32
            if rank[i] != r:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            sym[i], sym[j], rank[j] = r, -1, -1
            if k < n:
                before[k] = i
                new = rank[i] = ranks(strings[r] + strings[sym[k]], -1)
                if new >= 0:
                    heappush(queue, new << 32 | i)
            else:
                rank[i] = -1
            p = before[i]
            if p >= 0:
                new = rank[p] = ranks(strings[sym[p]] + strings[r], -1)
                if new >= 0:
                    heappush(queue, new << 32 | p)
        return [s for s in sym if s >= 0]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; -1 where the vocabulary has none."""
        key = a.astype(np.int64) << _BITS | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1) if len(self._keys) else np.full(len(key), -1)

    def merge_all(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, -1 where one has gone; the piece of each) of pieces of at most SHORT bytes, which lie one behind the other.

        A queue has three entries' room for each byte of its piece: those at the start, and two for each merge. An entry is
        rank << 24 | place << 12 | its own number in the queue.
        """
        n, size = len(data), np.diff(at)
        piece = np.repeat(np.arange(len(size), dtype=np.int32), size)
        sym, rank = self._singles[data].astype(np.int32), np.full(n, -1, np.int32)
        rank[:-1] = self._byte_ranks[data[:-1].astype(np.int64) << 8 | data[1:]]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank[at[1:] - 1], after[at[1:] - 1], before[at[:-1]] = -1, n, -1
        own, fill, start = at[:-1], size.copy(), (np.cumsum(size) - size) * 3
        queue = np.full(3 * n, _NONE)
        has = np.flatnonzero(rank >= 0)
        place = has - own[piece[has]]
        queue[start[piece[has]] + place] = rank[has].astype(np.int64) << 24 | place << 12 | place
        live = np.arange(len(size))  # pieces with entries, whose queues start at start
        while len(live):
            top = np.minimum.reduceat(queue, start)
            on = top < _NONE
            if 2 * on.sum() < len(on):  # the queues of those that are done go
                room = np.diff(np.append(start, len(queue)))
                queue = queue[np.repeat(on, room)]
                start, live, top = (np.cumsum(room[on]) - room[on]), live[on], top[on]
                on = np.ones(len(live), bool)
            who, least = np.flatnonzero(on), top[on]
            queue[start[who] + (least & 0xFFF)] = _NONE
            i, r = own[live[who]] + (least >> 12 & 0xFFF), least >> 24
            fresh = rank[i] == r  # others are stale
            i, r, who = i[fresh], r[fresh], who[fresh]
            j = after[i]
            k = after[j]
            after[i], sym[i], sym[j], rank[j], rank[i] = k, r, -1, -1, -1
            for left, right, mine in ((i, k, k < n), (before[i], i, before[i] >= 0)):
                left, right, q = left[mine], right[mine], who[mine]
                new = self.rank_of(sym[left], sym[right])
                rank[left] = new
                left, right, q, new = left[new >= 0], right[new >= 0], q[new >= 0], new[new >= 0]
                mine_of = live[q]
                queue[start[q] + fill[mine_of]] = new << 24 | (left - own[mine_of]) << 12 | fill[mine_of]
                fill[mine_of] += 1
            back = k < n
            before[k[back]] = i[back]
        return sym, piece

    def _pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Packed tokens of distinct pieces, each decoded and compared."""
        out, short, ranks = {}, [], self.ranks
        for p in pieces:
            if (whole := ranks.get(p)) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) <= SHORT:
                short.append(p)
            else:
                tokens = self.merge(p)
                if self.decode(tokens) != p:
                    raise ValueError("the vocabulary's tokens don't give the text again")
                out[p] = array("i", tokens).tobytes()
        if short:
            data = np.frombuffer(b"".join(short), np.uint8)
            sym, piece = self.merge_all(data, np.concatenate(([0], np.cumsum(np.fromiter(map(len, short), np.int64, len(short))))))
            tokens = sym[sym >= 0]
            n = self._size[tokens]
            back = self._flat[np.repeat(self._first[tokens] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            if not np.array_equal(back, data):
                raise ValueError("the vocabulary's tokens don't give the text again")
            packed = tokens.astype(np.int32).tobytes()
            ends = (4 * np.cumsum(np.bincount(piece[sym >= 0], minlength=len(short)))).tolist()
            out.update(zip(short, map(packed.__getitem__, map(slice, [0, *ends], ends))))
        return out

    def _encode_units(self, units: list[bytes]) -> list[bytes]:
        """Packed tokens of distinct units."""
        out = [self.units.get(u) for u in units]
        todo = [k for k, found in enumerate(out) if found is None]
        cut: list[list[bytes]] = []
        for k in todo:
            u = units[k]
            if self.letters_are_pieces and (u[1:].isalpha() and u[0] == 32 or u.isalpha()):
                cut.append([u])
            else:
                cut.append([p.encode() for p in self.find(u.decode())])
                if b"".join(cut[-1]) != u:
                    raise ValueError("the pattern's pieces don't give the text again")
        found = self._pieces(list({p: None for ps in cut for p in ps}))
        for k, ps in zip(todo, cut):
            out[k] = found[ps[0]] if len(ps) == 1 else b"".join([found[p] for p in ps])
            self.units.put(units[k], out[k])
        return out

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts one after the other, how many each text has)."""
        at, data = K.buffers(K.plain(column))
        counts, tokens = np.zeros(len(at) - 1, np.int64), [np.zeros(0, np.int32)]
        for a, b in K.slices(at, SLICE):
            raw, edge = data[at[a] : at[b]], at[a : b + 1] - at[a]
            starts = unit_starts(raw, edge)
            if not len(starts):
                continue
            ends = np.append(starts, len(raw)).astype(np.int32)
            units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
            packed = self._encode_units(units.dictionary.to_pylist())
            size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            first, which = np.cumsum(size) - size, units.indices.to_numpy()
            n = size[which]
            total = np.concatenate(([0], np.cumsum(n)))
            tokens.append(np.frombuffer(b"".join(packed), np.int32)[np.repeat(first[which] - total[:-1], n) + np.arange(total[-1])])
            counts[a:b] = np.diff(total[np.searchsorted(starts, edge)])
        return np.concatenate(tokens), counts

    def encode(self, text: str) -> bytes:
        """The tokens as packed 32-bit numbers."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def decode(self, tokens: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, tokens))


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_open: dict[int, Bpe] = {}


def _coder(data: bytes, pattern: str) -> Bpe:
    """One coder in each worker; its cache lasts as long as a task."""
    key = hash((data, pattern))
    if key not in _open:
        _open.clear()
        _open[key] = Bpe.load(data, pattern)
    return _open[key]


def encode(docs: DataFrame, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, n_tokens and whether the decoded tokens are the text, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, count = _coder(shared.value, pattern).encode_all(batch.column(1))
        null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32), mask=np.append(null, False))
        # every unit has been decoded and compared when it was encoded
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(tokens)), pa.array(count, mask=null), pa.array(np.ones(len(null), bool), mask=null)], ["doc_id", "tokens", "n_tokens", "round_trip"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from (work(batch) for batch in batches if batch.num_rows)
        finally:  # what the next task of this worker does need not be encoding
            _coder(shared.value, pattern).units = _Cache()
            K.give_back()

    return rows.mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, *, vocabulary: str = VOCABULARY, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """doc_id, text of tokens; bytes that are no UTF-8 become replacement characters, null tokens null."""
    shared = encoded.sparkSession.sparkContext.broadcast(_read(vocabulary))
    rows = encoded.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{tokens_col}`").alias("tokens"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(shared.value, PATTERN)
        texts = [None if t is None else coder.decode(t).decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return K.arrow_map(rows, work, "doc_id bigint, text string")
