"""License scans by patience alignment.

A region of text is aligned with a licence template, word by word: words that occur once in both anchor it; the
longest increasing subsequence of the anchors stays; the gaps between them are aligned in the same way, with what
is unique there. A gap without anchors is aligned by the same patience sort over all its pairs
of equal words, which gives a longest common subsequence; so is a whole region whose coverage falls short, as chance
anchors may mislead. The matched share of the template's words is its coverage.

Which regions to align is found without loss: of the words that matter (all but a few function words), a region of
coverage COVERAGE must hold all but those that may be missing, within REACH template lengths. Their places come from one hashed
lookup for every word of every document, so that most texts need no alignment at all.

A region that holds all these words is still aligned only if its longest common subsequence with the template, which bits
of whole numbers give in one step a word, is long enough. If it falls short by d words, the next region that can match
ends d words later, so that text that nearly matches is passed in such steps.

Result: a row for each match: doc_id, licence, coverage, the characters from start up to end that the match
spans, and the words matched. Defined results:
- Null and empty texts have no rows; a null id is reported as null; repeated rows each have their rows.
- A template is matched in a text as often as it occurs, from left to right, without overlap; other
  templates are matched independently, so that a notice within a longer licence has a row of its own.
- Ties: of templates that match the same place each has its row; of equal alignments within a region the one of least
  places in the template is reported, so that equal texts have equal rows.
- Texts of any length are scanned whole; a text made up of licence words takes some 10 steps a word and template.
- Templates without words, or of which so few words matter that none is needed, are refused with a ValueError.
- Only the id and text columns are read. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K
from quillstone.llm.license_texts import TEMPLATES

COVERAGE, REACH = 0.8, 2
COMMON = frozenset(b"a an and any are as at be by for from in is it its no not of on or that the this to under was with you".split())
SCHEMA = "doc_id bigint, license string, coverage double, start int, `end` int, words bigint"
_BITS = 20


def increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sort."""
    tops: list[int] = []
    piles: list[int] = []
    below = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect_left(tops, v)
        below[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[at], piles[at] = v, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = below[k]
    return out[::-1]


def longest(text: Sequence, template: Sequence) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence: the patience sort over all pairs of equal words."""
    places: dict = {}
    for j in range(len(template) - 1, -1, -1):
        places.setdefault(template[j], []).append(j)
    pairs = [(i, j) for i, x in enumerate(text) for j in places.get(x, ())]
    return [pairs[k] for k in increasing([j for _, j in pairs])]


def align(text: Sequence, template: Sequence) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = Counter(text[a:b]), Counter(template[c:d])
        where = {text[i]: i for i in range(a, b)}
        anchors = [(where[x], j) for j in range(c, d) if theirs[x := template[j]] == 1 and mine.get(x) == 1]
        if not anchors:
            out += [(a + i, c + j) for i, j in longest(text[a:b], template[c:d])]
            continue
        kept = [anchors[k] for k in increasing([i for i, _ in anchors])]
        out += kept
        for (i, j), (k, m) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def common(words: Sequence, masks: dict, size: int) -> int:
    """The length of a longest common subsequence with a template of so many words; masks: the bits of its places by word."""
    full = (1 << size) - 1
    v = full
    for x in words:
        if (m := masks.get(x)) is not None:
            u = v & m
            v = (v + u | v - u) & full
    return size - v.bit_count()


def leading(text: Sequence, template: Sequence, need: int) -> int:
    """Where the first of several matches in a text of at least one ends: before the others begin, or with the text if it is the only one."""
    covered = lambda a, b: len(longest(text[a:b], template))
    end = len(text)
    early = bisect_left(range(end), True, key=lambda b: covered(0, b) >= need)
    while (most := covered(early, end)) >= need:
        end = bisect_left(range(early, end), True, key=lambda a: covered(a, end) < most) + early - 1
    return end


class Scanner:
    """Templates as words, and the hashed words that matter of each."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, reach: float = REACH):
        self.coverage, self.templates = coverage, []
        names = sorted(templates)
        owner: dict[int, list[int]] = {}
        for k, name in enumerate(names):
            (w,) = K.words(pa.array([templates[name]]), 1 << 30)
            own = [w.low[s:e].tobytes() for s, e in zip(w.starts, w.ends)]
            need = ceil(coverage * len(own) - 1e-9)
            matter = [h for h, x in zip(w.hashes.tolist(), own) if x not in COMMON]
            least = len(matter) - (len(own) - need)
            if not own or least < 1:
                raise ValueError(f"the licence template {name!r} has too few words that matter")
            masks: dict[int, int] = {}
            for j, h in enumerate(w.hashes.tolist()):
                masks[h] = masks.get(h, 0) | 1 << j
            self.templates.append((name, own, need, least, ceil(reach * len(own)), masks))
            for h in set(matter):
                owner.setdefault(h, []).append(k)
        self.known = np.array(sorted(owner), K.U)
        self.owner = [owner[h] for h in self.known.tolist()]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.known >> K.U(64 - _BITS)] = True

    def scan(self, w: K.Words):
        """(document, template, coverage, first word, last word, words matched) of each match in a slice."""
        at = np.flatnonzero(self.bits[w.hashes >> K.U(64 - _BITS)])
        found = np.minimum(np.searchsorted(self.known, w.hashes[at]), len(self.known) - 1)
        real = self.known[found] == w.hashes[at]
        at, found = at[real], found[real]
        docs = np.searchsorted(w.bounds, at, side="right") - 1
        cuts = np.flatnonzero(np.diff(docs)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            if a == b:
                continue
            by: dict[int, list[int]] = {}
            for p, f in zip(at[a:b].tolist(), found[a:b].tolist()):
                for k in self.owner[f]:
                    by.setdefault(k, []).append(p)
            doc = int(docs[a])
            for k, places in sorted(by.items()):
                if len(places) >= self.templates[k][3]:
                    yield from self._match(w, doc, k, places)

    def _match(self, w: K.Words, doc: int, k: int, places: list[int]):
        name, own, need, least, reach, masks = self.templates[k]
        low, high = int(w.bounds[doc]), int(w.bounds[doc + 1])
        i = 0
        while i + least <= len(places):
            if places[i + least - 1] - places[i] >= reach:
                i += 1
                continue
            a, b = max(low, places[i] - len(own)), min(high, places[i] + reach)
            short = need - common(w.hashes[a:b].tolist(), masks, len(own))
            if short > 0:  # each word further on adds one at most
                if high - b < short:
                    break
                i = max(i + 1, bisect_left(places, b + short - reach))
                continue
            region = [w.low[w.starts[q] : w.ends[q]].tobytes() for q in range(a, b)]
            pairs = align(region, own)
            if len(pairs) < need:  # words that are unique by chance may have led the anchors astray
                pairs = longest(region, own)
            if len(pairs) < need:
                i += 1
                continue
            if bisect_left(places, b) - bisect_left(places, a) >= 2 * least and (end := leading(region, own, need)) < len(region):
                region = region[:end]
                pairs = align(region, own)
                if len(pairs) < need:
                    pairs = longest(region, own)
            first, last = a + pairs[0][0], a + pairs[-1][0]
            yield doc, name, round(len(pairs) / len(own), 4), first, last, len(pairs)
            low = last + 1
            i = bisect_left(places, low)


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, coverage: float = COVERAGE, reach: float = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, start, end, words of every match of a template."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, coverage, reach))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for w in K.words(batch.column(1)):
            for doc, name, share, first, last, n in shared.value.scan(w):
                base = int(w.at[doc])
                char = lambda to: int(((w.raw[base:to] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                out.append((w.first + doc, name, share, char(int(w.starts[first])), char(int(w.ends[last])), n))
        if not out:
            return None
        cols = list(zip(*out))
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), *[pa.array(c, t) for c, t in zip(cols[1:], kinds)]], ["doc_id", "license", "coverage", "start", "end", "words"])

    return K.arrow_map(rows, work, SCHEMA)
