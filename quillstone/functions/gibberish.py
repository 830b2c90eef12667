"""Repair of text that was decoded wrongly, and the lines of it that are noise.

A line is judged as a whole, and only if it has enough ASCII letters: it is noise if too few of its letter pairs are
among those that words in Latin script are made of. Verdicts are counts over the bytes of many texts at once; only texts
that hold a sign of damage are decoded for repair, and only those with noise are put together anew.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_LETTERS, LEAST_SHARE = 12, 0.35
#: Pairs of a consonant and a vowel, in either order, and the consonant pairs that are common in European languages.
_VOWELS, _CONSONANTS = "aeiouy", "bcdfghjklmnprstvwz"
_CLUSTERS = "th ch sh ph wh ck ng nd nt st sp sc sk sl sm sn sw tr dr br cr fr gr pr bl cl fl gl pl kn qu ll ss tt ff pp rr mm nn dd gg cc bb rs rt rd rn rm rl rk rc rg rv rp rb ns nc nk ls lt ld lk lf lp lm mp mb ft ct pt xt ts ds gh ght tw dg ks".split()
PAIRS = frozenset({a + b for a in _VOWELS for b in _CONSONANTS + _VOWELS} | {a + b for a in _CONSONANTS for b in _VOWELS} | {c[:2] for c in _CLUSTERS})
#: What shows that a text may need repair.
_DAMAGE = "[Â-ô][\u0080-¿Œ-™]|&[A-Za-z#][A-Za-z0-9]*;|[ﬀ-ﬆ‘-‟\u2028\u2029\u0000-\u0008\u000b-\u001f\u007f-\u009f\ufeff\r]"
_DAMAGED = re.compile(_DAMAGE)
#: Bytes of text looked at together.
SLICE = 1 << 20
#: By byte: 1 to 26 for the letters of either case; whether it is a damage sign of one byte or may begin one. By two classes: whether they are a good pair.
_CLASS = np.array([ord(chr(b).lower()) - 96 if b < 128 and chr(b).isalpha() else 0 for b in range(256)], np.uint8)
_SIGN = np.array([b < 9 or 11 <= b < 32 or b in (38, 127, 0xEF) for b in range(256)])
_GOOD = np.zeros(27 * 27, bool)
_GOOD[[(ord(p[0]) - 96) * 27 + ord(p[1]) - 96 for p in PAIRS]] = True
_QUOTES = str.maketrans({"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"'})
_BACK = {chr(b): b for b in range(256)} | {bytes([b]).decode("cp1252"): b for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_MOJIBAKE = re.compile("[Â-ô][\u0080-ÿŒ-™]{1,3}")


def _undo(match: re.Match) -> str:
    """The characters whose UTF-8 bytes were read in the Western code page; what isn't that stays."""
    s = match.group()
    size = 2 if s[0] < "à" else 3 if s[0] < "ð" else 4
    try:
        return bytes(_BACK[c] for c in s[:size]).decode("utf-8") + s[size:]
    except (KeyError, UnicodeDecodeError):
        return s


def repair(text: str) -> str:
    """Wrong decoding undone, character references resolved, ligatures and curly quotes plain, line ends \\n, control characters gone."""
    if "<" not in text:
        text = html.unescape(text) if "&" in text else text
    before = None
    while before != text:
        before, text = text, _MOJIBAKE.sub(_undo, text)
    text = text.translate(_QUOTES).replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n").removeprefix("\ufeff")
    text = re.sub("[ﬀ-ﬆ]", lambda m: unicodedata.normalize("NFKC", m.group()), text)
    return unicodedata.normalize("NFC", re.sub("[\u0000-\u0008\u000b-\u001f\u007f-\u009f]", "", text))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _slices(column: pa.Array):
    """The column in slices of SLICE bytes, or of one text that is longer."""
    at, a = _bytes(column)[1], 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE, "right")) - 1)
        yield column.slice(a, b - a)
        a = b


def _repaired(column: pa.Array) -> pa.Array:
    """repair() of the texts that show damage."""
    d, at = _bytes(column)
    sign = _SIGN[d]
    a, b, c = d[:-2], d[1:-1], d[2:]
    sign[:-1] |= ((d[:-1] == 0xC2) & (d[1:] < 0xA0)) | ((d[:-1] == 0xE2) & (d[1:] == 0x80))
    sign[:-2] |= (a == 0xC3) & (b >= 0x82) & (b <= 0xB4) & (c >= 0xC2) & (c <= 0xE2)
    found = {}
    for k in np.unique(np.searchsorted(at, np.flatnonzero(sign), "right") - 1).tolist():
        if (text := column[k].as_py()) is not None and _DAMAGED.search(text):
            found[k] = repair(text)
    if not found:
        return column
    mask = np.zeros(len(column), bool)
    mask[list(found)] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array(list(found.values()), column.type))


def _noise(d: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Whether each stretch of the bytes, from its start to the next, is noise. None is empty."""
    kind = _CLASS[d]
    letter = kind > 0
    pair = letter[:-1] & letter[1:]
    pair[starts[1:] - 1] = False
    good = _GOOD[kind[:-1].astype(np.uint16) * 27 + kind[1:]] & pair

    def count(x: np.ndarray) -> np.ndarray:
        ends = np.minimum(np.append(starts, len(d)), len(x))
        return np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[ends])

    seen, pairs, goods = count(letter), count(pair), count(good)
    out = (seen >= least) & (goods < LEAST_SHARE * pairs)
    # the two characters beyond ASCII of which lower case makes ASCII letters
    odd = np.concatenate([np.flatnonzero((d[:-1] == 0xC4) & (d[1:] == 0xB0)), np.flatnonzero((d[:-2] == 0xE2) & (d[1:-1] == 0x84) & (d[2:] == 0xAA))])
    for k in np.unique(np.searchsorted(starts, odd, "right") - 1).tolist():
        low = d[starts[k] : starts[k + 1] if k + 1 < len(starts) else None].tobytes().decode("utf-8", "replace").lower()
        two = [x for x in map("".join, zip(low, low[1:])) if x.isascii() and x.isalpha()]
        out[k] = seen[k] >= least and sum(x in PAIRS for x in two) < LEAST_SHARE * len(two)
    return out


def _without_noise(column: pa.Array, least: int) -> pa.Array:
    """Each text without its lines of noise."""
    d, at = _bytes(column)
    if not len(d):
        return column
    starts = np.unique(np.concatenate([at[:-1], np.flatnonzero(d == 10) + 1]))
    starts = starts[starts < len(d)]
    noise = starts[_noise(d, starts, least)]
    if not len(noise):
        return column
    gone, mask, new = set(noise.tolist()), np.zeros(len(column), bool), []
    for k in np.unique(np.searchsorted(at, noise, "right") - 1).tolist():
        start, kept = int(at[k]), []
        for line in d[at[k] : at[k + 1]].tobytes().split(b"\n"):
            if not line or start not in gone:  # an empty last line begins where the next text does
                kept.append(line)
            start += len(line) + 1
        mask[k] = True
        new.append(b"\n".join(kept))
    return pc.replace_with_mask(column, pa.array(mask), pa.array(new, pa.binary()).cast(column.type))


def repaired(text: Column) -> Column:
    """repair() of the texts that show damage; all others stay as they are."""

    def run(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([_repaired(x) for x in _slices(column)] or [column])

    return F.arrow_udf(run, "string")(text)


def is_noise(line: Column, least: int = LEAST_LETTERS) -> Column:
    """Whether a line of enough letters has too small a share of pairs that words are made of."""

    def run(column: pa.Array) -> pa.Array:
        d, at = _bytes(column)
        out, full = np.zeros(len(column), bool), np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            out[full] = _noise(d, at[full], least)
        return pa.array(out, mask=column.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "boolean")(line)


def clean_text(text: Column, *, drop_noise: bool = True, least: int = LEAST_LETTERS) -> Column:
    """The repaired text without its lines of noise. Cleaning twice changes nothing more; null stays null."""
    if not drop_noise:
        return repaired(text)

    def run(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([_without_noise(_repaired(x), least) for x in _slices(column)] or [column])

    return F.arrow_udf(run, "string")(text)
