"""Small tables with every hard case in them, and brute-force versions."""

import re
from unicodedata import category

from quillstone.llm.kernel import NO_MARKS, SINGLES

LONG = " ".join(f"w{i % 977}x{i // 31}" for i in range(30000))
WORD = re.compile(r"[^\W_]+")  # the same words for scripts with spaces and without marks


def table(spark, rows, extra=True):
    """doc_id, text and columns whose names operators might use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en" if i is None or i % 2 else None, "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, schema)
    if extra:
        from pyspark.sql import functions as F

        for name in ("_id", "_text", "_t", "_h", "_row", "_key", "keep", "spans", "a", "b", "id", "_gone", "_again", "_l", "_y", "_spans", "_grams", "_x", "count"):
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def _in(c, spans):
    return any(a <= c <= b for a, b in spans)


def words(text):
    """The kernel's rule, one character after the other."""
    out, run = [], ""
    for x in text or "":
        c, g = ord(x), category(x)
        inside = (g[0] in "LN" or g in ("Mn", "Mc")) and not _in(c, NO_MARKS) and (c < 0x20000 or c < 0x40000)
        alone = inside and _in(c, SINGLES) or 0x20000 <= c < 0x40000
        if run and (alone or not inside):
            out.append(run)
            run = ""
        if alone:
            out.append(x)
        elif inside:
            low = x.lower()
            run += low if len(low) == 1 and len(low.encode()) == len(x.encode()) else x
    return [*out, run] if run else out


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def prose(seed, n):
    import random

    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tu", "re", "sa", "no", "vi", "pe", "da"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))
