"""Scalars at their edges, and cleaning."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.functions import gibberish as B
from quillstone.functions import nested as N
from quillstone.functions import scalars as S
from quillstone.functions import text as X


def of(spark, f, *values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("v"))).collect()]


def test_durations(spark):
    cases = {"1s": 1, "1m": 60, "1h": 3600, "1d": 86400, "1w": 604800, "1mo": 2629746, "1.0y": 86400, "1h30m": 5400, "1h 30m": 1800, "30": 30, "2.5": 2.5, "2d3h4m5s": 183845, "junk": 0, "": 0, "3 days": 0, "x1h": 0}
    assert of(spark, S.to_seconds, *cases, None) == [*map(float, cases.values()), 0.0]


def test_sizes_and_numbers(spark):
    assert of(spark, S.from_metric, "128K", "2M", "1G", "7", "1.5K", "k", None, "10737418240", "8000000000K", "-5M", "9223372036854775807", "9223372036854775807K", "9" * 30) == [131072, 2097152, 1073741824, 7, None, None, None, 10737418240, 8192000000000, -5242880, 2**63 - 1, None, None]
    assert of(spark, S.to_int, "5", " 7 ", "x", None, "1.5", "99999999999999999999") == [5, 7, 0, 0, 0, 0]
    assert of(spark, S.to_float, "5", "1e3", "x", None) == [5.0, 1000.0, 0.0, 0.0]
    assert of(spark, S.is_float, "inf", "1d", None, "NaN") == [True, False, False, True]
    assert of(spark, S.to_string, None, "a", "/Date(86400)/") == ["", "a", "1970-01-02"]


def test_dates(spark):
    got = of(spark, lambda c: S.to_date(c).cast("string"), "2025-03-28", "20250328", "03/28/2025", "3/8/2025", "2025-03-28T22:26:06.948Z", "/Date(1743200766)/", "/Date(1743200766948)/", "nonsense", None, "2025-02-30", "")
    assert got == ["2025-03-28"] * 3 + ["2025-03-08", "2025-03-28", "2025-03-28", None, None, None, None, None]
    got = of(spark, lambda c: S.to_datetime(c).cast("string"), "2024-11-05T20:10:09.125-04:00", "2025-03-28 10:00:00", "2025-03-28T10:00:00", "bad", None)
    assert got == ["2024-11-06 00:10:09.125", "2025-03-28 00:00:00", "2025-03-28 10:00:00", None, None]


def test_json(spark):
    doc = '{"A": {"b": [1, {"C": "x"}]}}'
    assert of(spark, lambda c: N.get(c, "A/b/1/C"), doc, "no json", None) == ["x", None, None]
    assert of(spark, lambda c: N.get_ignoring_case(c, "a/B/1/c", "d"), doc, "{}") == ["x", "d"]
    with pytest.raises(Exception, match="no value"):
        of(spark, lambda c: N.get(c, "!zz"), doc)
    assert of(spark, lambda c: N.json_date(c).cast("string"), "/Date(0)/", "/Date(1743200766948)/", "x", None) == ["1970-01-01 00:00:00", "2025-03-28 22:26:06.948", None, None]


def test_text(spark):
    assert of(spark, X.normalize, "Ein Über-Fall!  É", "", None, "...") == ["ein über fall é", "", None, ""]
    assert of(spark, X.strip_lines, "\u00a0 a \t\n b ", "") == ["a\nb", ""] and of(spark, X.flatten_lines, " a \n b ") == ["ab"]
    assert of(spark, X.date_in_path, "/x/2024-01-02/y", "/x_2024-01-02_y", None) == ["2024-01-02", None, None]
    assert of(spark, lambda c: X.fenced(c, "sql"), "a ```sql\nSELECT 1\n``` b", "plain") == ["SELECT 1", "plain"]
    assert of(spark, X.clean_json, 'x {"a":\n{"b": 1}} y', "none", None) == ['{"a": {"b": 1}}', None, None]
    assert of(spark, lambda c: X.matches_patterns(c, [".MD", "a*[0-9].txt"]), "x.md", "abc1.TXT", "md", None) == [True, True, False, None]
    import re

    assert re.search(X.pattern_regex("*war*"), "forewarned") and not re.search(X.pattern_regex("war"), "forewarned") and re.search(X.pattern_regex("war*"), "warned")


GIBBERISH, PROSE = "zxcvb qwrtp lkjhg mnbvc sdfgh xcvbn", "Ships from the north bring salt, tin and amber to the harbour each spring."


def test_clean_text(spark):
    damaged = "The harbourâ€™s pilots know every rock of the bay."
    once = of(spark, B.clean_text, damaged, "\n".join((PROSE, GIBBERISH, PROSE)), PROSE, None, "", "cafÃ© &amp; tea\r\n\ufb01ne")
    assert once == ["The harbour's pilots know every rock of the bay.", "\n".join((PROSE, PROSE)), PROSE, None, "", "café & tea\nfine"]
    assert of(spark, B.clean_text, *once) == once
    assert of(spark, lambda c: B.clean_text(c, drop_noise=False), GIBBERISH) == [GIBBERISH]


def test_short_lines_are_never_noise(spark):
    assert of(spark, B.is_noise, "# 1977", "- 1980", "| a | b |", GIBBERISH, PROSE) == [False, False, False, True, False]


def test_most_real_lines_stay(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").join(spark.read.parquet(f"{tiny}/labels.parquet").where("quality = 1"), "doc_id")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("l")).where(F.length("l") > 20)
    assert lines.where(B.is_noise(F.col("l"))).count() < 0.02 * lines.count()


def test_clean_text_equals_its_rule_line_by_line(spark):
    def noise(line):
        low, some = line.lower(), sum(c.isascii() and c.isalpha() for c in line)
        two = [a + b for a, b in zip(low, low[1:]) if a.isascii() and b.isascii() and a.isalpha() and b.isalpha()]
        return some >= B.LEAST_LETTERS and sum(p in B.PAIRS for p in two) < B.LEAST_SHARE * len(two)

    r, ends = random.Random(5), ["", "\n", "\n\n"]
    lines = [GIBBERISH, PROSE, "", "é" * 20, "\u212a" * 3 + "QXZWVKJ" * 2, "\u0130xqzwvkj" * 3, "caf\u00c3\u00a9 au lait", "a &amp; b &lt; c", "\u201cquoted\u201d\r", "\ufb01ne", "\u4e2d\u6587 qwrtpzlkjhgf", "x\u0007y", "na\u00efve\u2019s"]
    lines += ["".join(r.choice("aeiQXzkt bn\u0130\u212a\u00e9") for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts = [None, "", *("\n".join(r.choices(lines, k=r.randint(1, 6))) + r.choice(ends) for _ in range(500)), "qxzwvkjqxzwvkj", "", "\n", "qxzwvkjqxzwvkj\n" + PROSE]
    want = [None if t is None else "\n".join(x for x in (B.repair(t) if re.search(B._DAMAGE, t) else t).split("\n") if not noise(x)) for t in texts]
    whole, few = B.SLICE, pa.array(texts)
    assert of(spark, B.clean_text, *texts) == want and sum(w != t for w, t in zip(want, texts)) > 100
    assert of(spark, B.is_noise, *lines, None) == [*map(noise, lines), None]
    try:
        B.SLICE = 100
        parts = list(B._slices(few.slice(3, 200)))
        assert len(parts) > 50 and [x for p in parts for x in B._without_noise(B._repaired(p), B.LEAST_LETTERS).to_pylist()] == want[3:203]
    finally:
        B.SLICE = whole
    plan = spark.createDataFrame([("a",)], "t string").select(B.clean_text(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "RLIKE" not in plan  # patterns take microseconds a character
