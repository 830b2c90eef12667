import pytest
from helpers import LONG, WORD, prose, table, words

from quillstone.llm import decontaminate as D

N = D.N


def items():
    return [(1, prose(1, 40)), (2, prose(2, 30)), (3, prose(3, 6)), (4, prose(4, 3)), (5, None), (6, ""), (7, prose(1, 40)), (None, prose(9, 20))]


def docs():
    a, b = prose(1, 40), prose(2, 30)
    return [
        (1, prose(10, 300) + " " + a.upper() + ", " + prose(11, 200)), (2, prose(12, 400)), (3, a), (4, prose(13, 20) + "\n" + " ".join(b.split()[4:20]) + "; " + prose(14, 60)), (5, prose(15, 50) + " - " + prose(3, 6) + ". " + prose(16, 50)),
        (6, prose(4, 3) + " " + prose(17, 40)), (7, None), (8, ""), (9, LONG + " " + b), (10, "é " + " ".join(a.split()[:7]) + " ü"), (11, "Ñ " * 50 + b + " Ñ" * 50), (11, "Ñ " * 50 + b + " Ñ" * 50), (None, prose(18, 90) + " " + a),
    ]


def brute(documents, benchmark):
    grams = {}
    for i, t in benchmark:
        w = words(t)
        m = min(N, len(w))
        if i is not None and len(w) >= D.MIN_WORDS:
            for k in range(len(w) - m + 1):
                grams.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for i, t in documents:
        w = words(t)
        hit, who = set(), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in grams:
                    hit |= set(range(k, k + m))
                    who |= grams[g]
        if hit:
            out.append((i, sorted(who), len(hit), len(w), len(hit) >= D.DROP_SHARE * len(w)))
    return sorted(out, key=str)


CHINESE = "春天来了，花园里的花都开了，孩子们在草地上奔跑，笑声传得很远。"
THAI = "วันนี้อากาศดีมากเราจึงไปเดินเล่นที่สวนสาธารณะ"


def test_scripts_without_spaces(spark):
    items = [(1, CHINESE), (2, THAI), (3, "你好"), (4, "Łódź leży w środkowej Polsce nad rzeką Łódką od wieków")]
    rows = [(1, CHINESE), (2, "这是前面的文字。" + CHINESE.replace("，", " ") + "这是后面的文字。" * 9), (3, "ก่อนหน้านี้ " + THAI + " หลังจากนั้น " * 20), (4, "你好，世界！今天是星期一。"), (5, prose(1, 30) + " ŁÓDŹ LEŻY W ŚRODKOWEJ POLSCE NAD RZEKĄ ŁÓDKĄ OD WIEKÓW. " + prose(2, 30)), (6, "春天的花和秋天的月亮，往事知道多少。")]
    want = brute(rows, items)
    assert [(w[0], w[1], w[4]) for w in want] == [(1, [1], True), (2, [1], False), (3, [2], False), (5, [4], False)]
    for limit in (D.BROADCAST_BYTES, 0):
        assert sorted((tuple(r) for r in D.report(table(spark, rows), bench(spark, items), broadcast_bytes=limit).collect()), key=str) == want
    left = {r.doc_id: r.text for r in D.clean(table(spark, rows), bench(spark, items)).collect()}
    assert set(left) == {2, 3, 4, 5, 6} and words(left[2])[:7] == list("这是前面的文字")


def test_sql_in_other_scripts(spark, tmp_path):
    database = pytest.importorskip("duckdb").connect()
    rows = [(1, CHINESE), (2, "前面。" + CHINESE + "后面" * 30), (3, THAI), (4, "🙂 Łódź " + prose(1, 12))]
    items = [(1, CHINESE), (2, THAI + "x"), (3, "łódź ❤️ " + prose(1, 12))]
    database.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)").executemany("INSERT INTO documents VALUES (?, ?)", rows)
    database.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)").executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(database.execute(D.sql()).fetchall()) == brute(rows, items)


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def found(spark, **how):
    return sorted((tuple(r) for r in D.report(table(spark, docs()), bench(spark, items()), **how).collect()), key=str)


def test_report_equals_brute_force_with_and_without_broadcast(spark):
    want = brute(docs(), items())
    assert found(spark) == want and found(spark, broadcast_bytes=0) == want
    assert {w[0] for w in want} == {1, 3, 4, 5, 9, 11, None}


def test_clean_takes_out_all_and_nothing_else(spark):
    source = table(spark, docs())
    for limit in (D.BROADCAST_BYTES, 0):
        out = D.clean(source, bench(spark, items()), broadcast_bytes=limit)
        assert out.schema == source.schema
        rows = {}
        for r in out.collect():
            rows.setdefault(r.doc_id, []).append(r)
        text = {k: v[0].text for k, v in rows.items()}
        before = {i: t for i, t in docs()}
        assert 3 not in rows and len(rows[11]) == 2 and rows[1][0]._id == "own _id"
        assert all(text[k] == before[k] for k in (2, 6, 7, 8, 10))
        assert words(text[1]) == words(prose(10, 300)) + words(prose(11, 200)) and words(text[None]) == words(prose(18, 90)) and words(text[9]) == words(LONG)
        assert brute([(k, t) for k, t in text.items()], items()) == []


def test_empty_tables(spark):
    assert D.report(table(spark, []), bench(spark, items())).collect() == []
    assert D.report(table(spark, docs()), bench(spark, [])).collect() == []
    assert D.clean(table(spark, docs()), bench(spark, [])).count() == len(docs())


def test_driver_tables(spark, tiny):
    d, b = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    got = sorted((tuple(r) for r in D.report(d, b).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert WORD.findall("a_b") == ["a", "b"]
