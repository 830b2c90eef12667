import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.llm import url_reputation as R

URLS = [
    "https://user:pw@Blog.Shop.Example.co.uk:8080/a?b#c", "http://www.example.com", "ftp://example.com./x", "https://10.0.0.1/x", "example.com/no-scheme", "", None, "https:///path", "http://localhost/x", "https://a.b.example.com?x@y",
]


def rows(spark, pages, labels):
    p = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, host string, mean string")
    return p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_hosts(spark):
    p, _ = rows(spark, list(enumerate(URLS)), [(0, 1, 0)])
    out = places(p)
    assert out[0] == ("blog.shop.example.co.uk", "example.co.uk", "co.uk") and out[1] == ("www.example.com", "example.com", "com") and out[2] == ("example.com", "example.com", "com")
    assert out[3] == ("10.0.0.1", "10.0.0.1", "") and out[8] == ("localhost", "localhost", "localhost") and out[9] == ("a.b.example.com", "example.com", "com")
    assert [out[k][0] for k in (4, 5, 6, 7)] == [None] * 4


def places(pages, rules=None):
    rows = pages.select("page_id", R.host_of(F.col("url")).alias("host"))
    return {r.page_id: (r.host, r.domain, r.suffix) for r in R.placed(rows, rules).collect()}


MORE = [
    ("https://a.foo.co.il/", "a.foo.co.il", "foo.co.il", "co.il"), ("https://alice.github.io/x", "alice.github.io", "alice.github.io", "github.io"), ("http://[2001:db8::1]:80/x", "[2001:db8::1]", "[2001:db8::1]", ""), ("http://u@[::FFFF:1.2.3.4]", "[::ffff:1.2.3.4]", "[::ffff:1.2.3.4]", ""),
    ("https://www.ck", "www.ck", "www.ck", "ck"), ("https://a.b.c.ck", "a.b.c.ck", "b.c.ck", "c.ck"), ("https://x.ck", "x.ck", "x.ck", "x.ck"), ("https://city.kawasaki.jp", "city.kawasaki.jp", "city.kawasaki.jp", "kawasaki.jp"), ("https://a.b.kawasaki.jp", "a.b.kawasaki.jp", "a.b.kawasaki.jp", "b.kawasaki.jp"),
    ("https://www.食狮.公司.cn", "www.食狮.公司.cn", "食狮.公司.cn", "公司.cn"), ("https://www.xn--85x722f.xn--55qx5d.cn", "www.xn--85x722f.xn--55qx5d.cn", "xn--85x722f.xn--55qx5d.cn", "xn--55qx5d.cn"), ("https://github.io/", "github.io", "github.io", "github.io"),
    ("https://a.unknowntld", "a.unknowntld", "a.unknowntld", "unknowntld"), ("https://x.com/" + "a" * 200_000, "x.com", "x.com", "com"), ("https://" + "a." * 5_000 + "co.uk/", "a." * 5_000 + "co.uk", "a.co.uk", "co.uk"), ("http://[bad/x", None, None, None),
]


def test_rules_of_the_public_suffix_list(spark):
    p, _ = rows(spark, [(k, m[0]) for k, m in enumerate(MORE)], [(0, 1, 0)])
    got = places(p)
    assert [got[k] for k in range(len(MORE))] == [m[1:] for m in MORE]


def test_rules_are_a_parameter(spark, tmp_path):
    path = tmp_path / "rules.txt"
    path.write_text("// comment\ncom\n*.own\n!not.own\n\n", "utf-8")
    assert set(R.suffix_rules(str(path))) == {("com", R.PLAIN), ("own", R.WILD), ("not.own", R.NOT)}
    p, l = rows(spark, [(1, "https://a.co.uk"), (2, "https://x.y.own"), (3, "https://x.not.own"), (4, "https://z.x.y.own/")], [(1, 1, 0)])
    assert places(p, str(path)) == {1: ("a.co.uk", "co.uk", "uk"), 2: ("x.y.own", "x.y.own", "y.own"), 3: ("x.not.own", "not.own", "own"), 4: ("z.x.y.own", "x.y.own", "y.own")}
    assert [r.suffix for r in R.judge(p, l, rules=str(path)).orderBy("page_id").collect()] == ["uk", "y.own", "own", "y.own"]


def data():
    pages, labels = [], []
    for k in range(400):
        host = f"h{k % 13}.d{k % 5}.{'com' if k % 3 else 'org'}"
        pages.append((k, f"https://{host}/{k}"))
        if k % 2:
            labels.append((k, 0 if (k % 13) in (1, 5) and k % 7 else 1, 0))
    return pages + [(1000, None), (1001, "https://new.d1.com/"), (1002, "https://other.net/"), (5, "https://h5.d0.com/again"), *[(2000 + k, m[0]) for k, m in enumerate(MORE) if len(m[0]) < 100], (3000, "https://www.食狮.公司.cn/2"), (None, "https://h1.d1.com/")], labels + [(7, 0, 0), (11, None, 1), (None, 1, 0)]


def test_equals_sql(spark):
    pages, labels = data()
    p, l = rows(spark, pages, labels)
    got = sorted((tuple(r) for r in R.judge(p, l).collect()), key=str)
    con = duckdb.connect()
    con.register("pages", p.toPandas().astype({"page_id": "Int64"}).drop(columns=["host", "mean"]))
    con.register("labels", l.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    want = sorted(con.sql(R.sql()).fetchall(), key=str)
    assert [g[:5] + (g[7],) for g in got] == [w[:5] + (w[7],) for w in want]
    for g, w in zip(got, want):
        assert g[5:7] == (pytest.approx(w[5:7], abs=2e-6) if w[5] is not None else w[5:7])


def test_shrinkage_and_bound(spark):
    pages, labels = data()
    out = {r.page_id: r for r in R.judge(*rows(spark, pages, labels)).collect()}
    assert out[1].mean < out[2].mean and out[1001].labelled == 0 and out[1001].bound < out[1001].mean < 1 and not out[1000].keep and out[1000].host is None
    assert all(r.keep == (r.bound is not None and r.bound >= R.BOUND) for r in out.values())


def test_unlabelled_and_empty(spark):
    out = R.judge(*rows(spark, [(1, "https://a.com/")], [])).collect()
    assert (out[0].labelled, out[0].mean, out[0].keep) == (0, 0.5, False)
    assert R.judge(*rows(spark, [], [(1, 1, 0)])).collect() == []
