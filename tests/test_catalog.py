"""Declared tables, upserts and guarded SQL."""

import pytest
from pyspark.sql import types as T

from quillstone.plans import catalog as C
from quillstone.plans import sql

FILES = {"columns": [
    {"name": "Id", "type": "integer", "is_primary_key": True, "autoincrement": True}, {"name": "URI", "type": "text", "unique": True}, {"name": "Title", "type": "title"}, {"name": "Seen", "type": "datetime"},
    {"name": "By", "type": "text", "update": False}, {"name": "Kind", "type": "text", "update": False, "default": "'new'"}, {"name": "UpdatedAt", "type": "datetime"},
]}
SCHEMA = "Id long, URI string, Title string, Seen timestamp, By string, Kind string, UpdatedAt timestamp"


def test_types():
    s = C.struct(FILES)
    assert s["Seen"].dataType == T.TimestampType() and not s["Title"].nullable and s["URI"].metadata == {"unique": True}
    assert C.struct({"columns": [{"name": "a", "type": "real"}]}).names == ["id", "a"]
    with pytest.raises(ValueError):
        C.spark_type("nonsense")


def test_differences_and_migrations():
    tables = {"files": FILES, "more": {"columns": [{"name": "x", "type": "real"}]}}
    have = {"files": T.StructType([f for f in C.struct(FILES).fields if f.name != "Seen"])}
    assert C.differences(tables, have) == [("files", "Seen", "add"), ("more", "", "create")]
    first = C.migrations({}, "m", tables, have)
    assert sorted(first) == ["m-0000.sql", "m-0001.sql"] and "ADD COLUMNS" in first["m-0001.sql"]
    assert sorted(C.migrations({"m-0001.sql": first["m-0001.sql"].upper()}, "m", tables, have)) == ["m-0000.sql"]
    assert sorted(C.migrations(first, "m", {"files": FILES}, {})) == ["m-0000.sql", "m-0002.sql"]


def test_migrations_run(spark):
    sql.execute(spark, C.ddl("made_here", {"columns": [{"name": "x", "type": "real", "description": "it's"}]}) + ";\nINSERT INTO made_here VALUES ('a', 1.5);")
    try:
        assert [tuple(r) for r in spark.table("made_here").collect()] == [("a", 1.5)]
        assert C.differences({"made_here": {"columns": [{"name": "x", "type": "real"}, {"name": "y", "type": "text"}]}}, C.actual_schemas(spark, ["made_here", "no_such"])) == [("made_here", "y", "add")]
    finally:
        spark.sql("DROP TABLE made_here")


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "A", None, "me", "old", None), (2, None, "N", None, "me", "old", None), (3, "c", "C", None, "me", "old", None)], SCHEMA)
    new = spark.createDataFrame([(9, "a", "A2", "you"), (8, "d", "D", "you"), (7, None, "N2", "you"), (6, "d", "E", "you")], "Id long, URI string, Title string, By string")
    got = {(r.URI, r.Title): r for r in C.upsert(old, new, FILES).collect()}
    assert got[("a", "A2")].Id == 1 and got[("a", "A2")].By == "me" and got[("a", "A2")].Kind == "new" and got[("a", "A2")].UpdatedAt is not None
    assert got[("c", "C")].Kind == "old" and got[("c", "C")].UpdatedAt is None
    assert got[("d", "E")].Kind == "new" and ("d", "D") not in got and (None, "N") in got and (None, "N2") in got and len(got) == 5
    with pytest.raises(ValueError):
        C.upsert(old, new, {"columns": [{"name": "Id", "type": "integer"}]})


def test_insert_refuses_repeats(spark):
    old = spark.createDataFrame([(1, "a")], "Id long, URI string")
    fresh = spark.createDataFrame([(5, "b")], "Id long, URI string")
    assert C.insert(old, fresh, FILES).columns == ["URI"]
    for bad in ([(5, "a")], [(5, "b"), (6, "b")]):
        with pytest.raises(ValueError):
            C.insert(old, spark.createDataFrame(bad, "Id long, URI string"), FILES)


_PROGRAM = "reflect('java.lang.System', 'getProperty', 'user.home')"
REFUSED = [
    "DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE VIEW v AS SELECT 1", "SET a = 1", "WITH c AS (SELECT 1) INSERT INTO x SELECT * FROM c", "CACHE TABLE x", "ADD JAR 'x'", f"SELECT {_PROGRAM}", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT count(*) FROM text.`/etc/passwd`", "WITH c AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM c", "SELECT * FROM rows WHERE n IN (SELECT length(value) FROM text.`/etc/passwd`)",
    "SELECT (SELECT max(value) FROM text.`/etc/passwd`)", f"SELECT sum(n) OVER w FROM rows WINDOW w AS (ORDER BY {_PROGRAM})", f"SELECT filter(array(t), x -> {_PROGRAM} = x) FROM rows", f"SELECT * FROM VALUES ({_PROGRAM})", f"SELECT * FROM rows LATERAL VIEW explode(array({_PROGRAM})) AS q",
    "SELECT own_function(t) FROM rows", "SELECT TRANSFORM(n) USING 'cat' AS (x) FROM rows", "SELECT * FROM IDENTIFIER('text.`/etc/passwd`')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')", "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'SELECT 1'",
    "FROM text.`/etc/passwd` |> SELECT *", "SELECT * FROM not_given", "SELECT input_file_name() FROM rows",
]
ALLOWED = [
    ("SELECT n FROM rows WHERE n < 3", 3), ("WITH c AS (SELECT n, count(*) AS k FROM rows GROUP BY n) SELECT c.n, sum(k) OVER w FROM c JOIN rows USING (n) WINDOW w AS (PARTITION BY c.n ORDER BY t)", 10), ("SELECT explode(sequence(1, 3))", 3), ("SELECT * FROM range(3)", 3),
    ("SELECT n FROM rows WHERE EXISTS (SELECT 1 FROM rows r WHERE r.n = rows.n + 5) UNION ALL SELECT int(t) FROM rows WHERE t LIKE '1%'", 6), ("SELECT * FROM rows LATERAL VIEW explode(array(1, 2)) q AS x", 20), ("SELECT * FROM (VALUES (1, 'a')) AS v(a, b)", 1), ("FROM rows |> WHERE n > 3 |> SELECT t", 6),
]


@pytest.fixture(scope="module")
def numbers(spark):
    spark.udf.register("own_function", lambda x: x)
    rows = spark.range(10).selectExpr("id AS n", "cast(id AS string) AS t")
    rows.createOrReplaceTempView("not_given")
    return {"rows": rows}


@pytest.mark.parametrize("text", REFUSED)
def test_only_reading_statements_run(spark, numbers, text):
    with pytest.raises(sql.Refused):
        sql.query(spark, text, tables=numbers)


@pytest.mark.parametrize(("text", "n"), ALLOWED)
def test_reading_statements_run(spark, numbers, text, n):
    assert sql.query(spark, text, tables=numbers).count() == n


def test_without_a_list_every_registered_table_may_be_read(spark, numbers):
    assert sql.query(spark, "SELECT * FROM not_given WHERE n < :top", {"top": 4}).count() == 4
    assert sql.is_query(spark, "SELECT 1") and not sql.is_query(spark, "SELECT * FROM text.`/etc/passwd`")


def test_query_and_markdown(spark):
    df = spark.createDataFrame([(k, f"a|{k}") for k in range(20)], "n int, t string")
    out = sql.query(spark, "SELECT * FROM rows WHERE n < :top ORDER BY n", {"top": 12}, tables={"rows": df})
    assert out.count() == 12 and len(sql.markdown(out).splitlines()) == 11 and "a\\|0" in sql.markdown(out)
    assert sql.columns_of(df)[1] == {"cid": 1, "name": "t", "type": "string", "nullable": True}
    assert sql.statements("a;\nb; c\n;\n") == ["a", "b; c"]
