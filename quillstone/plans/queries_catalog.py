"""Catalog, SQL and state machine queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.models import providers, rag
from quillstone.plans import catalog, sql
from quillstone.plans.registry import Tables, query
from quillstone.streaming.machine import Machine, fold

CUSTOMER = {"columns": [
    {"name": "c_custkey", "type": "integer"}, {"name": "c_name", "type": "text", "unique": True}, {"name": "c_nationkey", "type": "integer", "update": False},
    {"name": "c_acctbal", "type": "real"}, {"name": "c_mktsegment", "type": "text", "update": False, "default": "'RESET'"},
]}


def _given(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        (k + 1_000_000).alias("c_custkey"), F.when(k % 3 != 1, F.concat("c_name", F.lit("-new"))).otherwise(F.col("c_name")).alias("c_name"), F.lit(99).cast("bigint").alias("c_nationkey"), (F.col("c_acctbal") + 1).alias("c_acctbal")
    )


@query(
    """WITH g AS (SELECT c_custkey + 1000000 AS c_custkey, c_name || CASE c_custkey % 3 WHEN 1 THEN '' ELSE '-new' END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer)
SELECT CASE WHEN o.c_name IS NULL THEN g.c_custkey WHEN g.c_name IS NULL THEN o.c_custkey ELSE g.c_custkey END AS c_custkey, coalesce(o.c_name, g.c_name) AS c_name,
    CASE WHEN o.c_name IS NULL THEN 99 ELSE o.c_nationkey END::int AS c_nationkey, coalesce(g.c_acctbal, o.c_acctbal) AS c_acctbal,
    CASE WHEN g.c_name IS NULL THEN o.c_mktsegment ELSE 'RESET' END AS c_mktsegment FROM customer o FULL JOIN g ON o.c_name = g.c_name"""
)
def upsert(t: Tables) -> DataFrame:
    return catalog.upsert(t.customer, _given(t), CUSTOMER)


@query("SELECT c_custkey + 1000000 AS c_custkey, c_name || '-new' AS c_name, c_acctbal FROM customer")
def insert(t: Tables) -> DataFrame:
    data = t.customer.select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.concat("c_name", F.lit("-new")).alias("c_name"), "c_acctbal")
    return catalog.insert(t.customer, data, CUSTOMER)


_PASS = "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > {low} GROUP BY n_name"


@query(_PASS.format(low=100))
def sql_passthrough(t: Tables) -> DataFrame:
    return sql.query(t.spark, _PASS.format(low=":low"), {"low": 100}, tables={"customer": t.customer, "nation": t.nation})


@query("SELECT c_mktsegment AS segment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def warehouse(t: Tables) -> DataFrame:
    """A question answered by SQL that a (here: fixed) reply holds, run behind the guard."""
    reply = {"sql": "SELECT c_mktsegment AS segment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment"}
    house = rag.Warehouse(t.spark, providers.from_config({"class": "template", "template": json.dumps(reply)}), {"customer": t.customer})
    return house.rows("customers and balance of each segment")


@query("SELECT * FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey) ORDER BY orders DESC, o_custkey LIMIT 9")
def preview(t: Tables) -> DataFrame:
    return sql.preview(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orders"), "o_custkey"))


@query("SELECT * FROM (VALUES ('customer', 'c_custkey', 'alter'), ('customer', 'c_phone', 'add'), ('visits', '', 'create')) t(\"table\", \"column\", action)")
def schema_diff(t: Tables) -> DataFrame:
    declared = {"customer": {"columns": [{"name": "c_custkey", "type": "text", "is_primary_key": True}, {"name": "c_name", "type": "text"}, {"name": "c_phone", "type": "text"}]}, "visits": {"columns": [{"name": "id", "type": "integer"}]}}
    return t.spark.createDataFrame(catalog.differences(declared, {"customer": t.customer.schema}), "table string, column string, action string")


_DEPTH = """WITH RECURSIVE {name}(node, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL
    SELECT n.n_nationkey, t.depth + 1 FROM {name} t JOIN nation n ON n.n_nationkey > 0 AND {parent} = t.node) SELECT node, depth FROM {name}"""


@query(_DEPTH.format(name="t", parent="(n.n_nationkey - 1) // 3"))
def toposort(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("nation")
    return t.spark.sql(_DEPTH.format(name="t", parent="(n.n_nationkey - 1) DIV 3"))


SWITCH = Machine({"states": {
    "start": {"transitions": {True: {"when": {"switch": True}, "state": True}, False: {"when": {"switch": False}, "state": False}}},
    True: {"transitions": {False: {"when": {"switch": False}, "state": False}}},
    False: {"transitions": {True: {"when": {"switch": True}, "state": True}}},
}})


@query(
    """WITH s AS (SELECT user_id AS key, event_id AS "order", CASE WHEN value > 50 THEN 'on' ELSE 'off' END AS state, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, value > 50 AS now FROM events)
SELECT key, "order", state, was IS NULL OR was <> now AS entered FROM s"""
)
def state_machine(t: Tables) -> DataFrame:
    change = F.when(F.col("value") > 50, '{"switch": true}').otherwise('{"switch": false}')
    return fold(t.events.withColumn("change", change), SWITCH, key="user_id", at="ts", order="event_id", change="change")


IDLE = Machine({"states": {"start": {"transitions": {"next": {"when": {"elapsed": "1h"}, "state": "start"}}}}})


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, event_id, n, since, entered) AS (SELECT user_id, event_id, n, ts, false FROM e WHERE n = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ts - r.since >= INTERVAL 1 HOUR THEN e.ts ELSE r.since END, e.ts - r.since >= INTERVAL 1 HOUR FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id AS key, event_id AS "order", 'start' AS state, entered FROM r"""
)
def elapsed(t: Tables) -> DataFrame:
    return fold(t.events.withColumn("change", F.lit(None).cast("string")), IDLE, key="user_id", at="ts", order="event_id", change="change")


RESTING = Machine({"states": {"start": {"transitions": {"a": {"when": {"elapsed": "1mo"}, "state": "rested"}}}, "rested": {"transitions": {"b": {"when": {"elapsed": "1y"}, "state": "start"}}}}})


@query(
    """WITH RECURSIVE e AS (SELECT o_custkey, o_orderkey, o_orderdate AS ts, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
r(o_custkey, o_orderkey, n, since, state, entered) AS (SELECT o_custkey, o_orderkey, n, ts, 'start', false FROM e WHERE n = 1 UNION ALL
    SELECT o_custkey, o_orderkey, n, CASE WHEN due THEN ts ELSE since END, CASE WHEN due THEN CASE state WHEN 'start' THEN 'rested' ELSE 'start' END ELSE state END, due FROM (
        SELECT e.*, r.since, r.state, epoch(e.ts) - epoch(r.since) >= CASE r.state WHEN 'start' THEN 2629746 ELSE 86400 END AS due FROM r JOIN e ON e.o_custkey = r.o_custkey AND e.n = r.n + 1))
SELECT o_custkey AS key, o_orderkey AS "order", state, entered FROM r"""
)
def elapsed_long(t: Tables) -> DataFrame:
    return fold(t.orders.withColumn("change", F.lit(None).cast("string")), RESTING, key="o_custkey", at="o_orderdate", order="o_orderkey", change="change")


@query(
    """WITH s AS (SELECT user_id, ts, value > 50 AS now, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, event_id FROM events),
c AS (SELECT user_id, now, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM s WHERE was IS NULL OR was <> now)
SELECT user_id, event_id, CASE WHEN now THEN 'on' ELSE 'off' END AS state, round(epoch_us(until) / 1e6 - epoch_us(ts) / 1e6, 3) AS seconds FROM c"""
)
def state_durations(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("now", F.col("value") > 50).withColumn("was", F.lag("now").over(w))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    moved = rows.where("was is null or was <> now").withColumn("until", F.lead("ts").over(w))
    return moved.select("user_id", "event_id", F.when(F.col("now"), "on").otherwise("off").alias("state"), F.round(us("until") - us("ts"), 3).alias("seconds"))


@query("SELECT strftime(o_orderdate, '%Y%m') AS issue, count(*) AS files, min(o_orderkey) AS first FROM orders GROUP BY 1")
def issue_group(t: Tables) -> DataFrame:
    path = F.concat(F.lit("in/issue-"), F.date_format("o_orderdate", "yyyyMM"), F.lit("-"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    return t.orders.groupBy(F.regexp_extract(path, r"issue-(\d{6})", 1).alias("issue")).agg(F.count(F.lit(1)).alias("files"), F.min("o_orderkey").alias("first"))


@query("SELECT lang, string_agg(md5(text), chr(10) || chr(10) ORDER BY doc_id) AS joined FROM documents GROUP BY lang")
def ordered_concat(t: Tables) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("doc_id", F.md5("text").alias("m"))))
    return t.documents.groupBy("lang").agg(F.array_join(F.transform(parts, lambda p: p["m"]), "\n\n").alias("joined"))


@query("SELECT c_custkey, c_acctbal::double AS c_acctbal, c_nationkey::double AS c_nationkey, c_name FROM customer")
def convert_columns(t: Tables) -> DataFrame:
    return sql.numbers_to_double(t.customer.select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"), "c_nationkey", "c_name"), keep=("c_custkey",))


#: Declared columns and the types they get; also what README lists.
TYPE_NAMES = {name: kind.simpleString() for name, kind in catalog.TYPES.items()} | {"": T.NullType().simpleString()}
