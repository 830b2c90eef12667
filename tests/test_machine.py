"""State machines: one runner, a fold over events, and the same over a stream."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillstone.plans.queries_catalog import SWITCH
from quillstone.streaming.machine import Machine, Runner, fold, seconds, stream


def test_switch_walks_and_restores():
    r = Runner(SWITCH, {})
    r.env["switch"] = True
    assert r.tick() and r.state == "on" and not r.tick()
    r.env["switch"] = False
    assert r.tick() and r.state == "off"
    again = Runner.load(r.save())
    assert again.state == "off" and again.env == {"switch": False}
    assert Runner.load(r.save(), with_env=False).env == {}


def test_elapsed_waits():
    now = [0.0]
    m = Machine({"states": {"start": {"transitions": {"t": {"when": {"elapsed": "1m"}, "state": "end"}}}, "end": {"transitions": None}}})
    r = Runner(m, clock=lambda: now[0])
    assert not r.tick()
    now[0] = 60.0
    assert r.tick() and r.state == "end" and not r.tick()


def test_default_transition_and_veto():
    m = Machine({"states": {"start": {"transitions": {"x": {"state": "b"}, "y": {"when": {"go": 1}, "state": "c"}}}, "b": {}, "c": {}}})
    assert Runner(m, {"go": 2}).machine.next("start", {"go": 2}) == "b" and m.next("start", {"go": 1}) == "c"
    vetoed = Runner(m, callback=lambda runner, to: False)
    assert not vetoed.tick() and vetoed.state == "start"
    assert m.next("start", {}) == "c"  # a condition on an unknown name doesn't count
    with pytest.raises(ValueError):
        Machine({"states": {"other": {}}})


def rows():
    at = datetime.datetime(2024, 1, 1)
    on, off = '{"switch": true}', '{"switch": false}'
    return [(1, at, 1, on), (1, at, 2, on), (1, at + datetime.timedelta(hours=1), 3, off), (2, at, 4, None), (2, at, 5, off), (None, at, 6, on)]


WANTED = [(1, 1, "on", True), (1, 2, "on", False), (1, 3, "off", True), (2, 4, "on", True), (2, 5, "off", True)]


def test_fold(spark):
    df = spark.createDataFrame(rows(), "k long, at timestamp, n long, c string")
    assert sorted(map(tuple, fold(df, SWITCH, key="k", at="at", order="n", change="c").collect())) == WANTED
    assert fold(df.limit(0), SWITCH, key="k", at="at", order="n", change="c").collect() == []


def test_fold_of_many_keys_is_one_stream(spark, monkeypatch):
    from quillstone.streaming import machine

    m = Machine({"states": {"start": {"transitions": {"a": {"when": {"go": 1, "elapsed": "1h"}, "state": "b"}, "c": {"when": {"level": 3}, "state": "c"}}}, "b": {"transitions": {"d": {"when": {"go": 2}, "state": "start"}}}, "c": {"transitions": {"e": {"state": "b"}}}}})
    start = datetime.datetime(2024, 1, 1)
    what = [None, '{"go": 1}', '{"go": 2}', '{"level": 3}', '{"level": [1], "other": 5}', '{"go": 1, "level": null}']
    rows = [(k, start + datetime.timedelta(minutes=17 * (n * n % 40)), n, what[(k * n + n) % 6]) for k in range(40) for n in range(30)]
    want = []
    for k in range(40):
        now, env = [0.0], {}
        r = Runner(m, env, clock=lambda: now[0])  # noqa: B023
        mine = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))
        r.entered = mine[0][1].timestamp()
        for _, at, n, change in mine:
            env.update(json.loads(change or "{}"))
            now[0] = at.timestamp()
            moved = r.tick()
            want.append((k, n, r.state, moved))
    df = spark.createDataFrame(rows, "k long, at timestamp, n long, c string").repartition(3, "n")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys go on from batch to batch
        got = fold(df, m, key="k", at="at", order="n", change="c")
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    monkeypatch.setattr(machine, "_KNOWN", 2)
    envs, env, number = machine._Envs(m), {}, 0
    for k in range(60):
        env |= json.loads(what[k * k % 5 + 1])
        number = envs.change(number, what[k * k % 5 + 1])
        assert envs.envs[number] == {x: v for x, v in env.items() if x != "other"} and len(envs.envs) < 6 and envs.of("start", number) == m.choices("start", env)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()  # no call for each key


def test_stream_equals_fold(spark, tmp_path):
    df = spark.createDataFrame(rows(), "k long, at timestamp, n long, c string")
    for k, part in enumerate((F.col("n") < 3, F.col("n") >= 3)):
        df.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = stream(events, SWITCH, key="k", at="at", order="n", change="c")
    q = out.writeStream.format("memory").queryName("machine_out").option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            q.awaitTermination(1)
            if len(got := sorted(tuple(r) for r in spark.sql("SELECT * FROM machine_out").collect())) == len(WANTED):
                break
    finally:
        q.stop()
    assert [r[:2] for r in got] == [r[:2] for r in WANTED] and [r[2] for r in got if r[0] == 1] == ["on", "on", "off"]


CASES = [("1mo", 2629746), ("1y", 86400), ("1.5mo", 3944619), ("2d3h4m5s", 183845), ("1h30m", 5400), ("90", 90), (90, 90), ("x1h", 0), ("1h x 5m", 300), ("1h,5m", 300), ("", 0), (None, 0), ("3 hours", 10800), ("1e2", 100), ("5 lightyears", 0)]


def test_durations_are_those_of_the_column_function(spark):
    from quillstone.functions import scalars as S

    got = [r.s for r in spark.createDataFrame([(k, None if v is None else str(v)) for k, (v, _) in enumerate(CASES)], "k int, v string").orderBy("k").select(S.to_seconds(F.col("v")).alias("s")).collect()]
    assert got == [seconds(v) for v, _ in CASES] and seconds("1mo") == 2629746 and seconds("1y") == 86400 and seconds("2d3h4m5s") == 183845


def test_a_runner_has_no_cap():
    m = Machine({"states": {f"s{k}": {"transitions": {"t": {"state": f"s{k + 1}"}}} for k in range(3000)} | {"s3000": {}}}, start="s0")
    assert Runner(m).run() == 3000


def test_stream_timer_takes_a_transition_without_an_event(spark, tmp_path):
    m = Machine({"states": {"start": {"transitions": {"go": {"when": {"go": True}, "state": "wait"}}}, "wait": {"transitions": {"t": {"when": {"elapsed": "2s"}, "state": "late"}}}, "late": {}}})
    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), 1, '{"go": true}')], "k long, at timestamp, n long, c string")
    (tmp_path / "in").mkdir()
    df.write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream(events, m, key="k", at="at", order="n", change="c").writeStream.format("memory").queryName("timer_out").option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            q.awaitTermination(1)
            got = [tuple(r) for r in spark.table("timer_out").collect()]
            if len(got) == 2:
                break
    finally:
        q.stop()
    assert got == [(1, 1, "wait", True), (1, None, "late", True)]
