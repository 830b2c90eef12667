"""Providers, the vector store, retrieval, requirements, questions to tables, and the commands."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import cli
from quillstone.models import providers as P
from quillstone.models import rag, vectors
from quillstone.models.store import NOTHING, Store
from quillstone.operators import retrieve

AT = datetime.datetime(2024, 5, 1)


def docs(spark, *rows):
    return spark.createDataFrame([(n, t, AT + datetime.timedelta(hours=h)) for n, t, h in rows], "filename string, text string, modified timestamp")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_providers(spark):
    assert P.from_config({"class": "template", "template": "<{prompt}>", "context-window": "128K"}).query("x") == "<x>"
    assert P.metric("128K") == 131072 and P.budget("x" * 400, 4096, 100) == 100 and P.budget("x" * 16000, 4096, 2048) == 1024
    with pytest.raises(ValueError):
        P.from_config({"class": "none"})
    left = [2]

    def flaky():
        left[0] -= 1
        if left[0]:
            raise OSError
        return "ok"

    assert P.retried(flaky, wait=0) == "ok"
    rows = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, p string")
    assert sorted(map(tuple, P.ask(rows, {"class": "echo"}, F.col("p"), max_tokens=2).collect())) == [(1, "a b", None), (2, None, None)]
    failed = P.ask(rows.where("doc_id = 1"), {"class": "ollama", "host": "http://127.0.0.1:9", "model": "m"}, F.col("p"), tries=1).first()
    assert failed.answer is None and "Error" in failed.error


def test_rerankers():
    encode = vectors.hashed()
    assert vectors.overlap([("a b", "b c"), ("", "x")]).tolist() == [0.5, 0.0] and len(vectors.overlap([])) == 0
    s = vectors.cosine_scorer(encode)([("red fox", "red fox"), ("red fox", "blue whale sings"), ("", "x")])
    assert s[0] > 0.99 and s[0] > s[1] and s[2] == 0 and len(vectors.cosine_scorer(encode)([])) == 0


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 8)).round(1)
    m[7] = m[3]  # a tie
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(60, None), (61, [0.0] * 8), (62, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.where("vec_id < 10").withColumnRenamed("vec_id", "query_id")
    f = m.astype(np.float32).astype(float)
    for metric in ("cosine", "l2"):
        got = {(r.query_id, r.rank): r.id for r in retrieve.search(df, q, 5, metric=metric).collect()}
        for k in range(10):
            s = np.round(f @ f[k] / np.linalg.norm(f, axis=1) / np.linalg.norm(f[k]), 6) if metric == "cosine" else np.round(((f - f[k]) ** 2).sum(1), 6)
            rest = [(-x if metric == "cosine" else x, i) for i, x in enumerate(s)] + ([(round(float((f[k] ** 2).sum()), 6), 61)] if metric == "l2" else [])
            assert [got[(k, r)] for r in range(1, 6)] == [i for _, i in sorted(rest)[:5]]
    wide, block = retrieve.BROADCAST_BYTES, retrieve.BLOCK_BYTES
    try:
        a = {tuple(r) for r in retrieve.search(df, q, 5).collect()}
        retrieve.BROADCAST_BYTES, retrieve.BLOCK_BYTES = 0, 300
        blocked = retrieve.search(df, q, 5)
        assert {tuple(r) for r in blocked.collect()} == a and "Join" not in blocked._jdf.queryExecution().executedPlan().toString()
    finally:
        retrieve.BROADCAST_BYTES, retrieve.BLOCK_BYTES = wide, block


def test_search_holds_n_rows_a_query_whatever_comes(spark):
    rng = np.random.default_rng(1)
    held, ids = np.full((30, 4), np.inf), np.full((30, 4), np.iinfo(np.int64).max)
    seen, names = np.zeros((30, 0)), np.zeros(0, np.int64)
    for size in (3, 200, 1, 50, 500):
        v, i = rng.integers(0, 40, (30, size)).astype(float), rng.permutation(10_000)[:size]  # many ties
        v[rng.random(v.shape) < 0.1], v[:2] = np.nan, np.nan
        seen, names = np.hstack([seen, v]), np.concatenate([names, i])
        retrieve._keep(held, ids, v, i)
        for q in range(30):
            want = sorted((s, n) for s, n in zip(seen[q], names) if s == s)[:4]
            assert [(s, n) for s, n in zip(held[q], ids[q]) if s < np.inf] == want


def test_rerank_runs_the_search_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def searched(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "c"), (4, "z")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 3)], "query_id long, id long, rank long").mapInArrow(searched, "query_id long, id long, rank long")
    got = retrieve.rerank_by_words(found, docs, 2).collect()
    assert [(r.id, r.rerank_score, r.new_rank) for r in sorted(got, key=lambda r: r.new_rank)] == [(2, 0.666667, 1), (3, 0.333333, 2)] and runs.value == 3


def test_store_loads_what_is_new_or_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path), size=40, overlap=10)
    assert store.file_count() == 0 and store.retrieve(queries(spark, "x")).first().context == NOTHING
    assert store.load(docs(spark, ("a.txt", "the red fox jumps over the dog and runs away into the woods", 0), ("b/2023-01-02/b.txt", "a blue whale sings", 0), ("empty.txt", " ", 0), ("null.txt", None, 0))) == (4, 3)
    assert store.load(docs(spark, ("a.txt", "changed but as old", 0), ("empty.txt", " ", 0))) == (0, 0)
    assert store.file_count() == 2 and store.entry_count() == 3 and store.newest() == AT
    found = store.retrieve(queries(spark, "blue whale", "red fox"), cut=1).orderBy("query_id").collect()
    assert found[0].context == "From b/2023-01-02/b.txt (Date: 2023-01-02):\na blue whale sings\n" and "red fox" in found[1].context
    assert store.load(docs(spark, ("a.txt", "green", 1))) == (1, 1)
    assert store.entry_count() == 2 and {r.chunk for r in store.chunks().collect()} == {"green", "a blue whale sings"}
    ref = store.references(queries(spark, "whale")).where("rank = 1").first()
    assert ref.filename == "b/2023-01-02/b.txt" and ref.file_date == "2023-01-02"
    reranked = store.retrieve(queries(spark, "green"), make_scorer=lambda: vectors.overlap).first()
    assert reranked.context.startswith("From a.txt") and reranked.parts == 2


def test_rag_answers_from_context(spark, tmp_path):
    r = rag.Rag(Store(spark, str(tmp_path)), {"class": "template", "template": "{prompt}", "context-window": "1K"})
    assert r.sync(docs(spark, ("a.txt", "whales sing", 0), ("b.txt", "whales sing", 0))) == (2, 2)
    row = r.query(queries(spark, "do whales sing")).first()
    assert "whales sing" in row.answer and "Question: do whales sing" in row.answer and row.error is None
    assert r.find(queries(spark, "whales")).count() == 1
    assert r.sync(docs(spark, *[(f"c{k}.txt", f"whales {'sing' if k < 3 else k}", 0) for k in range(6)])) == (6, 6)
    assert sorted(x["rank"] for x in r.find(queries(spark, "whales sing"), cut=3).collect()) == [1, 2, 3]


def test_requirements(spark):
    source = docs(spark, ("a.md", "must fly", 0), ("b.md", "must swim", 0), ("requirements.md", "x", 0), ("a.requirements.md", "y", 0), ("c.txt", "z", 0)).drop("modified")
    done = spark.createDataFrame([("b.md", "swim")], "filename string, requirements string")
    rows, whole = rag.requirements(source, {"class": "template", "template": "{prompt}"}, done)
    assert {r.filename for r in rows.collect()} == {"a.md", "b.md"} and "### b.md\n\nswim" in whole and "must fly" in whole
    with pytest.raises(ValueError):
        rag.requirements(source.where("filename = 'c.txt'"), {"class": "echo"})
    pages = spark.createDataFrame([(1, "text")], "page int, text string")
    assert rag.with_repair(pages, {"class": "template", "template": " "}, "repair").first().text == "text"


def test_questions_become_reading_sql(spark):
    class Written(P.Base):
        replies = [' {"sql": "DROP TABLE t"}', 'so: {"sql": "SELECT count(*) AS n FROM t"}', "three rows"]

        def query(self, prompt, max_tokens=None):
            return self.replies.pop(0)

    out = rag.Warehouse(spark, Written({}), {"t": spark.range(3)}).query("how many")
    assert out["sql"] == "SELECT count(*) AS n FROM t" and "| 3 |" in out["table"] and out["answer"] == "three rows" and out["error"] is None
    Written.replies = ["no json"] * 5
    assert rag.Warehouse(spark, Written({}), {}).query("x")["error"]


def test_commands(spark, tmp_path):
    (tmp_path / "a.txt").write_text("The cafÃ© sold tea and cakes all day.\nqwrtpz lkjhgf mnbvcx zxcvbn asdfgh\n")
    (tmp_path / "b.md").write_text("fine as it is")
    (tmp_path / "c.xyz").write_bytes(b"\x00")
    dry = cli.clean(spark, str(tmp_path), dry_run=True)
    assert dry == {"changed": 1, "unchanged": 1, "lines_dropped": 1, "errors": 0} and "Ã" in (tmp_path / "a.txt").read_text()
    assert cli.clean(spark, str(tmp_path)) == dry and (tmp_path / "a.txt").read_text() == "The café sold tea and cakes all day.\n"
    (tmp_path / "p.rtf").write_bytes(rb"{\rtf1 Hi}")
    (tmp_path / "q.docx").write_bytes(b"damaged")
    got = cli.convert(spark, str(tmp_path))
    assert got["convert"] == 2 and (tmp_path / "p.rtf.md").read_text() == "Hi" and (tmp_path / "q.docx.md").read_text() == ""
    assert cli.convert(spark, str(tmp_path))["fresh"] == 2 and cli.convert(spark, str(tmp_path), retry_errors=True, dry_run=True)["retry"] == 1
    (tmp_path / "P.md").write_text("made of p.rtf, long ago")
    (tmp_path / "z.md").write_text("made of z.pdf")
    (tmp_path / "z.pdf").write_bytes(b"")
    assert cli.fix_names(spark, str(tmp_path))["rename"] == 1 and (tmp_path / "z.pdf.md").exists()
    made = cli.requirements(spark, str(tmp_path), {"class": "template", "template": "{prompt}"})
    assert made["sources"] and "fine as it is" in (tmp_path / "requirements.md").read_text() and (tmp_path / "b.requirements.md").exists()
    json.dumps(made)
