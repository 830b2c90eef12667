"""Every query of the library against its SQL, or against what must hold of its rows."""

import pytest
from compare import database, difference

from quillstone.operators.chunks import OVERLAP, SIZE
from quillstone.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(tiny):
    return database(tiny)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_its_sql(name, spark, tiny, db):
    assert difference(QUERIES[name](spark, tiny), db, ORACLE_SQL[name]) is None


def test_the_comparison_can_fail(spark, tiny, db):
    wrong = ORACLE_SQL["q_min_words"].replace(">= 20", ">= 40")
    assert difference(QUERIES["q_min_words"](spark, tiny), db, wrong)


@pytest.mark.parametrize("name", ["q_rerank_top12", "q_two_stage", "q_result_dedup", "q_cosine_topk", "q_l2_topk", "q_context", "q_references"])
def test_searches_ask_rows_divisible_by_100(name, spark, tiny):
    ids = {k for t, c in (("embeddings", "vec_id"), ("documents", "doc_id")) for k, *_ in spark.read.parquet(f"{tiny}/{t}.parquet").select(c).collect()}
    asked = {r.query_id for r in QUERIES[name](spark, tiny).collect()}
    assert {0, 100} <= asked <= {k for k in ids if k % 100 == 0}


def test_chunks_hold_the_text(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    seen = {}
    for r in QUERIES["q_chunks_of_documents"](spark, tiny).orderBy("doc_id", "chunk_index").collect():
        assert r.chunk == r.chunk.strip() and r.chunk in texts[r.doc_id] and len(r.chunk) <= SIZE
        assert r.chunk_index == len(seen.setdefault(r.doc_id, []))
        seen[r.doc_id].append(r.chunk)
    for doc, text in texts.items():
        at = 0
        for c in seen.get(doc, []):
            start = text.find(c, max(0, at - OVERLAP - 1))
            assert start >= 0 and not text[at:start].strip()
            at = start + len(c)
        assert not text[at:].strip()


def test_soft_clusters_are_probabilities(spark, tiny):
    rows = QUERIES["q_gmm"](spark, tiny).collect()
    n = spark.read.parquet(f"{tiny}/embeddings.parquet").count()
    assert {r.id for r in rows} and len({r.id for r in rows}) == n
    assert all(0.1 < r.probability <= 1 for r in rows)


def test_tree_has_every_leaf_and_one_parent_each(spark, tiny):
    rows = QUERIES["q_tree"](spark, tiny).collect()
    nodes = [r.node for r in rows]
    assert len(nodes) == len(set(nodes)) and {r.parent for r in rows if r.parent} <= set(nodes)
