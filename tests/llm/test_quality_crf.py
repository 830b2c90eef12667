from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, prose, table
from pyspark.sql import functions as F

from quillstone.llm import quality_crf as Q


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    score, trans = r.normal(size=7), r.normal(size=(2, 2))
    p, pairs, z = Q.Chains(doc).marginals(score, trans)
    want, all_pairs, all_z = np.zeros(7), np.zeros((2, 2)), 0.0
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weight = {y: np.exp(sum(score[i] * v for i, v in zip(at, y)) + sum(trans[u, v] for u, v in zip(y, y[1:]))) for y in product((0, 1), repeat=len(at))}
        total = sum(weight.values())
        all_z += np.log(total)
        for y, w in weight.items():
            for i, v in zip(at, y):
                want[i] += v * w / total
            for u, v in zip(y, y[1:]):
                all_pairs[u, v] += w / total
    assert np.allclose(p, want) and np.allclose(pairs, all_pairs) and np.isclose(z, all_z)


def junk(k):
    return "\n".join(" ".join(w.upper() + "!!" for w in prose(k * 7 + j, 12).split()) for j in range(1 + k % 4))


def good(k):
    return "\n".join(prose(k * 9 + j, 14).capitalize() + ". " + prose(k * 5 + j, 9).capitalize() + "." for j in range(1 + k % 5))


def sets(spark):
    docs = [(k, junk(k) if k % 4 == 0 else good(k)) for k in range(200)]
    labels = [(k, 0 if k % 4 == 0 else 1, 0) for k in range(100)] + [(5, None, 0), (None, 1, 0), (7, 0, 0), (100000, 1, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def frames(spark):
    docs, labels = sets(spark)
    return table(spark, docs), labels


def test_held_out_accuracy_and_line_level_mix(spark):
    docs, labels = sets(spark)
    w = Q.fit(table(spark, docs), labels)
    out = {r.doc_id: r for r in Q.classify(table(spark, docs), w).collect()}
    assert np.mean([out[k].keep == (k % 4 != 0) for k in range(100, 200)]) >= 0.97
    q, lines, bad = Q.scores(pa.array([good(3) + "\n" + junk(3), good(3), junk(3)]), w)
    assert q[2] < q[0] < q[1] and lines[0] == lines[1] + lines[2]


def test_driver_tables(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    w = Q.fit(docs, labels.where("doc_id % 2 = 0"))
    out = Q.classify(docs, w).select("doc_id", "keep").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in out]) >= 0.95


def test_hard_cases(spark):
    docs, labels = sets(spark)
    w = Q.fit(table(spark, docs), labels)
    data = [(1, None), (2, ""), (3, " \n\n\t"), (4, LONG), (None, good(1)), (5, good(2)), (5, good(2))]
    out = [(r.doc_id, r.quality, r.lines, r.keep) for r in Q.classify(table(spark, data), w).collect()]
    for k in (1, 2, 3):
        assert (k, None, 0, False) in out
    assert len([o for o in out if o[0] == 5]) == 2 and len(out) == 7
    kept = Q.keep(table(spark, data), w)
    assert kept.columns == table(spark, data).columns and {r.doc_id for r in kept.collect()} >= {None, 5} and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    assert Q.classify(table(spark, []), w).collect() == []


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(999, 0)]])
def test_nothing_to_learn_from_keeps_all_with_text(spark, labels):
    w = Q.fit(table(spark, [(1, "a b c")]), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert not w.any() and [r.keep for r in Q.classify(table(spark, [(1, "a b c")]), w).collect()] == [True]


def test_the_sample_is_bounded_in_bytes_and_well_defined(spark):
    docs, labels = frames(spark)
    whole = Q.fit(docs, labels)
    assert np.array_equal(whole, Q.fit(docs.repartition(3), labels)) and whole.any()
    assert not Q.fit(docs, labels, max_bytes=0).any() and not np.array_equal(Q.fit(docs, labels, max_bytes=8000), whole)
    twice = docs.union(docs.withColumn("text", F.concat(F.lit("~ "), "text")))  # greater than any text of its id
    assert np.array_equal(Q.fit(twice, labels), whole)


def test_a_document_of_many_lines(spark):
    docs, labels = frames(spark)
    weights = Q.fit(docs, labels)
    text = "\n".join([good(3)] * 25_000)
    row = Q.classify(table(spark, [(1, text), (2, good(3))]), weights).where("doc_id = 1").first()
    assert row.lines == 100_000 and row.keep
