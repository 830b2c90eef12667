"""The number of clusters comes from the data and has no cap."""

from collections import Counter

import numpy as np

from quillstone.operators import cluster
from quillstone.plans.queries import QUERIES


def stored(spark, folder, m):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_gmm_finds_the_number_of_clusters(spark, tmp_path):
    r = np.random.default_rng(0)
    centres = r.normal(size=(7, 12)) * 40
    found = QUERIES["q_gmm"](spark, stored(spark, tmp_path, np.concatenate([c + r.normal(size=(60, 12)) for c in centres]))).collect()
    assert len({x.cluster for x in found}) == 7
    assert all(len({x.cluster for x in found if x.id // 60 == g}) == 1 for g in range(7))


def test_tree_has_no_cap_on_clusters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cluster, "LOCAL", 500, raising=False)  # so that parts are made, too
    r = np.random.default_rng(1)
    m = r.normal(size=(1500, 12))
    m[:40] = 1.0  # equal rows
    rows = QUERIES["q_tree"](spark, stored(spark, tmp_path, m)).collect()
    leaves = [x for x in rows if x.level == 0]
    assert sorted(x.node for x in leaves) == sorted(str(k) for k in range(1500))
    assert max(Counter(x.parent for x in rows if x.parent).values()) <= 20 and len({x.parent for x in leaves}) >= 75
    assert {x.parent for x in rows if x.parent} == {x.node for x in rows if x.level}


def test_least_finds_the_minimum_wherever_it_lies():
    for best in (1, 2, 3, 7, 50, 200, 333):
        assert cluster.least(lambda k: abs(k - best), 400) == best  # noqa: B023
    assert cluster.least(lambda k: -k, 1) == 1


def test_split_parts_well_told_groups():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(15, 3)) + 100 * g for g in range(9)])
    label = cluster.split(x, 20)
    assert len(set(label)) == 9 and all(len(set(label[15 * g : 15 * g + 15])) == 1 for g in range(9))


def test_parts_that_stay_large_are_halved_by_tasks_at_once(spark, monkeypatch):
    fits, own = [], cluster.BisectingKMeans
    monkeypatch.setattr(cluster, "BisectingKMeans", lambda **k: fits.append(k) or own(**k))
    monkeypatch.setattr(cluster, "LOCAL", 50)
    r = np.random.default_rng(3)
    m = np.concatenate([np.repeat(r.normal(size=(3, 10)) * 50, 200, axis=0), r.normal(size=(200, 10))])  # equal rows, which k-means can't tell apart
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "vec_id long, embedding array<float>")
    found = cluster.clusters(rows, most=20)
    assert len(fits) == 1 and found.rdd.getNumPartitions() >= 16  # however few bytes
    got = found.collect()
    assert sorted(x.id for x in got) == list(range(800)) and max(Counter(x.cluster for x in got).values()) <= 20
    assert max(Counter(x.cluster.rsplit(".", 1)[0] for x in got).values()) <= 50


def test_halves_are_small_whatever_the_rows():
    x = np.exp(np.arange(600.0) / 2)[:, None] * [1.0, 0.5]  # each 2-means would take off a row
    for rows, most in ((x, 50), (np.ones((300, 3)), 40), (np.random.default_rng(4).normal(size=(999, 4)), 100), (x[:5], 10)):
        label = cluster._halved(rows, most)
        assert max(Counter(label.tolist()).values()) <= most and set(label) == set(range(len(set(label)))) and len(set(label)) <= 16 * -(-len(rows) // most)
