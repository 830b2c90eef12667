import random

import numpy as np
from helpers import LONG, prose, shingles, table

from quillstone.llm import minhash as M
from quillstone.llm.components import components


def worn(text, rate, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > rate else prose(r.randint(0, 10**9), 1) for w in text.split())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def roots(pairs, ids):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def data():
    rows = []
    for g in range(25):
        base, first = prose(g, 150), len(rows)
        rows += [(first + k, base if k == 0 else worn(base, 0.02 * (k % 4), g * 10 + k)) for k in range(1 + g % 5)]
    return rows + [(500 + k, prose(900 + k, 120)) for k in range(60)]


def test_recall_and_precision_against_brute_force(spark):
    rows = data()
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b, jaccard(sets[a], sets[b])) for a in sets for b in sets if a < b]
    group = {r.doc_id: r.group_id for r in M.groups(table(spark, rows)).collect()}
    near = [(a, b) for a, b, j in pairs if j >= 0.5]
    assert np.mean([a in group and group[a] == group.get(b) for a, b in near]) >= 0.95
    far = roots([(a, b) for a, b, j in pairs if j >= 0.25], sets)
    assert all(far[i] == far[g] for i, g in group.items()) and all(min(i for i, h in group.items() if h == g) == g for g in group.values())


def test_large_group_of_copies_is_one(spark):
    base = prose(1, 80)
    rows = [(k, worn(base, 0.01, k)) for k in range(1500)] + [(5000 + k, prose(2000 + k, 80)) for k in range(50)]
    group = {r.doc_id: r.group_id for r in M.groups(table(spark, rows)).collect()}
    assert set(group) == set(range(1500)) and set(group.values()) == {0}
    assert {r.doc_id for r in M.keep(table(spark, rows)).collect()} == {0, *range(5000, 5050)}


def test_links_connect_what_all_pairs_connect():
    r = np.random.default_rng(0)
    base = r.integers(0, 50, (8, M.HASHES)).astype(np.uint16)
    sigs = np.concatenate([np.where(r.random(M.HASHES) < p, base[k], r.integers(100, 60000, M.HASHES)).astype(np.uint16)[None] for k in range(8) for p in (1, 0.9, 0.7, 0.5, 0.45)])
    ids, least = np.arange(len(sigs)) * 3, int(M.THRESHOLD * M.HASHES)
    every = [(int(ids[a]), int(ids[b])) for a in range(len(ids)) for b in range(a) if (sigs[a] == sigs[b]).sum() >= least]
    assert roots(M.links(ids, sigs, least), ids.tolist()) == roots(every, ids.tolist())


def test_components(spark):
    r = random.Random(4)
    for n, m in ((30, 15), (200, 150), (60, 59)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(59)] if n == 60 else []) + [(None, 1), (5, 5)]
        out = {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        real = [(a, b) for a, b in edges if a is not None and a != b]
        want = roots(real, {x for e in real for x in e})
        assert out == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hard_cases(spark):
    p = prose(1, 60)
    rows = [(1, p), (2, p), (3, None), (4, None), (5, ""), (6, ""), (7, "..."), (8, "one two"), (9, "One, two!"), (None, p), (None, p), (10, LONG), (11, LONG + " x"), (2, p), (12, prose(2, 50)), (12, prose(2, 50)), (13, "solo"), (13, prose(3, 40))]
    docs = table(spark, rows)
    group = {r.doc_id: r.group_id for r in M.groups(docs).collect()}
    assert group == {1: 1, 2: 1, 8: 8, 9: 8, 10: 10, 11: 10}
    kept = M.keep(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 10, 12, 13, 13, None, None], key=str)
    assert M.groups(table(spark, [])).collect() == [] and M.keep(table(spark, [])).collect() == []


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c, d = (prose(k, 60) for k in range(20, 24))
    rows = [(1, a), (1, b), (2, c), (2, c), (3, b), (4, d), (4, worn(d, 0.01, 1)), (5, None), (5, None), (5, "x y")]
    kept = sorted(((r.doc_id, r.text) for r in M.keep(table(spark, rows)).collect()), key=str)
    near = [t for i, t in kept if i == 4]
    assert len(near) == 1 and near[0] in (rows[5][1], rows[6][1])  # which one follows from a hash of the text
    assert [r for r in kept if r[0] != 4] == sorted([(1, a), (1, b), (2, c), (5, None), (5, "x y")], key=str)
    group = {(r.doc_id, r.group_id) for r in M.groups(table(spark, rows)).collect()}
    assert group == {(1, 1), (3, 1), (4, 4)}
    assert kept == sorted(((r.doc_id, r.text) for r in M.keep(table(spark, rows[::-1]).repartition(3)).collect()), key=str)


def test_of_repeated_rows_the_least_json_stays(spark):
    rows = spark.createDataFrame([(1, "x y z", k, {"m": k}) for k in (3, 1, 2)], "doc_id long, text string, _row long, extra map<string,long>")
    assert [r._row for r in M.keep(rows).collect()] == [1]


def test_scripts_without_spaces(spark):
    a = "今天我们讨论大规模训练数据的去重方法，它需要在许多机器上运行。" * 3
    rows = [(1, a), (2, a.replace("许多", "很多")), (3, "完全不同的另一篇文章，讲的是春天的花和秋天的月亮。")]
    assert {r.doc_id: r.group_id for r in M.groups(table(spark, rows)).collect()} == {1: 1, 2: 1}
