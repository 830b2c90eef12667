import random
import time

import pyarrow as pa
import pytest
from helpers import LONG, prose, table, words
from pyspark.sql import functions as F

from quillstone.llm import license_scan as L
from quillstone.llm.license_texts import TEMPLATES


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignments_are_common_subsequences_and_longest_is_longest():
    r = random.Random(1)
    for _ in range(300):
        b = [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 2) for _ in range(r.randint(1, 40))]
        a = [x for x in b if r.random() > 0.2]
        for _ in range(5):
            a.insert(r.randint(0, len(a)), r.choice("qxyz"))
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b) == len(L.longest(a, b))
    text = [str(k) for k in range(200)]
    assert len(L.align(["x", *text[:90], "y", "z", *text[93:], "x"], text)) == 197


def test_exact_without_anchors():
    assert len(L.align(list("xabab"), list("aabb"))) == 3 and L.align([], ["a"]) == [] and L.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_planted_licences_are_found_and_prose_is_not(spark):
    r = random.Random(2)
    data, want = [], set()
    for k, (name, text) in enumerate(sorted(TEMPLATES.items())):
        w = text.split()
        worn = [x if r.random() > 0.04 or len(w) < 20 else "zzz" for x in w]
        data.append((k, prose(k, 90) + "\n" + " ".join(worn).upper() + "\n" + prose(k + 50, 40)))
        want.add((k, name))
    data += [(1000 + k, prose(k + 900, 300)) for k in range(30)]
    out = L.scan(table(spark, data)).collect()
    assert want <= {(r.doc_id, r.license) for r in out} and not [r for r in out if r.doc_id >= 1000]
    for r_ in out:
        assert L.COVERAGE <= r_.coverage <= 1


def test_brute_force_agrees_on_every_text(spark):
    """By longest common subsequence of whole short texts: what is covered is reported, what isn't isn't."""
    own = {"one": "alpha beta gamma delta epsilon zeta eta theta", "two": "the kappa of lambda and mu by nu"}
    r = random.Random(3)
    data = []
    for k in range(120):
        w = own[r.choice(["one", "two"])].split()
        data.append((k, " ".join(x for x in w if r.random() > 0.15)))
    got = {(x.doc_id, x.license) for x in L.scan(table(spark, data), templates=own).collect()}
    need = {n: -(-len(t.split()) * 4 // 5) for n, t in own.items()}
    assert got == {(k, n) for k, t in data for n, o in own.items() if lcs(words(t), words(o)) >= need[n]}


def test_twice_in_a_text_and_hard_cases(spark):
    notice = TEMPLATES["MIT notice"]
    data = [(1, f"Größe {notice} und {notice}"), (2, None), (3, ""), (4, LONG + " " + notice), (None, notice), (5, notice), (5, notice)]
    out = sorted((str(r.doc_id), r.start, r.end) for r in L.scan(table(spark, data)).collect())
    text = data[0][1]
    assert [text[a:b] for d, a, b in out if d == "1"] == [notice[:-1]] * 2
    assert [d for d, _, _ in out] == ["1", "1", "4", "5", "5", "None"] and L.scan(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        L.Scanner({"bad": "the of and"})


def test_copies_that_follow_each_other_directly_are_all_found(spark):
    for name in ("MIT notice", max(TEMPLATES, key=lambda n: len(TEMPLATES[n]))):
        notice = TEMPLATES[name]
        texts = [" ".join([*before, *[notice] * n, *after]) for n in (1, 2, 3, 4) for before in ([], ["Groesse"], ["some words of other text"]) for after in ([], ["and", "more", "text", "behind"])]
        found = {}
        for r in L.scan(table(spark, list(enumerate(texts))), templates={name: notice}).collect():
            found.setdefault(r.doc_id, []).append((r.start, r.end))
        end = len(notice.rstrip(".\n"))
        for k, text in enumerate(texts):
            starts = [i for i in range(len(text)) if text.startswith(notice, i)]
            assert [s for s, _ in sorted(found[k])] == starts, (k, text)
            assert all(e - s >= end - 1 for s, e in found[k])


def test_common_is_the_length_of_the_longest():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcdefg") for _ in range(r.randint(1, 30))] for _ in range(2))
        masks = {}
        for j, x in enumerate(b):
            masks[x] = masks.get(x, 0) | 1 << j
        assert L.common(a, masks, len(b)) == lcs(a, b)


def test_default_templates_against_brute_force(spark):
    """Texts about as long as their template, worn around the threshold: reported if and only if their common subsequence is long enough."""
    r = random.Random(6)
    own = {n: words(t) for n, t in TEMPLATES.items() if len(words(t)) <= 250}
    vocabulary = sorted({x for w in own.values() for x in w})
    data = []
    for k in range(60):
        w = own[sorted(own)[k % len(own)]]
        rate = r.uniform(0.1, 0.3)
        data.append((k, " ".join(r.choice(vocabulary) if r.random() < rate else x for x in w)))
    got = {(x.doc_id, x.license) for x in L.scan(table(spark, data), templates={n: TEMPLATES[n] for n in own}).collect()}
    # a region is twice the template's length, so that of the shorter templates only those as long as the text are told by its whole
    want = {(k, n) for k, t in data for n, o in own.items() if len(words(t)) <= 2 * len(o) and lcs(words(t), o) >= -(-len(o) * 4 // 5)}
    assert {x for x in got if len(words(data[x[0]][1])) <= 2 * len(own[x[1]])} == want and want


def test_licence_words_that_match_nothing_take_linear_time():
    r = random.Random(7)
    vocabulary = sorted({x for t in TEMPLATES.values() for x in words(t)})
    scanner = L.Scanner(TEMPLATES)
    took = []
    for n in (5_000, 20_000):
        (w,) = L.K.words(pa.array([" ".join(r.choices(vocabulary, k=n))]), 1 << 30)
        start = time.perf_counter()
        assert not list(scanner.scan(w))
        took.append(time.perf_counter() - start)
    assert took[1] < max(2, 8 * took[0])


def test_a_long_text_that_nearly_matches(spark):
    name = max(TEMPLATES, key=lambda n: len(TEMPLATES[n]))
    notice = TEMPLATES[name]
    near = [x if k % 4 else "zzz" for k, x in enumerate(words(notice))]
    text = " ".join(near * 20)
    found = L.scan(table(spark, [(1, text), (2, text + " " + notice)])).where(F.col("license") == name)
    assert [r.doc_id for r in found.collect()] == [2]
