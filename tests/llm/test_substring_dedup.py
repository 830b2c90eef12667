from helpers import LONG, WORD, prose, table

from quillstone.llm import substring_dedup as S


def brute(rows):
    """Spans by comparing every window of MIN_WORDS words with all before it."""
    seen, out = set(), {}
    for doc, text in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        found = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text or "")]
        cover, fresh = [0] * len(text or ""), []
        for i in range(len(found) - S.MIN_WORDS + 1):
            key = tuple(f[0] for f in found[i : i + S.MIN_WORDS])
            if key in seen:
                a, b = found[i][1], found[i + S.MIN_WORDS - 1][2]
                cover[a:b] = [1] * (b - a)
            seen.add(key)
        spans, start = [], None
        for at, v in enumerate([*cover, 0]):
            if v and start is None:
                start = at
            if not v and start is not None:
                spans.append((start, at))
                start = None
        if spans:
            out[doc] = spans
    return out


def rows():
    p, q = prose(1, 60), prose(2, 50)
    return [
        (1, prose(3, 40) + " " + p + " " + prose(4, 30)), (2, prose(5, 17) + ". " + p.upper() + "! " + prose(6, 80)), (3, q), (4, "É à " + q + " ü"), (5, prose(7, 49)), (6, prose(8, 20) + " " + prose(7, 49)),
        (7, None), (8, ""), (9, "..."), (10, LONG), (11, LONG), (12, "na " * 200), (13, prose(9, 70) + " " + prose(9, 70)), (14, p), (14, p), (None, p), (15, prose(1, 60)[:200]),
    ]


def got(spark, data):
    return {r.doc_id: [(s.start, s.end) for s in r.spans] for r in S.repeats(table(spark, data)).collect()}


def test_spans_equal_brute_force(spark):
    assert got(spark, rows()) == brute(rows())


def test_cover_meets_every_difference():
    for d in range(S.PERIOD):
        assert any((c + d) % S.PERIOD in S.COVER for c in S.COVER)


def test_every_alignment_of_a_passage_is_found(spark):
    p = prose(11, S.MIN_WORDS)
    data = [(0, p)] + [(i, prose(100 + i, i) + " " + p + " " + prose(200 + i, 7)) for i in range(1, 40)]
    assert set(got(spark, data)) == set(range(1, 40))


def test_clean_keeps_one_copy_and_all_columns(spark):
    docs = table(spark, rows())
    out = S.clean(docs)
    assert out.schema == docs.schema
    kept = {}
    for r in out.collect():
        kept.setdefault(r.doc_id, []).append(r)
    assert 11 not in kept and len(kept[10]) == 1 and kept[10][0].text == LONG
    assert 14 not in kept and kept[None][0].text == prose(1, 60)
    assert kept[7][0].text is None and kept[8][0].text == "" and kept[9][0].text == "..."
    assert kept[5][0].text == prose(7, 49) and kept[1][0].source == "s" and kept[1][0]._row == "own _row"
    assert got(spark, [(r.doc_id, r.text) for rs in kept.values() for r in rs if r.doc_id is not None]) == {}


def test_repeated_rows_are_one_document(spark):
    p = prose(20, 80)
    assert got(spark, [(1, p), (1, p)]) == {}
    assert sorted(r.text for r in S.clean(table(spark, [(1, p), (1, p)])).collect()) == [p, p]
    other = got(spark, [(1, p), (1, p + " more")])
    assert list(other) == [1]


def test_other_texts_of_an_id_are_documents_of_their_own(spark):
    p, q = prose(21, 80), prose(22, 300)
    data = [(0, p), (1, p), (1, q), (1, prose(23, 60)), (2, q + " " + prose(24, 10)), (3, prose(25, 60) + " " + p), (3, prose(26, 55))]
    out = S.repeats(table(spark, data)).collect()
    assert sorted((r.doc_id, r.chars) for r in out) == [(1, len(p)), (2, len(q)), (3, len(p))]
    assert sorted(len(r.text) for r in S.clean(table(spark, data)).where("doc_id = 1").collect()) == sorted([len(q), len(prose(23, 60))])


def test_empty(spark):
    assert S.repeats(table(spark, [])).collect() == [] and S.clean(table(spark, [])).collect() == []
