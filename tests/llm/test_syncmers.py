import numpy as np
from helpers import LONG, WORD, prose, table

from quillstone.llm import syncmers as S


def brute(text, k=S.K_SIZE, s=S.S_SIZE):
    """Positions by taking every k-mer on its own."""
    found = list(WORD.finditer(text))
    seq, at = b"", []
    for n, m in enumerate(found):
        for c, ch in enumerate(m.group()):
            raw = ch.lower().encode()
            seq += raw
            at += [m.start() + c] * len(raw)
        if n + 1 < len(found):
            seq += b" "
            at.append(m.end())
    out = []
    for i in range(len(seq) - k + 1):
        inner = S.hashes(np.frombuffer(seq[i : i + k], np.uint8), s)
        if inner.min() in (inner[0], inner[-1]):
            out.append((at[i], int(S.hashes(np.frombuffer(seq[i : i + k], np.uint8), k).view(np.int64)[0])))
    return out


def test_equals_brute_force(spark):
    data = [(k, prose(k, 30 + k)) for k in range(25)] + [(30, "É, ü! " * 60), (31, prose(1, 60).upper() + "..."), (32, "na " * 100)]
    for r in S.fingerprints(table(spark, data)).collect():
        assert list(zip(r.positions, r.hashes)) == brute(dict(data)[r.doc_id]) and r.n == len(r.hashes)


def test_shared_passages_share_anchors_whatever_the_context(spark):
    p = prose(5, 40)
    assert len(p) >= 2 * S.K_SIZE - S.S_SIZE
    data = [(k, prose(50 + k, k) + " " + p + " " + prose(90 + k, 5)) for k in range(1, 30)]
    sets = [set(r.hashes) for r in S.fingerprints(table(spark, data)).collect()]
    assert set.intersection(*sets)


def test_density_and_hard_cases(spark):
    out = {r.doc_id: r for r in S.fingerprints(table(spark, [(1, LONG), (2, None), (3, ""), (4, "short"), (5, prose(1, 50)), (5, prose(1, 50)), (None, prose(1, 50))])).collect()}
    assert abs(out[1].n / len(LONG) - 2 / (S.K_SIZE - S.S_SIZE + 1)) < 0.02
    assert all((out[k].positions, out[k].hashes, out[k].n) == ([], [], 0) for k in (2, 3, 4)) and out[None].hashes == out[5].hashes
    assert S.fingerprints(table(spark, [])).collect() == []


def test_matches_by_position(spark):
    p = prose(31, 60)
    data = [(1, prose(32, 20) + " " + p), (2, p + " " + prose(33, 30)), (3, p), (4, prose(34, 50)), (5, prose(35, 30) + " " + p + " " + prose(36, 5) + " " + p), (None, p), (6, None)]
    prints = S.fingerprints(table(spark, data))
    got = {tuple(r) for r in S.matches(prints).collect()}
    first, want = {}, {}
    for r in sorted((r for r in prints.collect() if r.doc_id is not None), key=lambda r: r.doc_id):
        for at, h in zip(r.positions, r.hashes):
            if h in first:
                want.setdefault((r.doc_id, first[h][0], first[h][1] - at), []).append(at)
            first.setdefault(h, (r.doc_id, at))
    assert got == {(*k, len(v), min(v), max(v)) for k, v in want.items()}
    assert {(d, o, s) for d, o, s, *_ in got} >= {(2, 1, len(data[0][1]) - len(p)), (3, 1, len(data[0][1]) - len(p))} and not [g for g in got if g[0] == 4]
    assert S.matches(S.fingerprints(table(spark, []))).collect() == []


def test_scripts_without_spaces(spark):
    a = "今天我们讨论大规模训练数据的去重方法，它需要在许多机器上运行，每台机器只看到一部分数据。" * 2
    out = {r.doc_id: r for r in S.fingerprints(table(spark, [(1, a), (2, "前面的话。" + a), (3, "中 文")])).collect()}
    assert out[1].n > 0 and set(out[1].hashes) <= set(out[2].hashes) and out[3].n == 0
    assert {(r.doc_id, r.other_id, r["shift"]) for r in S.matches(S.fingerprints(table(spark, [(1, a), (2, "前面的话。" + a)]))).collect()} >= {(2, 1, -5)}
