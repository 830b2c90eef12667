"""Queries use whole texts and all rows: against plain Python over the same tables."""

from quillstone.plans.queries import QUERIES


def rows(spark, folder, table):
    return spark.read.parquet(f"{folder}/{table}.parquet").collect()


def test_result_dedup_drops_equal_whole_texts_only(spark, tiny):
    texts = {r.doc_id: r.text for r in rows(spark, tiny, "documents")}
    hits = sorted((r.query_id, r["rank"], r.id) for r in QUERIES["q_cosine_topk"](spark, tiny).collect())
    want, seen = set(), set()
    for q, rank, i in hits:
        if i in texts and (q, texts[i]) not in seen:
            seen.add((q, texts[i]))
            want.add((q, i, rank))
    assert {(r.query_id, r.id, r["rank"]) for r in QUERIES["q_result_dedup"](spark, tiny).collect()} == want


def test_pair_scores_are_of_whole_texts(spark, tiny):
    turns = sorted((r.conv_id, r.turn, r.role, r.text) for r in rows(spark, tiny, "conversations"))
    want = {}
    for k, (conv, turn, _, text) in enumerate(turns):
        own = set(text.lower().split())
        if text.strip():
            before = set(f"{turns[k - 1][2]} {turns[k - 1][3]}".lower().split()) if k and turns[k - 1][0] == conv else None
            want[conv, turn] = None if before is None else round(len(own & before) / len(own), 6)
    assert {(r.conv_id, r.turn): r.score for r in QUERIES["q_pair_scores"](spark, tiny).collect()} == want


def test_prompts_hold_the_whole_text(spark, tiny):
    want = {(r.conv_id, r.turn): f"Role {r.role} said {{{r.text}}}; {r.role}." for r in rows(spark, tiny, "conversations")}
    assert {(r.conv_id, r.turn): r.prompt for r in QUERIES["q_prompts"](spark, tiny).collect()} == want


def test_stub_answers_are_the_whole_prompt(spark, tiny):
    texts = {r.item_id: r.text for r in rows(spark, tiny, "benchmark")}
    assert any(len(x.split()) > 50 for x in texts.values())
    assert {r.id: (r.answer, r.error) for r in QUERIES["q_stub_answers"](spark, tiny).collect()} == {k: (x, None) for k, x in texts.items()}
