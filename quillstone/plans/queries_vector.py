"""Search, rerank and context queries. Rows of the embeddings whose id is divisible by 100 are the queries, all rows are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import cluster, retrieve
from quillstone.plans.queries_text import NORM
from quillstone.plans.registry import Tables, query


def _search(t: Tables, n: int, metric: str = "cosine") -> DataFrame:
    return retrieve.search(t.embeddings, t.embeddings.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), n, metric=metric)


def _sql(n: int, metric: str = "cosine") -> str:
    a, b = "q.embedding::double[]", "c.embedding::double[]"
    score = f"list_cosine_similarity({a}, {b})" if metric == "cosine" else f"pow(list_distance({a}, {b}), 2)"
    order = "score DESC" if metric == "cosine" else "score"
    return f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round({score}, 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS rank FROM s) SELECT * FROM r WHERE rank <= {n}"""


@query(_sql(12))
def cosine_topk(t: Tables) -> DataFrame:
    return _search(t, 12)


@query(_sql(12, "l2"))
def l2_topk(t: Tables) -> DataFrame:
    return _search(t, 12, "l2")


@query("SELECT conv_id, turn, (length(text) // 4 + 1) // 200 AS n_results FROM conversations")
def results_for_window(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.floor((X.token_estimate(F.col("text")) + 1) / 200).cast("bigint").alias("n_results"))


_WORDS = f"SELECT doc_id, list_distinct(list_filter(string_split({NORM}, ' '), lambda x: x <> '')) AS words FROM documents"
_RERANK = """WITH found AS ({found}), w AS ({words}), s AS (SELECT f.query_id, f.id, f.rank, round(len(list_intersect(q.words, d.words)) / len(q.words)::double, 6) AS rerank_score
    FROM found f JOIN w q ON q.doc_id = f.query_id JOIN w d ON d.doc_id = f.id WHERE len(q.words) > 0),
r AS (SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM s) SELECT * FROM r WHERE new_rank <= {n}"""


def _reranked(t: Tables, found: int, n: int) -> DataFrame:
    return retrieve.rerank_by_words(_search(t, found), t.documents, n).select("query_id", "id", "rerank_score", "new_rank")


@query(_RERANK.format(found=_sql(40), words=_WORDS, n=12))
def rerank_top12(t: Tables) -> DataFrame:
    return _reranked(t, 40, 12)


@query(_RERANK.format(found=_sql(20), words=_WORDS, n=5))
def two_stage(t: Tables) -> DataFrame:
    return _reranked(t, 20, 5)


@query(
    f"""WITH found AS ({_sql(12)}), d AS (SELECT f.query_id, f.id, f.rank, text FROM found f JOIN documents ON doc_id = f.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY rank) AS n FROM d) SELECT query_id, id, rank FROM r WHERE n = 1"""
)
def result_dedup(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text"))  # a digest of the whole text is as good and smaller
    return retrieve.without_repeats(_search(t, 12).join(docs, "id")).select("query_id", "id", "rank")


def _cited(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    date = F.when(k % 3 == 0, "2024-01-02")
    chunk = F.concat(F.when(k % 3 == 1, "2023-05-06::").otherwise(""), "source", F.lit("#"), k.cast("string"))
    docs = t.documents.select(k.alias("id"), F.when(k % 4 > 0, F.col("source")).alias("filename"), date.alias("file_date"), F.md5("text").alias("text"), chunk.alias("chunk_id"), F.when(k % 2 == 0, (k % 7).cast("int")).alias("chunk_index"))
    return _search(t, 12).join(docs, "id")


_CITED = f"""SELECT f.*, CASE WHEN doc_id % 4 > 0 THEN source END AS filename, CASE WHEN doc_id % 3 = 0 THEN '2024-01-02' END AS file_date, md5(text) AS text,
    CASE WHEN doc_id % 3 = 1 THEN '2023-05-06::' ELSE '' END || source || '#' || doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 7)::int END AS chunk_index FROM ({_sql(12)}) f JOIN documents ON doc_id = f.id"""


@query(
    f"""SELECT query_id, string_agg('From ' || coalesce(filename, 'Unknown') || ' (Date: ' || coalesce(file_date, 'Unknown') || '):' || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context,
    count(*) AS parts FROM ({_CITED}) GROUP BY query_id"""
)
def context(t: Tables) -> DataFrame:
    return retrieve.context(_cited(t))


@query(f"SELECT query_id, rank, chunk_id AS doc_id, coalesce(filename, 'Unknown') AS filename, coalesce(file_date, CASE WHEN instr(chunk_id, '::') > 0 THEN string_split(chunk_id, '::')[1] END) AS file_date, coalesce(chunk_index, 0) AS chunk_index FROM ({_CITED})")
def references(t: Tables) -> DataFrame:
    return retrieve.references(_cited(t))


@query()
def gmm(t: Tables) -> DataFrame:
    return cluster.soft_clusters(t.embeddings)


@query()
def tree(t: Tables) -> DataFrame:
    return cluster.tree(t.embeddings, levels=2)
