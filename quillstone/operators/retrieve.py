"""Exact vector search, rerank, and the context that is made of what was found.

Queries are rows, so that any number is answered in one pass; each keeps its own ranking. The corpus is never shuffled
as a whole: every task keeps the best of its rows for each query, and only these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import text as X
from quillstone.operators.shared import cut

#: Bytes of query vectors and of what a task holds for them up to which they are broadcast to the corpus at once; beyond that they are broadcast block by block.
BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 32 << 20
#: Scores that a task holds at once.
BLOCK = 1 << 18
#: Bytes of ids up to which they are broadcast to the texts they name.
FOUND_BYTES = 32 << 20


def search(corpus: DataFrame, queries: DataFrame, n: int, *, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", digits: int = 6, at_once: bool = False) -> DataFrame:
    """query_id, id, score, rank of the n best rows of each query; ties go to the lesser id.

    metric: cosine (the greatest first) or l2 (squared, the least first). Rows without a vector, of other length than the
    query, or of zero norm under cosine, aren't found. Each row of queries has a ranking of its own number; at_once
    broadcasts all query vectors whatever their size.
    """
    wanted = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(vector).alias("v")).where("q is not null and v is not null")
    size = wanted.agg(F.coalesce(F.sum(F.size("v") + 2 + 2 * n), F.lit(0))).first()[0] * 8
    rows = corpus.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    sign = -1.0 if metric == "cosine" else 1.0

    def score(q: np.ndarray, m: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(norm > 0, (q @ m.T) / norm, np.nan)
        return np.maximum(((q * q).sum(axis=1)[:, None] + (m * m).sum(axis=1)[None, :]) - 2 * (q @ m.T), 0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each width (scores, ids) of the n first of each query, however many rows and batches there are
        held = {w: (np.full((len(q), n), np.inf), np.full((len(q), n), np.iinfo(np.int64).max)) for w, (_, q) in shared.value.items()}
        for batch in batches:
            for width, (ids, m) in _by_width(batch.column(0), batch.column(1)).items():
                if width not in held:
                    continue
                q, step = shared.value[width][1], max(1, BLOCK // max(n, len(ids)))
                for a in range(0, len(q), step):
                    _keep(*(x[a : a + step] for x in held[width]), sign * np.round(score(q[a : a + step], m), digits), ids)
        for width, (v, i) in held.items():
            step = max(1, BLOCK // n)
            for a in range(0, len(v), step):
                k, c = np.nonzero(v[a : a + step] < np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[width][0][k + a]), pa.array(i[k + a, c]), pa.array(sign * v[k + a, c])], ["q", "id", "score"])

    if size > BROADCAST_BYTES and not at_once:
        # as many passes over the corpus as there are blocks; each keeps its ranking alone, so that its broadcast can go
        blocks = -(-size // BLOCK_BYTES)
        wanted = cut(wanted.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))))
        parts = []
        for k in range(blocks):
            part = wanted.where(F.col("_block") == k).select(F.col("q").alias(query_id), F.col("v").alias(vector))
            parts.append(cut(search(corpus, part, n, metric=metric, id_col=id_col, vector=vector, query_id=query_id, digits=digits, at_once=True)))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
    flat = wanted.toArrow()
    table = _by_width(flat.column(0).combine_chunks(), flat.column(1).combine_chunks())
    shared = corpus.sparkSession.sparkContext.broadcast(table)
    return _ranked(rows.mapInArrow(best, "q bigint, id bigint, score double"), n, sign)


def _keep(held: np.ndarray, held_ids: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
    """Puts scores v of (query, row) among the held ones of each query, which stay as many and in the order of (score, id)."""
    n = held.shape[1]
    last = np.minimum(held[:, -1], np.finfo(float).max)
    near = v <= last[:, None]  # all that tie with the last stay until ids decide; what isn't a number isn't found
    if len(ids) > n and np.count_nonzero(near) > 2 * n * len(v):
        near = v <= np.fmin(last, np.partition(v, n - 1, axis=1)[:, n - 1])[:, None]
    k, c = np.nonzero(near)
    at = np.unique(k)
    k, v, i = np.concatenate([np.repeat(at, n), k]), np.concatenate([held[at].ravel(), v[k, c]]), np.concatenate([held_ids[at].ravel(), ids[c]])
    order = np.lexsort((i, v, k))
    start = np.searchsorted(k[order], at)
    kept = order[(start[:, None] + np.arange(n)).ravel()]
    held[at], held_ids[at] = v[kept].reshape(-1, n), i[kept].reshape(-1, n)


def _by_width(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    i = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    width = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for w in set(width.tolist()) - {0}:
        at = np.flatnonzero(width == w)
        out[w] = (i[at], vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, w))
    return out


def _ranked(pairs: DataFrame, n: int, sign: float) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.col("score") * sign, "id")
    return pairs.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n).select(F.col("q").alias("query_id"), "id", "score", "rank")


def overlap_score(query: Column, text: Column) -> Column:
    """The share of the query's distinct words that the text has: a reranker that needs no model."""
    q, t = F.array_distinct(F.split(X.normalize(query), " ")), F.split(X.normalize(text), " ")
    return F.size(F.array_intersect(q, t)) / F.size(q)


def word_sets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, words): the distinct normalised words of each text as 64-bit hashes."""
    words = F.filter(F.split(X.normalize(F.col(text)), " "), lambda w: w != "")
    return docs.select(F.col(id_col).alias("id"), F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))).alias("words"))


def rerank_by_words(found: DataFrame, docs: DataFrame, n: int = 12, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The n best hits of each query by the share of the query's words that a hit has; queries and hits are rows of docs.

    Texts that aren't hit are not read on: only the sets of those found, made once, are joined with the pairs. The search
    itself runs once. Its ids are broadcast to the texts up to FOUND_BYTES, so that texts are shuffled only beyond that.
    """
    found = cut(found)
    both = cut(found.select(F.col("query_id").alias("id")).union(found.select("id")).distinct())
    both = F.broadcast(both) if both.count() * 16 <= FOUND_BYTES else both
    sets = cut(word_sets(docs.join(both, docs[id_col] == both["id"], "left_semi"), id_col, text))
    pairs = found.join(sets.select(F.col("id").alias("query_id"), F.col("words").alias("_q")), "query_id").join(sets.select("id", F.col("words").alias("_d")), "id").where(F.size("_q") > 0)
    return rerank(pairs, F.round(F.size(F.array_intersect("_q", "_d")) / F.size("_q"), 6), n).drop("_q", "_d")


def rerank(found: DataFrame, score: Column, n: int = 12) -> DataFrame:
    """The n best of each query by another score; ties keep their order."""
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return found.withColumn("rerank_score", score).withColumn("new_rank", F.row_number().over(w).cast("bigint")).where(F.col("new_rank") <= n)


def without_repeats(found: DataFrame, text: str = "text", order: str = "rank") -> DataFrame:
    """Of rows of one query and text, the first in rank order."""
    w = Window.partitionBy("query_id", F.sha2(text, 256)).orderBy(order)
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def context(found: DataFrame, *, by: str = "query_id", order: str = "rank", separator: str = "\n---\n") -> DataFrame:
    """One text for each query, of filename, file_date and text of its rows in rank order."""
    part = X.context_part(F.col("filename"), F.col("file_date"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return found.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["p"]), separator).alias("context"), F.count(F.lit(1)).alias("parts"))


def references(found: DataFrame) -> DataFrame:
    """What each part of a context cites; the date falls back on the one in the chunk's id."""
    dated = F.when(F.contains("chunk_id", F.lit("::")), F.split("chunk_id", "::").getItem(0))
    return found.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.coalesce("filename", F.lit("Unknown")).alias("filename"), F.coalesce("file_date", dated).alias("file_date"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"))


def results_for(tokens: int) -> int:
    """How many chunks a context window of so many tokens takes."""
    return tokens // 200
