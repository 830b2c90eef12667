"""Connected components by alternating large-star and small-star (Kiveris et al., 2014).

Each step aggregates the edges by a vertex, before the shuffle where it can, and joins them with what it found; the edges of every round are cut to the shared
checkpoint folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """(a, b, m) of edges, m being the least b of a in seen: a hub is aggregated where its edges lie, and joined with one row."""
    return edges.join(seen.groupBy("a").agg(F.min("b").alias("m")), "a")


def _large(edges: DataFrame) -> DataFrame:
    """Of edges with a > b."""
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return _with_least(up, edges.union(up)).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    m = _with_least(down, down)
    out = m.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of the edges (a, b): root is the least id it is connected with.

    Nulls, loops and repeated edges don't matter; no edges give no rows.
    """
    edges = K.cut(edges.where("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint")))
    edges = K.cut(_small(edges))
    state = _state(edges)
    while True:
        edges = K.cut(_small(K.cut(_large(edges))))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
