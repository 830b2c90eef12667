"""Embedders and rerankers as functions of columns, with stand-ins that need no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[Sequence[str]], np.ndarray]
Scorer = Callable[[Sequence[tuple[str, str]]], np.ndarray]


def hashed(width: int = 64) -> Encoder:
    """Words hashed into a vector of unit length: deterministic, without a model."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[k, h % width] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return encode


def embed(df: DataFrame, make: Callable[[], Encoder], *, text_col: str = "chunk", into: str = "embedding", batch: int = 256) -> DataFrame:
    """df with a column of vectors; null texts have none. make() is called once a task."""
    schema = df.select("*", F.lit(None).cast("array<float>").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            have = [k for k, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for a in range(0, len(have), batch):
                part = have[a : a + batch]
                for k, v in zip(part, np.asarray(encode([texts[i] for i in part]), np.float32)):
                    out[k] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], [*b.schema.names, into])

    return df.mapInArrow(run, schema)


def overlap(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """Share of the first text's distinct words that the second has."""
    out = []
    for query, text in pairs:
        q = set(query.lower().split())
        out.append(len(q & set(text.lower().split())) / len(q) if q else 0.0)
    return np.array(out)


def cosine_scorer(encode: Encoder) -> Scorer:
    """Similarity of separately encoded texts: a reranker made of an embedder."""

    def score(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
        if not len(pairs):
            return np.zeros(0)
        a, b = (np.asarray(encode([p[i] for p in pairs]), float) for i in (0, 1))
        norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return np.divide((a * b).sum(axis=1), norm, out=np.zeros(len(pairs)), where=norm > 0)

    return score


def pair_score(query: Column, text: Column, make: Callable[[], Scorer]) -> Column:
    """Scores of (query, text) rows by a scorer, batch by batch; null if either is null."""

    def run(q: pa.Array, t: pa.Array) -> pa.Array:
        pairs = list(zip(q.to_pylist(), t.to_pylist()))
        have = [k for k, p in enumerate(pairs) if None not in p]
        out: list = [None] * len(pairs)
        for k, s in zip(have, make()([pairs[k] for k in have]) if have else ()):
            out[k] = float(s)
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(query, text)
