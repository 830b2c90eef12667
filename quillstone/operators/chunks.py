"""Chunks of documents, and the bookkeeping of which documents have been chunked."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X

SIZE, OVERLAP = 1000, 200
SEPARATORS = ("\n" * 2, "\n", *" .?!,;:", *("-" * n for n in (3, 4, 5)))


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to the size, each join starting with what of the one before fits the overlap."""
    out, held, total = [], [], 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        out.append("".join(held))
    return out


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Stripped chunks of at most size characters, but for stretches without any separator.

    The first separator that occurs cuts the text, staying at the head of the piece after it; pieces that
    are still too long are cut by the separators after it.
    """
    at = next((k for k, s in enumerate(separators) if s in text), None)
    if at is None:
        return [t] if (t := text.strip()) else []
    parts = text.split(separators[at])
    pieces = [parts[0], *[separators[at] + p for p in parts[1:]]]
    out, short = [], []
    for piece in filter(None, pieces):
        if len(piece) <= size:
            short.append(piece)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_text(piece, size, overlap, separators[at + 1 :])
    out += _merge(short, size, overlap)
    return [s for c in out if (s := c.strip())]


def chunk(docs: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, chunk of every document; a null or blank text has none."""

    def run(batches):
        for batch in batches:
            ids, index, chunks = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = split_text(text.as_py() or "", size, overlap)
                ids += [doc] * len(found)
                index += range(len(found))
                chunks += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(chunks, pa.string())], ["doc_id", "chunk_index", "chunk"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, chunk_index int, chunk string")


def chunk_rows(docs: DataFrame, path: str = "path", modified: str = "modified", *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, filename, chunk_index, file_date, chunk of documents with a path and a time of change."""
    kept = docs.select(F.col(path).alias("filename"), X.file_date(F.col(path), F.col(modified)).alias("file_date"), F.col("text").cast("string"))

    def run(batches):
        for b in batches:
            found = [split_text(t.as_py() or "", size, overlap) for t in b.column(2)]
            row = [k for k, f in enumerate(found) for _ in f]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), b.column(1).take(pa.array(row, pa.int64())), pa.array([i for f in found for i in range(len(f))], pa.int32()), pa.array([c for f in found for c in f], pa.string())],
                ["filename", "file_date", "chunk_index", "chunk"],
            )

    rows = kept.mapInArrow(run, "filename string, file_date string, chunk_index int, chunk string")
    return rows.select(X.chunk_id(F.col("filename"), F.col("chunk_index"), F.col("file_date")).alias("chunk_id"), "filename", "chunk_index", "file_date", "chunk")


def embedded_files(chunk_ids: DataFrame) -> DataFrame:
    """filename and how many of its chunks are stored, from ids of the form date::path#index."""
    return chunk_ids.select(X.chunk_path(F.col("chunk_id")).alias("filename")).where("filename is not null").groupBy("filename").agg(F.count(F.lit(1)).alias("chunks"))


def unsynced(files: DataFrame, stored: DataFrame, chunkless: DataFrame | None = None) -> DataFrame:
    """Files that neither have chunks nor are known to give none."""
    rest = files.join(stored.select("filename"), "filename", "left_anti")
    return rest.join(chunkless.select("filename"), "filename", "left_anti") if chunkless is not None else rest


def modified_since(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files changed after they were stored, and those never stored. stored: filename, last_updated."""
    both = files.join(stored.select("filename", "last_updated"), "filename", "left")
    return both.where("last_updated is null or modified > last_updated")
