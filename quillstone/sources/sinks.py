"""Sinks: tables to folders, and texts to one file each where that is what is wanted."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, folder: str) -> None:
    """With a header; times in ISO form."""
    times = [c for c, kind in df.dtypes if kind.startswith("timestamp")]
    df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in times}).write.mode("overwrite").csv(folder, header=True, escape='"')


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_text(df: DataFrame, folder: str, column: str = "text") -> None:
    df.select(column).write.mode("overwrite").text(folder)


def write_parquet(df: DataFrame, folder: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(folder)


def write_files(df: DataFrame, *, path: str = "out_path", text: str = "text", keep: str = "kept") -> DataFrame:
    """path, state of one file a row, written by the tasks: written, deleted (not kept, but there), absent or error.

    A file is written beside its place and then moved there, so that a task that runs again does no harm. Paths must
    be on a file system that every executor mounts.
    """

    def one(to: str, value: str | None, kept: bool | None) -> str:
        to = to.removeprefix("file:")
        try:
            if kept and value is not None:
                part = f"{to}.{os.getpid()}.part"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(value)
                os.replace(part, to)
                return "written"
            if os.path.exists(to):
                os.remove(to)
                return "deleted"
            return "absent"
        except OSError:
            return "error"

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(*row) for row in zip(*(c.to_pylist() for c in b.columns))], pa.string())], ["path", "state"])

    kept = F.col(keep) if keep in df.columns else F.lit(True)
    return df.select(F.col(path).alias("path"), F.col(text).alias("text"), kept.alias("kept")).where("path is not null").mapInArrow(run, "path string, state string")
