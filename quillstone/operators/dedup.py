"""Exact dedup of normalised texts, and of files by size, head and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import text as X

HEAD_BYTES = 65536
#: Rows of three numbers and an extension up to which the sizes that files share are broadcast to their listing: 64 MB at most.
BROADCAST_SIZES = 1_000_000


def eligible(docs: DataFrame, least: int = 20) -> DataFrame:
    """Documents of enough words once normalised, with the normalised text as norm and its words."""
    return docs.withColumn("norm", X.normalize(F.col("text"))).withColumn("words", X.word_count(F.col("norm"))).where(F.col("words") >= least)


def first_seen(docs: DataFrame, least: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of the eligible documents, the least doc_id of each normalised text, how many share it, and what else to carry of that row.

    The text is shuffled as its digest only.
    """
    return eligible(docs, least).groupBy(F.sha2("norm", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[F.min_by(c, "doc_id").alias(c) for c in carry]).select("doc_id", "copies", *carry)


def _shared_sizes(rows: DataFrame) -> DataFrame:
    """(size, ext) that several files have, from the listing alone; broadcast if there are few enough."""
    many = rows.groupBy("size", "ext").agg(F.count(F.lit(1)).alias("peers")).where("peers > 1").select("size", "ext")
    return F.broadcast(many) if many.limit(BROADCAST_SIZES + 1).count() <= BROADCAST_SIZES else many


def file_keys(files: DataFrame) -> DataFrame:
    """path, size, ext, head digest of the files that share size and extension with another.

    Sizes are counted without reading any content, and a file of unique size is never hashed.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where((F.col("size") > 0) & ~F.startswith(name, F.lit("._")))
    return rows.join(_shared_sizes(rows), ["size", "ext"], "left_semi").withColumn("head", F.sha2(F.substring("content", 1, HEAD_BYTES), 256))


def donors(files: DataFrame) -> DataFrame:
    """(path, donor): for each file the first other one with the same bytes whose output isn't empty.

    files: path, size, ext, content, out_size (null without output). Contents never move: what is shuffled is a
    digest of all bytes, and of each group of equals only the two first donors.
    """
    key = ["size", "ext", "head", "whole"]
    keyed = file_keys(files).select("path", "size", "ext", "head", F.sha2("content", 256).alias("whole"), "out_size")
    first = keep_first(keyed.where("out_size > 0"), [F.col(k) for k in key], [F.col("path")], 2).groupBy(*key).agg(F.min("path").alias("one"), F.max("path").alias("two"))
    both = keyed.join(first, key).select("path", F.when(F.col("one") != F.col("path"), F.col("one")).when(F.col("two") != F.col("path"), F.col("two")).alias("donor"))
    return both.where("donor is not null")


def keep_first(rows: DataFrame, by: list[Column], order: list[Column], n: int = 1) -> DataFrame:
    """The n first rows of each group; order must not tie."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).where(F.col("_first") <= n).drop("_first")
