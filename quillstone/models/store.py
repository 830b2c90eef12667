"""A vector store in a folder: chunks with vectors as Parquet by collection, and what is known of their files.

Chunks are only ever appended, under a generation number; a file's row in the table of files names the generation that
holds, so that a load that was cut off leaves nothing that is read.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.models import vectors
from quillstone.operators import chunks, retrieve

CHUNKS = "filename string, generation bigint, chunk_id string, chunk_index int, file_date string, chunk string, embedding array<float>"
FILES = "filename string, modified timestamp, generation bigint, chunks bigint"
NOTHING = "No relevant documents found."


class Store:
    """One collection of a folder that all executors share; make_encoder gives each task its embedder."""

    def __init__(self, spark: SparkSession, folder: str, collection: str = "default", make_encoder: Callable[[], vectors.Encoder] | None = None, size: int = chunks.SIZE, overlap: int = chunks.OVERLAP):
        self.spark, self.make = spark, make_encoder or (lambda: vectors.hashed())
        self.size, self.overlap = size, overlap
        self.at = {name: f"{folder.rstrip('/')}/{collection}/{name}" for name in ("chunks", "files")}

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at[name])
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(self.at[name]) if there else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        """filename, modified, generation, chunks: the last load of each file; chunks is 0 where a file gave none."""
        w = Window.partitionBy("filename").orderBy(F.desc("generation"))
        return self._read("files", FILES).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS).join(self.files().select("filename", "generation"), ["filename", "generation"], "left_semi")

    def load(self, docs: DataFrame) -> tuple[int, int]:
        """(files, chunks) added: of docs (filename, text, modified) those that are new or have changed since they were loaded.

        A file that gave no chunks is remembered and only read again once it changes.
        """
        known = self.files().select("filename", F.col("modified").alias("_known"))
        fresh = docs.join(known, "filename", "left").where("_known is null or modified > _known").drop("_known")
        number = time.time_ns()
        rows = fresh.select("filename", "text", "modified")
        made = chunks.chunk_rows(rows, path="filename", size=self.size, overlap=self.overlap)
        made = made.select("filename", F.lit(number).alias("generation"), "chunk_id", "chunk_index", "file_date", "chunk")
        vectors.embed(made, self.make).write.mode("append").parquet(self.at["chunks"])
        mine = self._read("chunks", CHUNKS).where(F.col("generation") == number).groupBy("filename").agg(F.count(F.lit(1)).alias("chunks"))
        done = fresh.groupBy("filename").agg(F.max("modified").alias("modified")).join(mine, "filename", "left")
        done.select("filename", "modified", F.lit(number).alias("generation"), F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks")).write.mode("append").parquet(self.at["files"])
        added = self._read("files", FILES).where(F.col("generation") == number).agg(F.count(F.lit(1)), F.coalesce(F.sum("chunks"), F.lit(0))).first()
        return int(added[0]), int(added[1])

    def newest(self):
        """The greatest time of change that has been loaded; None for an empty store."""
        return self.files().agg(F.max("modified")).first()[0]

    def embedded_files(self) -> DataFrame:
        """filename, chunks of the files that have any."""
        return self.files().where("chunks > 0").select("filename", "chunks")

    def file_count(self) -> int:
        return self.embedded_files().count()

    def entry_count(self) -> int:
        return int(self.embedded_files().agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0])

    def search(self, queries: DataFrame, n: int = 80, *, metric: str = "cosine") -> DataFrame:
        """The n nearest chunks of each query. queries: query_id, query."""
        rows = self.chunks().withColumn("vec_id", F.xxhash64("chunk_id", "generation"))
        wanted = vectors.embed(queries.select("query_id", "query"), self.make, text_col="query")
        found = retrieve.search(rows, wanted, n, metric=metric)
        texts = rows.select(F.col("vec_id").alias("id"), "chunk_id", "filename", "file_date", "chunk_index", F.col("chunk").alias("text"))
        return found.join(texts, "id").join(queries.select("query_id", "query"), "query_id")

    def retrieve(self, queries: DataFrame, n: int = 80, cut: int = 12, *, make_scorer: Callable[[], vectors.Scorer] | None = None) -> DataFrame:
        """query_id, context, parts: the best chunks, reranked where a scorer is given and in the order of their distance else."""
        found = self.search(queries, n)
        if make_scorer is not None:
            score = vectors.pair_score(F.col("query"), F.col("text"), make_scorer)
            best = retrieve.rerank(found, score, cut).withColumn("rank", F.col("new_rank"))
        else:
            best = found.where(F.col("rank") <= cut)
        out = retrieve.context(best.select("query_id", "rank", "filename", "file_date", "text"))
        return queries.select("query_id").join(out, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NOTHING)).alias("context"), F.coalesce("parts", F.lit(0)).cast("bigint").alias("parts"))

    def references(self, queries: DataFrame, n: int = 80) -> DataFrame:
        return retrieve.references(self.search(queries, n))
