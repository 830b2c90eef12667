"""Folders of files as tables: one row a file, its bytes read by the tasks, its text by the reader of its extension."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import files as O
from quillstone.sources import formats

#: Extensions of a corpus, case-sensitive.
EXTENSIONS = (".txt", ".docx", ".pdf", ".md", ".rtf", ".epub", ".rdf")
SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def corpus(spark: SparkSession, folder: str | None, extensions: tuple[str, ...] = EXTENSIONS, *, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of the files whose name ends in one of the extensions.

    Content is read only where a query asks for it. A falsy folder gives no rows, a missing one an error.
    """
    if not folder:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    wanted = F.lit(False)
    for e in extensions:
        wanted = wanted | F.endswith(path, F.lit(e))
    return rows.withColumn("path", path).where(wanted)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length of every file under a folder, the empty ones too, which a scan leaves out.

    Listed on the driver, as a scan lists its files; a missing folder is an error.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    rows = []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return spark.createDataFrame(rows, "path string, ms bigint, length bigint").select("path", F.timestamp_millis("ms").alias("modificationTime"), "length")


def file_count(spark: SparkSession, folder: str | None, extensions: tuple[str, ...] = EXTENSIONS) -> int:
    """How many files of a folder have one of the extensions."""
    if not folder:
        return 0
    wanted = F.lit(False)
    for e in extensions:
        wanted = wanted | F.endswith("path", F.lit(e))
    return listing(spark, folder).where(wanted).count()


def _decoded(decode, column: Column) -> Column:
    def run(raw: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode(x) for x in raw.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(column)


def decode_best_effort(content: Column) -> Column:
    """Text of bytes: UTF-8, else the Western code page, else Latin-1. Valid UTF-8 never leaves the JVM."""
    plain = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(F.regexp_replace(plain, "^\ufeff", ""), _decoded(formats.best_effort, F.when(plain.isNull(), content)))


def decode_any(content: Column) -> Column:
    """Text of bytes by the wider ladder of encodings."""
    return _decoded(formats.any_encoding, content)


def repair_utf8(text: Column) -> Column:
    """UTF-8 that was once decoded as something else."""
    return _decoded(formats.as_utf8, text)


def texts(files: DataFrame, readers: dict[str, formats.Reader] | None = None, *, books: bool = False) -> DataFrame:
    """path, modificationTime, length, text of files with content; text is null where a file can't be read."""

    def run(batches):
        for b in batches:
            one = formats.read_book if books else formats.read
            text = [None if raw is None else one(path, raw, readers) for path, raw in zip(b.column(0).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(text, pa.string())], ["path", "modificationTime", "length", "text"])

    return files.select("path", "modificationTime", "length", "content").mapInArrow(run, "path string, modificationTime timestamp, length bigint, text string")


def spine_text(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """book, text of its items in reading order. spine: book, position, idref; manifest: book, id, text."""
    rows = spine.join(manifest, (spine["book"] == manifest["book"]) & (spine["idref"] == manifest["id"])).select(spine["book"], "position", "text").where("trim(coalesce(text, '')) <> ''")
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return rows.groupBy("book").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def cleaned(spark: SparkSession, folder: str, extension: str = ".cleaned") -> DataFrame:
    """path, text of the files of that extension, each as a whole."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, *, header: bool = True) -> DataFrame:
    """All columns are text, as they stand in the file."""
    return spark.read.csv(path, header=header, inferSchema=False, multiLine=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def converted(files: DataFrame, outputs: DataFrame, *, extension: str = ".cleaned", overwrite: bool = False, keep=None, readers: dict[str, formats.Reader] | None = None) -> DataFrame:
    """path, out_path, text, kept of the files whose output is missing or older: what a sink has to write, or to delete.

    outputs: path, modificationTime of what there is. White space collapses; keep is a function of the text column,
    and where it isn't true an output that exists has to go.
    """
    have = outputs.select(F.col("path").alias("out_path"), F.col("modificationTime").alias("out_time"))
    rows = files.where(~F.endswith("path", F.lit(extension))).withColumn("out_path", F.concat("path", F.lit(extension))).join(have, "out_path", "left")
    stale = F.lit(overwrite) | O.needs_conversion(F.col("modificationTime"), F.col("out_time"))
    read = texts(rows.where(stale), readers).select("path", F.concat("path", F.lit(extension)).alias("out_path"), X.collapse_whitespace(F.col("text")).alias("text"))
    return read.withColumn("kept", F.coalesce(keep(F.col("text")) if keep else F.lit(True), F.lit(False)) & F.col("text").isNotNull())
