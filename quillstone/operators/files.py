"""File conversion as a query: what is stale, what may be reused, what is misnamed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TEXT_LAYER = ("pdf", "docx", "rtf", "rdf", "epub")
OFFICE = ("xlsx", "xls", "pptx", "ppt", "doc")
REMOTE = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "mp3", "wav", "m4a", "flac", "ogg")
PLAIN = ("txt", "md", "csv", "json", "html", "htm", "xml", "yaml", "yml")
CONVERTIBLE = TEXT_LAYER + OFFICE + REMOTE
MAX_AUDIO = 25 * 1024 * 1024
#: What is repaired in place: text formats only.
CLEANABLE = ("txt", "text", "md", "markdown", "rst", "log", "csv", "tsv", "json", "yaml", "yml", "xml", "html", "htm", "ini", "cfg", "conf")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty without one, and for a name that is nothing else."""
    name = file_name(path)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def route(path: Column) -> Column:
    """Which reader a file goes to."""
    ext = extension(path)
    return F.when(ext.isin(*TEXT_LAYER, *OFFICE), ext).when(ext.isin("mp3", "wav", "m4a", "flac", "ogg"), "audio").when(ext.isin(*REMOTE), "image").otherwise("text")


def needs_conversion(source: Column, target: Column) -> Column:
    """Whether an output is stale: a source without output, or one that is newer. Equal times are fresh; no source is never stale."""
    return F.when(source.isNull(), False).when(target.isNull(), True).otherwise(source > target)


def is_sidecar(name: Column, content: Column) -> Column:
    """Resource forks left by other systems: the name begins with ._ and the bytes with 00051607."""
    return F.startswith(name, F.lit("._")) & (F.hex(F.substring(content, 1, 4)) == "00051607")


def cleanable(path: Column) -> Column:
    """Whether a file of a folder may be repaired in place: a text format, neither a backup nor a sidecar."""
    name = file_name(path)
    return extension(path).isin(*CLEANABLE) & ~F.startswith(name, F.lit("._")) & ~F.endswith(name, F.lit(".bak"))


def audio_fits(size: Column) -> Column:
    """Whether a sound file is small enough to be sent."""
    return size <= MAX_AUDIO


def markdown_row(columns: list[str]) -> Column:
    """A row of a markdown table; nulls are empty, bars escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))


def plan(files: DataFrame, *, force: bool = False, retry_errors: bool = False, redo_ocr: bool = False, cutoff: Column | None = None) -> DataFrame:
    """Every file with action: convert, reconvert, retry, fresh, empty, or ignored.

    files: path, size, mtime, out_mtime, out_size (null without output), needs_ocr. An empty output marks an
    error. needs_ocr counts only for a PDF that the date filter lets pass.
    """
    name, ext = file_name(F.col("path")), extension(F.col("path"))
    ignored = F.startswith(name, F.lit("._")) | ~ext.isin(*CONVERTIBLE)
    marker = F.coalesce(F.col("out_size") == 0, F.lit(False))
    late = F.coalesce(F.col("out_mtime") >= cutoff, F.lit(False)) if cutoff is not None else F.lit(False)
    stale = F.lit(force) | (F.lit(retry_errors) & marker) | needs_conversion(F.col("mtime"), F.col("out_mtime"))
    stale = stale | (F.lit(redo_ocr) & (ext == "pdf") & ~late & F.coalesce(F.col("needs_ocr"), F.lit(False)))
    action = F.when(ignored, "ignored").when(F.col("size") == 0, "empty").when(~stale, "fresh").when(marker, "retry").when(F.col("out_mtime").isNotNull(), "reconvert").otherwise("convert")
    return files.withColumn("action", action)


def summary(planned: DataFrame) -> DataFrame:
    """One row: how many files of each action."""
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return planned.agg(*[count(a) for a in ("convert", "reconvert", "retry", "fresh", "empty", "ignored")], F.count(F.lit(1)).alias("files"))


def fix_names(files: DataFrame) -> DataFrame:
    """For each .md file: rename to its single sibling's name plus .md, delete if several share its stem, else leave.

    files: path. Siblings are the other files of the folder with the same stem, whatever its case. A rename
    whose target exists is left.
    """
    rows = files.select("path", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("dir"), F.lower(stem(F.col("path"))).alias("low"), file_name(F.col("path")).alias("name"))
    md = rows.where(F.endswith("path", F.lit(".md"))).alias("m")
    other = rows.select("dir", "low", F.col("path").alias("sibling"))
    both = md.join(other, ["dir", "low"], "left")
    counted = both.groupBy("path").agg(F.count_if(F.col("sibling") != F.col("path")).alias("n"), F.min(F.when(F.col("sibling") != F.col("path"), F.col("sibling"))).alias("one"))
    target = F.concat("one", F.lit(".md"))
    taken = files.select(F.col("path").alias("taken"))
    joined = counted.withColumn("target", F.when(F.col("n") == 1, target)).join(taken, F.col("target") == F.col("taken"), "left")
    action = F.when(F.col("n") == 0, "leave").when(F.col("n") > 1, "delete").when(F.col("taken").isNotNull(), "leave").otherwise("rename")
    return joined.select("path", "n", action.alias("action"), F.when(action == "rename", F.col("target")).alias("target"))


def pdf_tiers(pages: DataFrame) -> DataFrame:
    """Which tier gives each page's text. pages: doc, page, native, plumbed, ocr (each null or blank if it gave nothing).

    The second tier serves a whole document, and only if there are native pages that are all blank; OCR serves the
    pages that are still blank.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    w = Window.partitionBy("doc")
    second = F.min(blank("native").cast("int")).over(w) == 1
    rows = pages.withColumn("second", second)
    tier = F.when(~blank("native"), "native").when(F.col("second") & ~blank("plumbed"), "plumbed").when(~blank("ocr"), "ocr").otherwise("none")
    text = F.when(tier == "native", F.col("native")).when(tier == "plumbed", F.col("plumbed")).when(tier == "ocr", F.col("ocr"))
    return rows.select("doc", "page", tier.alias("tier"), text.alias("text"))


def join_pages(pages: DataFrame) -> DataFrame:
    """doc, text of its pages in order that aren't blank, and whether any is blank (needs OCR)."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    parts = F.array_sort(F.collect_list(F.when(~blank, F.struct("page", "text"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.bool_or(blank).alias("needs_ocr"))


def table_row(cells: Column) -> Column:
    """A table row as text: trailing empty cells go; two cells make a labelled item, others are joined by bars."""
    last = F.aggregate(F.transform(cells, lambda c, i: F.when(F.trim(c) != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    kept = F.slice(cells, 1, last)
    return F.when(last == 2, F.concat(F.lit("- "), kept[0], F.lit(": "), kept[1])).otherwise(F.array_join(kept, " | "))


def markers(failed: DataFrame) -> DataFrame:
    """Status rows of failed conversions: an empty output that bears the source's time, so that it isn't stale."""
    return failed.select("path", F.concat("path", F.lit(".md")).alias("out_path"), F.col("mtime").alias("out_mtime"), F.lit(0).cast("bigint").alias("out_size"), F.lit("error").alias("state"))


def newest_first(files: DataFrame) -> Window:
    return Window.orderBy(F.col("mtime").desc(), F.col("path"))
