"""Commands over folders: clean, convert, fix-names, requirements. Every one prints what it did, and --dry-run only that."""

from __future__ import annotations

import argparse
import json
import os
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillstone.functions import gibberish
from quillstone.functions import text as X
from quillstone.models import rag
from quillstone.operators import files as O
from quillstone.sources import corpus as C
from quillstone.sources import sinks

def _everything(spark: SparkSession, folder: str):
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def _filtered(rows, patterns: list[str], skip: list[str]):
    name = O.file_name(F.col("path"))
    rows = rows.where(X.matches_patterns(name, patterns)) if patterns else rows
    return rows.where(~X.matches_patterns(name, skip)) if skip else rows


def clean(spark: SparkSession, folder: str, *, patterns: list[str] = (), skip: list[str] = (), keep_noise: bool = False, dry_run: bool = False) -> dict:
    """Repairs the text files of a folder in place; changed, unchanged and lines dropped."""
    rows = _filtered(_everything(spark, folder), list(patterns), list(skip)).where(O.cleanable(F.col("path")))
    both = rows.select("path", C.decode_best_effort(F.col("content")).alias("old")).withColumn("new", gibberish.clean_text(F.col("old"), drop_noise=not keep_noise)).cache()
    breaks = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    changed = F.col("old") != F.col("new")
    report = both.agg(F.count_if(changed).alias("changed"), F.count_if(~changed).alias("unchanged"), F.coalesce(F.sum(breaks("old") - breaks("new")), F.lit(0)).alias("lines_dropped")).first().asDict()
    report["errors"] = 0
    if not dry_run:
        report["errors"] = sinks.write_files(both.where(changed), path="path", text="new").where("state = 'error'").count()
    both.unpersist()
    return report


def convert(spark: SparkSession, folder: str, *, patterns: list[str] = (), skip: list[str] = (), force: bool = False, retry_errors: bool = False, dry_run: bool = False, readers=None) -> dict:
    """Writes name.md beside every file whose output is missing or older; a file that can't be read leaves an empty one."""
    rows = C.listing(spark, folder).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    rows = _filtered(rows, list(patterns), list(skip))
    out = rows.select(F.col("path").alias("out_path"), F.col("modificationTime").alias("out_mtime"), F.col("length").alias("out_size"))
    source = rows.where(~F.endswith("path", F.lit(".md"))).withColumn("out_path", F.concat("path", F.lit(".md")))
    planned = O.plan(source.join(out, "out_path", "left").withColumnsRenamed({"modificationTime": "mtime", "length": "size"}).withColumn("needs_ocr", F.lit(False)), force=force, retry_errors=retry_errors)
    report = O.summary(planned).first().asDict()
    todo = planned.where(F.col("action").isin("convert", "reconvert", "retry"))
    if not dry_run:
        texts = C.texts(_everything(spark, folder).join(todo.select("path"), "path", "left_semi"), readers)
        states = sinks.write_files(texts.select(F.concat("path", F.lit(".md")).alias("out_path"), F.coalesce("text", F.lit("")).alias("text")))
        report["failed"] = states.where("state = 'error'").count()
    return report


def fix_names(spark: SparkSession, folder: str, *, dry_run: bool = False) -> dict:
    """Renames or deletes .md files whose names lack the extension of what they were made of."""
    rows = C.listing(spark, folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    rows = O.fix_names(rows).where("action <> 'leave'").collect()
    for r in rows if not dry_run else ():
        os.remove(r.path) if r.action == "delete" else os.rename(r.path, r.target)
    return {a: sum(r.action == a for r in rows) for a in ("rename", "delete")}


def requirements(spark: SparkSession, folder: str, settings: dict, *, force: bool = False, prompt: str = "") -> dict:
    """Writes name.requirements.md for each .md file, and requirements.md for all of them."""
    rows = _everything(spark, folder).where(F.endswith("path", F.lit(".md"))).select(F.col("path").alias("filename"), C.decode_best_effort(F.col("content")).alias("text"))
    result = F.regexp_replace("filename", r"\.md$", ".requirements.md")
    have = rows.where(F.endswith("filename", F.lit(".requirements.md")))
    done = None if force else have.select(F.regexp_replace("filename", r"\.requirements\.md$", ".md").alias("filename"), F.col("text").alias("requirements"))
    made, whole = rag.requirements(rows, settings, done, prompt)
    n = sinks.write_files(made.withColumn("out_path", result), text="requirements").where("state = 'written'").count()
    Path(folder, "requirements.md").write_text(whole, "utf-8")
    return {"sources": n, "written": os.path.join(folder, "requirements.md")}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillstone", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("clean", "convert", "fix-names", "requirements"):
        c = commands.add_parser(name)
        c.add_argument("folder")
        if name != "requirements":
            c.add_argument("--dry-run", action="store_true")
        if name in ("clean", "convert"):
            c.add_argument("--only", action="append", default=[], help="name pattern; may be repeated")
            c.add_argument("--skip", action="append", default=[], help="name pattern; may be repeated")
        if name == "clean":
            c.add_argument("--keep-noise", action="store_true", help="only repair the encoding")
        if name in ("convert", "requirements"):
            c.add_argument("--force", action="store_true")
        if name == "convert":
            c.add_argument("--retry-errors", action="store_true")
        if name == "requirements":
            c.add_argument("--model", required=True, help="settings of the provider as JSON, with its class")
            c.add_argument("--prompt", default="")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "clean":
        out = clean(spark, a.folder, patterns=a.only, skip=a.skip, keep_noise=a.keep_noise, dry_run=a.dry_run)
    elif a.command == "convert":
        out = convert(spark, a.folder, patterns=a.only, skip=a.skip, force=a.force, retry_errors=a.retry_errors, dry_run=a.dry_run)
    elif a.command == "fix-names":
        out = fix_names(spark, a.folder, dry_run=a.dry_run)
    else:
        out = requirements(spark, a.folder, json.loads(a.model), force=a.force, prompt=a.prompt)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
