"""The corpus pipeline: quality, near-dedup, substring dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. Each works on the rows and whole texts
that the one before has kept.

Defined results, each following from those of the operators:
- Null and empty texts, and those of blank lines only, have no quality and go in the first stage.
- A null id is no obstacle: the row is neither grouped nor a source of passages, and its tokens are returned.
- Of rows of one id and text one stays, in the second stage; rows of one id with other texts are documents of their own.
- Texts of any length are worked on whole, in every stage.
- Ties: of near copies the first by (id, hash of the text) stays, of a passage its first place by (id, position); a
  quality that equals the threshold is kept; a document of which just half is a benchmark's goes.
- A text of which no word is left after the third stage goes; n_chars follows the text where there is such a column.
- Other columns pass through the first four stages whatever their names, and don't reach the result of the last.
- Empty documents give no rows; without labels, or with labels of one kind, every text is kept; without benchmark items nothing is cut.

What stages write to the shared folder is removed as soon as the next has been written; only the last result stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, decontaminate, minhash, quality_crf, substring_dedup
from quillstone.llm import kernel as K


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, fitted to the labelled ones, doesn't reject."""
    return quality_crf.keep(docs, quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur at an earlier place."""
    return _counted(substring_dedup.clean(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark."""
    return _counted(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the tokens of each text that is left."""
    return bpe.encode(docs)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("substring dedup", substring), ("benchmark decontamination", decontamination), ("BPE encoding", tokens)]
#: No stage but decontamination can be put as SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage being written to the shared folder and read again."""
    K.shared(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with K.released(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            K.remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
