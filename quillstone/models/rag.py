"""Questions answered from a corpus, requirements drawn from documents, and SQL written for a question."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import text as X
from quillstone.models import providers
from quillstone.models.store import Store
from quillstone.operators import retrieve
from quillstone.plans import sql

ANSWER = "Answer the question from the context alone. Say so if the context doesn't hold the answer.\n\nContext:\n{context}\n\nQuestion: {query}\n"
EXTRACT = "List the requirements that the document states, one a line.\n\nDocument {filename}:\n{content}\n\n{extra}"
CONSOLIDATE = "Merge these lists of requirements into one, without repeats and with conflicts named.\n\n{combined}\n\n{extra}"
WRITE_SQL = 'Write one SELECT statement for the question, as JSON {"sql": "...", "error": "...", "question": "..."}.\n\nTables:\n{schema}\n\nQuestion: {question}\n'


def fill(template: str, **values: Column) -> Column:
    """A template with its {names} replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


class Rag:
    """A store and a provider: what is loaded, found and answered."""

    def __init__(self, store: Store, settings: dict[str, Any], make_scorer=None):
        self.store, self.settings, self.make_scorer = store, settings, make_scorer

    def sync(self, docs: DataFrame) -> tuple[int, int]:
        """(files, chunks) added: docs that the store lacks, or that have changed."""
        return self.store.load(docs)

    def find(self, queries: DataFrame, n: int = 20, cut: int = 5) -> DataFrame:
        """The best chunks of each query, every text once, ranked anew from 1 on."""
        w = Window.partitionBy("query_id").orderBy("rank")
        found = retrieve.without_repeats(self.store.search(queries, n)).withColumn("_rank", F.row_number().over(w).cast("bigint"))
        return found.where(F.col("_rank") <= cut).withColumn("rank", F.col("_rank")).drop("_rank")

    def query(self, queries: DataFrame, *, max_tokens: int | None = None) -> DataFrame:
        """query_id, context, answer, error."""
        n = max(1, retrieve.results_for(providers.from_config(self.settings).num_tokens()))
        found = self.store.retrieve(queries, n=max(n, 12), make_scorer=self.make_scorer).join(queries.select("query_id", "query"), "query_id")
        answers = providers.ask(found, self.settings, fill(ANSWER, context=F.col("context"), query=F.col("query")), id_col="query_id", max_tokens=max_tokens)
        return found.select("query_id", "context").join(answers.withColumnRenamed("id", "query_id"), "query_id")


def yes_or_no(df: DataFrame, settings: dict[str, Any], prompt: Column, *, id_col: str = "doc_id") -> DataFrame:
    """id, verdict: yes, no, or the whole answer in lower case."""
    return providers.ask(df, settings, prompt, id_col=id_col).select("id", X.yes_no(F.col("answer")).alias("verdict"))


def sources(docs: DataFrame) -> DataFrame:
    """The .md files but for those that are results themselves."""
    return docs.where(F.endswith("filename", F.lit(".md")) & ~F.endswith("filename", F.lit(".requirements.md")) & ~F.col("filename").rlike(r"(^|/)requirements\.md$"))


def requirements(docs: DataFrame, settings: dict[str, Any], done: DataFrame | None = None, extra: str = "") -> tuple[DataFrame, str]:
    """(filename, requirements of every source, the consolidated list). docs: filename, text; done: those extracted before.

    What failed is left out of the list.
    """
    source = sources(docs)
    todo = source.join(done.select("filename"), "filename", "left_anti") if done is not None else source
    made = providers.ask(todo, settings, fill(EXTRACT, filename=F.col("filename"), content=F.col("text"), extra=F.lit(extra)), id_col="filename", max_tokens=8192)
    rows = made.where("answer is not null").select(F.col("id").alias("filename"), F.col("answer").alias("requirements"))
    rows = (rows.unionByName(done.select("filename", "requirements")) if done is not None else rows).cache()
    part = F.concat(F.lit("### "), F.col("filename"), F.lit("\n\n"), F.col("requirements"))
    parts = F.array_sort(F.collect_list(F.struct("filename", part.alias("p"))))
    combined = rows.agg(F.array_join(F.transform(parts, lambda p: p["p"]), "\n\n---\n\n")).first()[0]
    if not combined:
        raise ValueError("no source gave any requirements")
    return rows, providers.from_config(settings).query(CONSOLIDATE.replace("{combined}", combined).replace("{extra}", extra), 16384)


def with_repair(pages: DataFrame, settings: dict[str, Any], instruction: str) -> DataFrame:
    """pages (page, text) with text repaired by a model, or as it was where that gave nothing."""
    answers = providers.ask(pages, settings, F.concat(F.lit(instruction + "\n\n"), "text"), id_col="page")
    return pages.join(answers.select(F.col("id").alias("page"), "answer"), "page", "left").withColumn("text", providers.repaired_or_own(F.col("answer"), F.col("text"))).drop("answer")


class Warehouse:
    """Questions in words answered by SQL over registered tables; only statements that read are run."""

    def __init__(self, spark: SparkSession, provider: providers.Base, tables: dict[str, DataFrame]):
        self.spark, self.provider, self.tables = spark, provider, tables

    def schema(self) -> str:
        return "\n".join(f"{n}({', '.join(f'{c} {k}' for c, k in df.dtypes)})" for n, df in sorted(self.tables.items()))

    def written(self, question: str, error: str | None = None) -> dict[str, Any]:
        """What the provider replies: sql, error or a question of its own."""
        prompt = WRITE_SQL.replace("{schema}", self.schema()).replace("{question}", question)
        reply = self.provider.query(prompt if error is None else f"{prompt}\nThe last attempt failed: {error}", 2048)
        return json.loads(reply[reply.index("{") : reply.rindex("}") + 1])

    def rows(self, question: str) -> DataFrame:
        """The whole result of the statement written for a question; ValueError if there is none or it is refused."""
        found = self.written(question)
        if found.get("error") or not found.get("sql"):
            raise ValueError(found.get("error") or found.get("question") or "no statement")
        return sql.query(self.spark, found["sql"], tables=self.tables)

    def query(self, question: str, tries: int = 5) -> dict[str, Any]:
        """question, sql, table (markdown of its first rows), answer or error; a statement that fails is asked for again."""
        error = None
        for _ in range(tries):
            try:
                found = self.written(question, error)
                if found.get("error") or not found.get("sql"):
                    return {"question": question, "sql": None, "table": None, "answer": None, "error": found.get("error") or found.get("question") or "no statement"}
                table = sql.markdown(sql.query(self.spark, found["sql"], tables=self.tables))
            except Exception as e:  # whatever is wrong with a written statement goes back to its writer
                error = f"{type(e).__name__}: {str(e)[:500]}"
                continue
            return {"question": question, "sql": found["sql"], "table": table, "answer": self.provider.query(f"Explain this result for the question {question!r}:\n\n{table}", 2048), "error": None}
        return {"question": question, "sql": None, "table": None, "answer": None, "error": error or "no answer"}
