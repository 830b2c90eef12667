"""Queries over what readers and models give: eligibility, reading order, prompts, replies and their fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import gibberish
from quillstone.functions import nested as N
from quillstone.functions import text as X
from quillstone.models import providers, rag, vectors
from quillstone.operators import files as O
from quillstone.plans.registry import Tables, query
from quillstone.sources import corpus

_NAME = """CASE o_orderkey % 6 WHEN 0 THEN '._' || o_orderkey || '.txt' WHEN 1 THEN o_orderkey || '.MD' WHEN 2 THEN o_orderkey || '.md.bak' WHEN 3 THEN o_orderkey || '.requirements.md'
    WHEN 4 THEN o_orderkey || '.md' ELSE 'requirements.md' END"""


def _named(t: Tables) -> DataFrame:
    k, n = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    name = (
        F.when(k == 0, F.concat(F.lit("._"), n, F.lit(".txt"))).when(k == 1, F.concat(n, F.lit(".MD"))).when(k == 2, F.concat(n, F.lit(".md.bak"))).when(k == 3, F.concat(n, F.lit(".requirements.md")))
        .when(k == 4, F.concat(n, F.lit(".md"))).otherwise("requirements.md")
    )
    return t.orders.select("o_orderkey", name.alias("path"))


@query(f"SELECT o_orderkey, {_NAME} AS path, o_orderkey % 6 IN (1, 3, 4, 5) AS eligible FROM orders")
def clean_eligibility(t: Tables) -> DataFrame:
    return _named(t).select("o_orderkey", "path", O.cleanable(F.col("path")).alias("eligible"))


@query(f"SELECT path FROM (SELECT {_NAME} AS path, o_orderkey FROM orders) WHERE o_orderkey % 6 = 4")
def requirement_sources(t: Tables) -> DataFrame:
    return rag.sources(_named(t).withColumnRenamed("path", "filename")).select(F.col("filename").alias("path"))


@query("SELECT p_partkey, p_size * 1048576 <= 26214400 AS taken FROM part")
def audio_limit(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", O.audio_fits(F.col("p_size") * 1048576).alias("taken"))


@query(
    """WITH spine AS (SELECT conv_id AS book, -turn AS position, 'item-' || turn AS idref FROM conversations), manifest AS (SELECT conv_id AS book, CASE WHEN turn % 3 = 2 THEN 'other-' ELSE 'item-' END || turn AS id, trim(text) AS text FROM conversations)
SELECT s.book, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text FROM spine s JOIN manifest m ON s.book = m.book AND s.idref = m.id WHERE text <> '' GROUP BY s.book"""
)
def spine_order(t: Tables) -> DataFrame:
    n = F.col("turn").cast("string")
    spine = t.conversations.select(F.col("conv_id").alias("book"), (-F.col("turn")).alias("position"), F.concat(F.lit("item-"), n).alias("idref"))
    named = F.concat(F.when(F.col("turn") % 3 == 2, "other-").otherwise("item-"), n)  # some items that the spine names aren't in the manifest
    manifest = t.conversations.select(F.col("conv_id").alias("book"), named.alias("id"), F.trim("text").alias("text"))
    return corpus.spine_text(spine, manifest)


@query("SELECT conv_id, turn, 'Role ' || role || ' said {' || text || '}; ' || role || '.' AS prompt FROM conversations")
def prompts(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", rag.fill("Role {role} said {{text}}; {role}.", role=F.col("role"), text=F.col("text")).alias("prompt"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'fixed ' || turn ELSE md5(text) END AS text FROM conversations")
def repair_fallback(t: Tables) -> DataFrame:
    k = F.col("turn") % 3
    reply = F.when(k == 0, F.concat(F.lit("fixed "), F.col("turn").cast("string"))).when(k == 1, "  ")
    return t.conversations.select("conv_id", "turn", providers.repaired_or_own(reply, F.md5("text")).alias("text"))


@query(r"SELECT p_partkey, regexp_matches(p_name, '\b' || 'a') AS starts, regexp_matches(p_name, 'e' || '\b') AS ends, contains(p_name, 'ar') AS holds FROM part")
def word_patterns(t: Tables) -> DataFrame:
    hit = lambda pattern: F.col("p_name").rlike(X.pattern_regex(pattern))
    return t.part.select("p_partkey", hit("a*").alias("starts"), hit("*e").alias("ends"), hit("*ar*").alias("holds"))


@query("SELECT event_id, event_type AS kind, user_id::varchar AS person, 2::bigint AS keys FROM events")
def lower_keys(t: Tables) -> DataFrame:
    low = N.lower_keys(F.create_map(F.lit("Kind"), F.col("event_type"), F.lit("PERSON"), F.col("user_id").cast("string")))
    return t.events.select("event_id", low).toDF("event_id", "m").select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["person"].alias("person"), F.size("m").cast("bigint").alias("keys"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'SELECT ' || turn ELSE 'no fence ' || turn END AS sql FROM conversations")
def fenced_reply(t: Tables) -> DataFrame:
    n = F.col("turn").cast("string")
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Sure:\n```sql\nSELECT "), n, F.lit("\n```\nand more ```x```"))).otherwise(F.concat(F.lit("no fence "), n))
    return t.conversations.select("conv_id", "turn", X.fenced(reply, "sql").alias("sql"))


_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> ''))"
_PAIR = f"""SELECT conv_id, turn, {_SET.format("text")} AS a, {_SET.format("before")} AS b, before FROM (
    SELECT conv_id, turn, text, lag(role || ' ' || text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""


@query(f"SELECT conv_id, turn, CASE WHEN before IS NOT NULL THEN round(len(list_intersect(a, b)) / len(a)::double, 6) END AS score FROM ({_PAIR}) WHERE len(a) > 0")
def pair_scores(t: Tables) -> DataFrame:
    """Each whole text against role and whole text of the turn before; null where there is none."""
    before = F.lag(F.concat("role", F.lit(" "), "text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.withColumn("before", before).where(F.trim("text") != "")
    return rows.select("conv_id", "turn", F.round(vectors.pair_score(F.col("text"), F.col("before"), lambda: vectors.overlap), 6).alias("score"))


@query("SELECT c_custkey, '| ' || c_custkey || ' | ' || c_name || ' | ' || replace(c_mktsegment, '|', '\\|') || ' |' AS line FROM customer")
def markdown_rows(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", O.markdown_row(["c_custkey", "c_name", "c_mktsegment"]).alias("line"))


@query()
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", gibberish.clean_text(F.col("text")).alias("text"))


@query("SELECT item_id AS id, text AS answer, NULL::varchar AS error FROM benchmark")
def stub_answers(t: Tables) -> DataFrame:
    return providers.ask(t.benchmark, {"class": "echo"}, F.col("text"), id_col="item_id")
