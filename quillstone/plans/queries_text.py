"""Text, scalar and JSON queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import nested as N
from quillstone.functions import scalars as S
from quillstone.functions import text as X
from quillstone.operators import dedup
from quillstone.plans.registry import Tables, query

NORM = r"trim(lower(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g')))"
ELIGIBLE = f"SELECT *, {NORM} AS norm FROM documents WHERE {NORM} <> '' AND len(string_split({NORM}, ' ')) >= 20"


@query(f"SELECT doc_id, md5({NORM}) AS digest, CASE WHEN {NORM} = '' THEN 0 ELSE len(string_split({NORM}, ' ')) END AS words FROM documents")
def normalize(t: Tables) -> DataFrame:
    norm = X.normalize(F.col("text"))
    return t.documents.select("doc_id", F.md5(norm).alias("digest"), X.word_count(norm).alias("words"))


@query(f"SELECT doc_id, lang FROM ({ELIGIBLE})")
def min_words(t: Tables) -> DataFrame:
    return dedup.eligible(t.documents).select("doc_id", "lang")


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM ({ELIGIBLE}) GROUP BY norm")
def dedup_normalized(t: Tables) -> DataFrame:
    return dedup.first_seen(t.documents)


@query(f"WITH k AS (SELECT min(doc_id) AS doc_id, count(*) AS copies FROM ({ELIGIBLE}) GROUP BY norm) SELECT lang, count(*) AS docs, sum(copies)::bigint AS seen FROM k JOIN documents USING (doc_id) GROUP BY lang")
def dedup_by_lang(t: Tables) -> DataFrame:
    return dedup.first_seen(t.documents, carry=("lang",)).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("seen"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\s\p{Z}\x{85}]+', ' ', 'g')) AS digest FROM documents")
def ws_collapse(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.collapse_whitespace(F.col("text"))).alias("digest"))


_STRIPPED = r"list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"


@query(f"SELECT doc_id, md5(array_to_string({_STRIPPED}, chr(10))) AS stripped, md5(array_to_string({_STRIPPED}, '')) AS flat FROM documents")
def strip_lines(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", F.md5(X.strip_lines(text)).alias("stripped"), F.md5(X.flatten_lines(text)).alias("flat"))


_GUARD = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 12), chr(10))"


@query(f"SELECT doc_id, md5({_GUARD}) AS digest FROM documents")
def line_guard(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.line_guard(F.col("text"))).alias("digest"))


@query(
    f"""WITH c AS (SELECT text, {_GUARD} AS clean FROM documents)
SELECT count(*) FILTER (clean <> text) AS changed, count(*) FILTER (clean = text) AS unchanged,
    sum((length(text) - length(replace(text, chr(10), ''))) - (length(clean) - length(replace(clean, chr(10), ''))))::bigint AS lines_dropped FROM c"""
)
def clean_report(t: Tables) -> DataFrame:
    rows = t.documents.select("text", X.line_guard(F.col("text")).alias("clean"))
    breaks = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    return rows.agg(F.count_if(F.col("clean") != F.col("text")).alias("changed"), F.count_if(F.col("clean") == F.col("text")).alias("unchanged"), F.sum((breaks("text") - breaks("clean")).cast("bigint")).alias("lines_dropped"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def md5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5("text").alias("digest"))


@query(
    r"""WITH r AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[\x20-\x7E]{4,}'), lambda x: trim(x)), lambda x: length(x) > 3) AS runs FROM documents)
SELECT doc_id, len(runs) AS runs, md5(array_to_string(runs, '|')) AS digest FROM r"""
)
def ascii_runs(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", X.ascii_runs(F.col("text")).alias("r"))
    return rows.select("doc_id", F.size("r").cast("bigint").alias("runs"), F.md5(F.array_join("r", "|")).alias("digest"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 9) * 86400 + (o_orderkey % 5) * 3600 WHEN 1 THEN (o_orderkey % 9 + 0.5) * 2629746
    WHEN 2 THEN (o_orderkey % 5) * 60 ELSE (o_orderkey % 9) END::double AS seconds FROM orders"""
)
def to_seconds(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    a, b = (k % 9).cast("string"), (k % 5).cast("string")
    text = F.when(k % 4 == 0, F.concat(a, F.lit("d"), b, F.lit("h"))).when(k % 4 == 1, F.concat(a, F.lit(".5mo"))).when(k % 4 == 2, F.concat(a, F.lit("h "), b, F.lit("m"))).otherwise(a)
    return t.orders.select("o_orderkey", S.to_seconds(text).alias("seconds"))


@query("SELECT p_partkey, (p_size * CASE p_partkey % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 ELSE 1 END::bigint)::bigint AS n FROM part")
def from_metric(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    unit = F.when(k == 0, "K").when(k == 1, "M").when(k == 2, "G").otherwise("")
    return t.part.select("p_partkey", S.from_metric(F.concat(F.col("p_size").cast("string"), unit)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderdate::date END AS day FROM orders")
def to_date(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate").cast("timestamp")
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 3, F.date_format(d, "M/d/yyyy")).when(k == 4, F.concat(F.lit("/Date("), F.unix_seconds(d).cast("string"), F.lit(")/"))).otherwise("no date")
    )
    return t.orders.select("o_orderkey", S.to_date(text).alias("day"))


def _stamps(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp") + F.make_interval(secs=F.col("o_orderkey") % 86400)
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 1, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-04:00")))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise("13:00")
    )
    return t.orders.select("o_orderkey", text.alias("text"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate + to_seconds(o_orderkey % 86400) WHEN 1 THEN o_orderdate + to_seconds(o_orderkey % 86400) + INTERVAL 4 HOUR
    WHEN 2 THEN date_trunc('day', o_orderdate + to_seconds(o_orderkey % 86400)) END::timestamp AS at FROM orders"""
)
def to_datetime(t: Tables) -> DataFrame:
    return _stamps(t).select("o_orderkey", S.to_datetime(F.col("text")).cast("timestamp_ntz").alias("at"))


@query(
    """SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN o_orderdate + to_seconds(o_orderkey % 86400) WHEN 1 THEN o_orderdate + to_seconds(o_orderkey % 86400) + INTERVAL 4 HOUR
    WHEN 2 THEN date_trunc('day', o_orderdate + to_seconds(o_orderkey % 86400)) END, '%xT%XZ') AS utc FROM orders"""
)
def to_datetime_utc(t: Tables) -> DataFrame:
    return _stamps(t).select("o_orderkey", F.date_format(S.to_datetime(F.col("text")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey ELSE 0 END::bigint AS i, CASE c_custkey % 5 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + 0.5 ELSE 0 END::double AS f,
    c_custkey % 5 = 0 AS is_i, c_custkey % 5 IN (0, 1, 4) AS is_f, CASE c_custkey % 5 WHEN 0 THEN c_custkey::varchar WHEN 1 THEN c_custkey || '.5' WHEN 2 THEN '' WHEN 3 THEN 'x' || c_custkey ELSE 'NaN' END AS s FROM customer"""
)
def to_int_float(t: Tables) -> DataFrame:
    k, n = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    s = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".5"))).when(k == 3, F.concat(F.lit("x"), n)).when(k == 4, "NaN")
    return t.customer.select("c_custkey", S.to_int(s).alias("i"), S.to_float(s).alias("f"), S.is_int(s).alias("is_i"), S.is_float(s).alias("is_f"), S.to_string(s).alias("s"))


@query("SELECT page_id, regexp_replace(translate(url, '<>:\"?*|', '_______'), '_+', '_', 'g') AS name FROM pages")
def clean_filename(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.clean_filename(F.col("url")).alias("name"))


_PATH = "CASE o_orderkey % 3 WHEN 0 THEN '/in/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderkey || '.pdf' WHEN 1 THEN '/in/x_' || strftime(o_orderdate, '%Y-%m-%d') || '_' || o_orderkey ELSE '/in/' || o_orderkey || '.md' END"


def _paths(t: Tables) -> DataFrame:
    k, day, n = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/in/"), day, F.lit("/"), n, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("/in/x_"), day, F.lit("_"), n)).otherwise(F.concat(F.lit("/in/"), n, F.lit(".md")))
    return t.orders.select("o_orderkey", path.alias("path"), (F.col("o_orderdate") + F.make_interval(days=F.lit(3))).alias("modified"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, {_PATH} AS path FROM orders")
def extract_date(t: Tables) -> DataFrame:
    return _paths(t).select("o_orderkey", X.date_in_path(F.col("path")).alias("day"), "path")


@query("SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 3 DAY END, '%Y-%m-%d') AS day FROM orders")
def file_date(t: Tables) -> DataFrame:
    return _paths(t).select("o_orderkey", X.file_date(F.col("path"), F.col("modified")).alias("day"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, json_extract_string(props, '$.k') AS any_case FROM events")
def json_get(t: Tables) -> DataFrame:
    props = F.col("props")
    return t.events.select("event_id", N.get(props, "k").alias("k"), N.get(props, "missing", "none").alias("missing"), N.get_ignoring_case(props, "K").alias("any_case"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('second', ts) END::timestamp AS at FROM events")
def fix_json_date(t: Tables) -> DataFrame:
    at, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("/Date("), F.unix_millis(at).cast("string"), F.lit(")/"))).when(k == 1, F.concat(F.lit("/Date("), F.unix_seconds(at).cast("string"), F.lit(")/"))).otherwise("plain")
    return t.events.select("event_id", N.json_date(text).cast("timestamp_ntz").alias("at"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe ' || lower(source) ELSE 'no' END AS verdict FROM documents")
def yes_no(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, F.concat(F.lit("Yes\nas "), "lang")).when(k == 1, " no ").when(k == 2, F.concat(F.lit("Maybe "), "source")).otherwise("NO\n")
    return t.documents.select("doc_id", X.yes_no(answer).alias("verdict"))


@query("SELECT doc_id, (length(text) // 4)::bigint AS tokens, CASE WHEN length(text) // 4 + 2048 > 4096 THEN greatest(1024, 4096 - length(text) // 4 - 500) ELSE 2048 END::bigint AS budget FROM documents")
def token_budget(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", X.token_estimate(text).alias("tokens"), X.output_budget(text, 4096, 2048).alias("budget"))


@query(r"""SELECT conv_id, turn, regexp_replace(' SELECT ' || role || ' FROM t WHERE a = ''' || role || ''' AND b = 1 GROUP BY c ', ' (FROM|WHERE|AND|GROUP BY) ', chr(10) || '\1 ', 'g') AS sql, '{"role": "' || role || '"}' AS json FROM conversations""")
def pretty_sql(t: Tables) -> DataFrame:
    role = F.col("role")
    sql = F.concat(F.lit(" SELECT "), role, F.lit(" FROM t WHERE a = '"), role, F.lit("' AND b = 1 GROUP BY c "))
    answer = F.concat(F.lit('Here:\n```json\n{"role":\n"'), role, F.lit('"}\n```\nDone.'))
    return t.conversations.select("conv_id", "turn", X.pretty_sql(sql).alias("sql"), X.clean_json(answer).alias("json"))


_BARE = r"regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
_TEXT = rf"regexp_replace({_BARE}, '<[^>]*>', ' ', 'g')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_name}', '{_char}')"


@query(rf"SELECT page_id, trim(regexp_replace({_TEXT}, '[\s\p{{Z}}]+', ' ', 'g')) AS text FROM pages")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.html_text(F.col("html")).alias("text"))


_BLOCK = "(?s)<style" + "[^>]*>.*?" + "</style>"


@query(f"SELECT page_id, md5(regexp_replace(html, '{_BLOCK}', '', 'g')) AS bare, md5(replace(regexp_replace(html, '{_BLOCK}', '', 'g'), '</head>', '<style>p{{margin:1em}}</style></head>')) AS printable FROM pages")
def style_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.style_strip(F.col("html"))).alias("bare"), F.md5(X.printable_html(F.col("html"), "p{margin:1em}")).alias("printable"))
