"""File and chunk queries. Paths, times and outputs are derived from keys, alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import chunks, dedup, files
from quillstone.plans.registry import Tables, query

_FILES = """SELECT source || '/' || doc_id || '.' || lang AS path, lang AS ext, octet_length(encode(text))::bigint AS size, encode(text) AS content,
    CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE n_chars END::bigint AS out_size FROM documents"""


def _files(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    return t.documents.select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.col("lang").alias("ext"), F.octet_length("text").cast("bigint").alias("size"),
        F.encode("text", "UTF-8").alias("content"), F.when(k == 0, 0).when(k == 1, None).otherwise(F.col("n_chars")).cast("bigint").alias("out_size"),
    )


@query(f"WITH f AS ({_FILES}), c AS (SELECT *, count(*) OVER (PARTITION BY size, ext) AS n FROM f WHERE size > 0) SELECT path, size, ext, sha256(array_slice(content, 1, 65536)) AS head FROM c WHERE n > 1")
def dedupe_index(t: Tables) -> DataFrame:
    return dedup.file_keys(_files(t)).select("path", "size", "ext", "head")


@query(f"WITH f AS ({_FILES}) SELECT a.path, min(b.path) AS donor FROM f a JOIN f b ON a.size = b.size AND a.ext = b.ext AND a.content = b.content AND a.path <> b.path AND b.out_size > 0 WHERE a.size > 0 GROUP BY a.path")
def duplicate_donor(t: Tables) -> DataFrame:
    return dedup.donors(_files(t))


@query("SELECT o_orderkey, o_orderkey % 4 IN (0, 2) AS stale FROM orders")
def needs_conversion(t: Tables) -> DataFrame:
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate")
    day = F.make_interval(days=F.lit(1))
    target = F.when(k == 1, at).when(k == 2, at - day).when(k == 3, at + day)
    return t.orders.select("o_orderkey", files.needs_conversion(at, target).alias("stale"))


_PLAN = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '._' ELSE '' END || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' ELSE '.zzz' END AS path,
    CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 10 END AS size, o_orderkey % 4 AS k, o_orderkey % 7 = 0 AS needs_ocr, o_orderkey FROM orders"""
_ACTION = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 3 = 2 THEN 'ignored' WHEN size = 0 THEN 'empty'
    WHEN NOT (k IN (0, 2) OR k = 3 OR (o_orderkey % 3 = 0 AND needs_ocr)) THEN 'fresh' WHEN k = 3 THEN 'retry' WHEN k = 0 THEN 'convert' ELSE 'reconvert' END AS action FROM ({_PLAN})"""


def _plan(t: Tables) -> DataFrame:
    key, at, day = F.col("o_orderkey"), F.col("o_orderdate"), F.make_interval(days=F.lit(1))
    n, k = key.cast("string"), key % 4
    path = F.concat(F.when(key % 11 == 0, "._").otherwise(""), n, F.when(key % 3 == 0, ".pdf").when(key % 3 == 1, ".DOCX").otherwise(".zzz"))
    rows = t.orders.select(
        "o_orderkey", path.alias("path"), F.when(key % 13 == 0, 0).otherwise(10).alias("size"), at.alias("mtime"), F.when(k == 1, at).when(k == 2, at - day).when(k == 3, at + day).alias("out_mtime"),
        F.when(k == 0, None).when(k == 3, 0).otherwise(5).alias("out_size"), (key % 7 == 0).alias("needs_ocr"),
    )
    return files.plan(rows, retry_errors=True, redo_ocr=True)


@query(_ACTION)
def convert_eligibility(t: Tables) -> DataFrame:
    return _plan(t).select("o_orderkey", "action")


@query(f"SELECT {', '.join(f'''count(*) FILTER (action = '{a}') AS {a}''' for a in ('convert', 'reconvert', 'retry', 'fresh', 'empty', 'ignored'))}, count(*) AS files FROM ({_ACTION})")
def convert_summary(t: Tables) -> DataFrame:
    return files.summary(_plan(t))


_NAMES = """SELECT unnest([CASE WHEN o_orderkey % 2 = 0 THEN 'd/F' ELSE 'd/f' END || o_orderkey || '.md', CASE WHEN o_orderkey % 3 > 0 THEN 'd/f' || o_orderkey || '.pdf' END,
    CASE WHEN o_orderkey % 3 > 1 THEN 'd/f' || o_orderkey || '.docx' END, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 > 0 THEN 'd/f' || o_orderkey || '.pdf.md' END]) AS path FROM orders"""


@query(
    f"""WITH n AS (SELECT path, lower(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '')) AS low FROM ({_NAMES}) WHERE path IS NOT NULL),
c AS (SELECT m.path, count(s.path) AS n, min(s.path) || '.md' AS to_path FROM n m LEFT JOIN n s ON s.low = m.low AND s.path <> m.path WHERE m.path LIKE '%.md' GROUP BY m.path)
SELECT c.path, n, CASE WHEN n = 0 THEN 'leave' WHEN n > 1 THEN 'delete' WHEN t.path IS NOT NULL THEN 'leave' ELSE 'rename' END AS action,
    CASE WHEN n = 1 AND t.path IS NULL THEN to_path END AS target FROM c LEFT JOIN n t ON n = 1 AND t.path = to_path"""
)
def fix_names(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    n = F.concat(F.lit("f"), key.cast("string"))
    paths = F.array(
        F.concat(F.lit("d/"), F.when(key % 2 == 0, F.concat(F.lit("F"), key.cast("string"))).otherwise(n), F.lit(".md")), F.when(key % 3 > 0, F.concat(F.lit("d/"), n, F.lit(".pdf"))),
        F.when(key % 3 > 1, F.concat(F.lit("d/"), n, F.lit(".docx"))), F.when((key % 5 == 0) & (key % 3 > 0), F.concat(F.lit("d/"), n, F.lit(".pdf.md"))),
    )
    return files.fix_names(t.orders.select(F.explode(F.array_compact(paths)).alias("path")))


@query("SELECT page_id, lower(url) LIKE '%.html' OR regexp_matches(lower(url), '^http:.*[?]page=[0-9]') AS hit FROM pages")
def pattern_filter(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.matches_patterns(F.col("url"), [".HTML", "http:*[?]page=[0-9]*"]).alias("hit"))


_EXTS = ["pdf", "DOCX", "rtf", "rdf", "epub", "xlsx", "xls", "pptx", "png", "mp3", "txt", "tar.gz"]


@query(f"SELECT o_orderkey, CASE WHEN k IN (8) THEN 'image' WHEN k = 9 THEN 'audio' WHEN k > 9 THEN 'text' ELSE lower({_EXTS}[k + 1]) END AS reader, CASE WHEN k = 11 THEN 'gz' ELSE lower({_EXTS}[k + 1]) END AS ext FROM (SELECT o_orderkey, o_orderkey % 12 AS k FROM orders)")
def route_extension(t: Tables) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("o_orderkey") % 12 + 1).cast("int"))
    path = F.concat(F.lit("a.b/"), F.col("o_orderkey").cast("string"), F.lit("."), ext)
    return t.orders.select("o_orderkey", files.route(path).alias("reader"), files.extension(path).alias("ext"))


_PAGES = """SELECT conv_id AS doc, turn AS page, CASE WHEN conv_id % 3 = 0 THEN '' WHEN turn % 2 = 0 THEN text ELSE ' ' END AS native,
    CASE WHEN turn % 3 < 2 THEN 'p' || turn END AS plumbed, CASE WHEN turn % 5 < 4 THEN 'o' || turn END AS ocr FROM conversations"""
_TIERS = f"""WITH p AS ({_PAGES}), s AS (SELECT *, bool_and(trim(native) = '') OVER (PARTITION BY doc) AS second FROM p),
t AS (SELECT *, CASE WHEN trim(native) <> '' THEN 'native' WHEN second AND plumbed IS NOT NULL THEN 'plumbed' WHEN ocr IS NOT NULL THEN 'ocr' ELSE 'none' END AS tier FROM s)
SELECT doc, page, tier, CASE tier WHEN 'native' THEN native WHEN 'plumbed' THEN plumbed WHEN 'ocr' THEN ocr END AS text FROM t"""


def _tiers(t: Tables) -> DataFrame:
    doc, page = F.col("conv_id"), F.col("turn")
    n = page.cast("string")
    pages = t.conversations.select(
        doc.alias("doc"), page.alias("page"), F.when(doc % 3 == 0, "").when(page % 2 == 0, F.col("text")).otherwise(" ").alias("native"),
        F.when(page % 3 < 2, F.concat(F.lit("p"), n)).alias("plumbed"), F.when(page % 5 < 4, F.concat(F.lit("o"), n)).alias("ocr"),
    )
    return files.pdf_tiers(pages)


@query(_TIERS)
def pdf_tier(t: Tables) -> DataFrame:
    return _tiers(t)


@query(f"SELECT doc, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page, text) FILTER (trim(text) <> ''), '') AS text, bool_or(coalesce(trim(text), '') = '') AS needs_ocr FROM ({_TIERS}) GROUP BY doc")
def join_pages(t: Tables) -> DataFrame:
    return files.join_pages(_tiers(t))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '- ' || c_name || ': ' || c_mktsegment WHEN 1 THEN c_name || ' | ' || c_mktsegment || ' | ' || c_nationkey
    WHEN 2 THEN c_name ELSE c_name || ' |  | ' || c_mktsegment END AS line FROM customer"""
)
def table_row(t: Tables) -> DataFrame:
    k, name, seg, none = F.col("c_custkey") % 4, F.col("c_name"), F.col("c_mktsegment"), F.lit("")
    cells = F.when(k == 0, F.array(name, seg, none)).when(k == 1, F.array(name, seg, F.col("c_nationkey").cast("string"))).when(k == 2, F.array(name, none, F.lit(" "))).otherwise(F.array(name, none, seg))
    return t.customer.select("c_custkey", files.table_row(cells).alias("line"))


@query("SELECT doc_id, doc_id % 2 = 0 AND text IS NOT NULL AS sidecar FROM documents")
def sidecars(t: Tables) -> DataFrame:
    name = F.when(F.col("doc_id") % 2 == 0, "._x.doc").otherwise("x.doc")
    content = F.concat(F.unhex(F.lit("00051607")), F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", files.is_sidecar(name, content).alias("sidecar"))


@query("SELECT source || '/' || doc_id AS path, source || '/' || doc_id || '.md' AS out_path, 0::bigint AS out_size, 'error' AS state FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def error_markers(t: Tables) -> DataFrame:
    failed = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.lit(None).cast("timestamp").alias("mtime"))
    return files.markers(failed).drop("out_mtime")


@query()
def chunks_of_documents(t: Tables) -> DataFrame:
    return chunks.chunk(t.documents)


_IDS = "SELECT CASE WHEN event_id % 3 > 0 THEN strftime(ts, '%Y-%m-%d') || '::' ELSE '' END || 'in/' || event_type || '/' || user_id || '.txt#' || event_id AS chunk_id FROM events"


def _ids(t: Tables) -> DataFrame:
    path = F.concat(F.lit("in/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit(".txt"))
    date = F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select(X.chunk_id(path, F.col("event_id"), date).alias("chunk_id"))


_PARSED = f"SELECT chunk_id, CASE WHEN instr(chunk_id, '::') > 0 AND instr(chunk_id, '#') > 0 THEN substr(chunk_id, instr(chunk_id, '::') + 2, instr(chunk_id, '#') - instr(chunk_id, '::') - 2) END AS filename FROM ({_IDS})"


@query(_PARSED)
def chunk_ids(t: Tables) -> DataFrame:
    return _ids(t).select("chunk_id", X.chunk_path(F.col("chunk_id")).alias("filename"))


@query(f"SELECT filename, count(*) AS chunks FROM ({_PARSED}) WHERE filename IS NOT NULL GROUP BY filename")
def embedded_files(t: Tables) -> DataFrame:
    return chunks.embedded_files(_ids(t))


@query(f"SELECT count(DISTINCT filename) AS files, count(filename) AS entries, count(*) AS rows_stored FROM ({_PARSED})")
def store_counts(t: Tables) -> DataFrame:
    rows = _ids(t).select(X.chunk_path(F.col("chunk_id")).alias("filename"))
    return rows.agg(F.count_distinct("filename").alias("files"), F.count("filename").alias("entries"), F.count(F.lit(1)).alias("rows_stored"))


def _docs(t: Tables) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600).cast("timestamp_ntz")
    return t.documents.select("doc_id", "text", "lang", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), at.alias("modified"))


def _stored(t: Tables) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600 + F.when(F.col("doc_id") % 2 == 0, -60).otherwise(60)).cast("timestamp_ntz")
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), at.alias("last_updated"))


@query("SELECT lang, count(*) AS files, sum(n_chars)::bigint AS chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY lang")
def sync(t: Tables) -> DataFrame:
    return chunks.unsynced(_docs(t), _stored(t)).groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND length(d.text) >= 200")
def chunkless(t: Tables) -> DataFrame:
    docs = _docs(t)
    return chunks.unsynced(docs, _stored(t), docs.where(F.length("text") < 200)).select("doc_id")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def modified_since(t: Tables) -> DataFrame:
    return chunks.modified_since(_docs(t), _stored(t)).select("doc_id")


@query("SELECT count(*) AS files, max(make_timestamp((1700000000 + doc_id * 3600) * 1000000)) AS newest FROM documents")
def newest_file(t: Tables) -> DataFrame:
    return _docs(t).agg(F.count(F.lit(1)).alias("files"), F.max("modified").alias("newest"))
