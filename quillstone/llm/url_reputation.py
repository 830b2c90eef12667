"""URL filter by empirical-Bayes host reputation.

Outcomes of labelled pages (good or not) are counted by host, registered domain and public suffix. Each level
has a beta-binomial prior around the posterior mean of the level above, and the suffixes one around the overall share. Its
strength m comes from the level's own groups by moments: with n pages and share p in a group under the
parent's mean u, the sum of n (p - u)^2 / (u (1 - u)) over J groups of N pages exceeds J by (N - J) r in
expectation, where r = 1 / (m + 1) is the correlation of outcomes within a group; r is kept within
R_LEAST and R_MOST. A page is kept if its host's posterior mean less Z posterior standard deviations is
at least BOUND, the host's posterior being the domain's prior where no page of it is labelled.

Hosts come from the URL by regular expression, without user, port and final dots, in lower case. Suffixes are told by the
rules of the public suffix list, wildcards and exceptions among them; without a rule it is the last label. The domain has one
label more. The rules are a file that the driver reads (parameter rules; without it, the list that Spark's own jars
carry); they are broadcast, some 10,000 short rows, to the distinct hosts.

Defined results:
- Null URL, or one without scheme and host: null host, domain, suffix, mean and bound, 0 labelled, not kept.
- An address of numbers, or one in brackets (IPv6), is its own domain, with the suffix "". A host that is a suffix itself is
  its own domain.
- Hosts in other scripts stay as they are written: the same name in punycode is another host, to which the same rules apply.
- URLs of any length are read whole, in linear time.
- Null ids and null labels give no outcome; an id with several labels counts with the greatest. Repeated pages are
  as many outcomes and as many rows. A bound that ties with BOUND is kept.
- Without any labelled page nothing is known: mean 0.5, and the bound follows from r = R_START at every level.
- Only id, url, label id and label are read. Empty tables give empty results.
"""

from __future__ import annotations

import os
import zipfile
from functools import cache
from glob import glob

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

Z, BOUND = 1.645, 0.5
R_LEAST, R_MOST, R_START = 0.001, 0.9, 0.1
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)"
#: Kinds of rules, as bits: a suffix, one that takes a label more (*.name), and one that isn't a suffix (!name).
PLAIN, WILD, NOT = 1, 2, 4


def _bundled() -> str:
    """The public suffix list that the HTTP client among Spark's jars brings along."""
    import pyspark

    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for jar in sorted(j for home in homes if home for j in glob(os.path.join(home, "jars", "httpclient-*.jar"))):
        with zipfile.ZipFile(jar) as z:
            if "mozilla/public-suffix-list.txt" in z.namelist():
                return z.read("mozilla/public-suffix-list.txt").decode()
    raise FileNotFoundError("no public suffix list among Spark's jars: give a file as rules")


@cache
def suffix_rules(path: str | None = None) -> tuple[tuple[str, int], ...]:
    """(name, kinds) of a public suffix list, names in other scripts in both forms."""
    if path is None:
        text = _bundled()
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    kinds: dict[str, int] = {}
    for line in text.splitlines():
        rule = line.split("//")[0].split()
        if not rule:
            continue
        name = rule[0].lower().strip(".")
        kind, name = (NOT, name[1:]) if name[0] == "!" else (WILD, name[2:]) if name.startswith("*.") else (PLAIN, name)
        if "*" in name:
            raise ValueError(f"a wildcard is allowed at the start of a rule only: {rule[0]!r}")
        try:
            forms = {name, name.encode("idna").decode()}
        except UnicodeError:
            forms = {name}
        for form in forms:
            kinds[form] = kinds.get(form, 0) | kind
    return tuple(sorted(kinds.items()))


def host_of(url: Column) -> Column:
    """The host of a URL; null without one."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", ""), F.lit(""))


def placed(hosts: DataFrame, rules: str | None = None) -> DataFrame:
    """Rows with host, and the domain and suffix of each: every tail of a host's labels is looked up in the broadcast rules."""
    known = suffix_rules(rules)
    table = F.broadcast(hosts.sparkSession.createDataFrame(list(known) or [("", 0)], "_name string, _kind int"))
    host, rows, length = F.col("host"), hosts.withColumn("_n", F.size(F.split("host", r"\."))), [F.lit(1)]
    out = F.lit(None).cast("int")
    for k in range(1, max((n.count(".") + 1 for n, _ in known), default=0) + 1):
        rows = rows.join(table.withColumnsRenamed({"_name": f"_name{k}", "_kind": f"_kind{k}"}), (F.substring_index(host, ".", -k) == F.col(f"_name{k}")) & (F.col("_n") >= k), "left")
        kind = F.coalesce(f"_kind{k}", F.lit(0))
        length.append(F.when(kind.bitwiseAND(WILD) > 0, F.when(F.col("_n") > k, k + 1)).otherwise(F.when(kind.bitwiseAND(PLAIN) > 0, k)))
        length.append(F.when(kind.bitwiseAND(PLAIN) > 0, k))
        out = F.when(kind.bitwiseAND(NOT) > 0, k - 1).otherwise(out)
    rows = rows.withColumn("_l", F.coalesce(out, F.greatest(*length, F.lit(1))))
    number = host.rlike(r"^([0-9.]+|\[.*)$")
    tail = lambda n: F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.col("_n") - n + 1, F.lit(1)), F.greatest(n, F.lit(1))), ".")
    return rows.select(*hosts.columns, F.when(number, host).otherwise(tail(F.col("_l") + 1)).alias("domain"), F.when(number, "").otherwise(tail(F.col("_l"))).alias("suffix"))


def _level(groups: DataFrame, key: str) -> DataFrame:
    """groups (key, n, good, u) with the prior's strength m and the posterior's a and b."""
    r = groups.where("n > 0").agg(
        F.sum("n").alias("big_n"), F.count(F.lit(1)).alias("big_j"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("u"), F.lit(2)) / (F.col("u") * (1 - F.col("u")))).alias("x")
    )
    free = F.col("big_n") - F.col("big_j")
    rho = F.when(free > 0, F.least(F.lit(R_MOST), F.greatest(F.lit(R_LEAST), (F.col("x") - F.col("big_j")) / F.nullif(free, F.lit(0))))).otherwise(F.lit(R_START))
    m = r.select((1 / F.coalesce(rho, F.lit(R_START)) - 1).alias("m"))
    return groups.crossJoin(F.broadcast(m)).withColumns({"a": F.col("m") * F.col("u") + F.col("good"), "b": F.col("m") * (1 - F.col("u")) + F.col("n") - F.col("good")})


def _mean(suffix: str = "") -> Column:
    return F.col(f"a{suffix}") / (F.col(f"a{suffix}") + F.col(f"b{suffix}"))


def reputations(pages: DataFrame, labels: DataFrame, *, rules: str | None = None, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """host, domain, suffix, labelled pages n, posterior mean and deviation of every host of the pages."""
    url = F.col(f"`{url_col}`").cast("string")
    hosts = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), host_of(url).alias("host")).where("host is not null")
    known = labels.select(F.col(f"`{label_id}`").cast("bigint").alias("id"), (F.col(f"`{label_col}`").cast("int") > 0).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    host = K.cut(placed(hosts.join(known, "id", "left").groupBy("host").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good")), rules))
    add = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domain, suffix = host.groupBy("domain", "suffix").agg(*add), host.groupBy("suffix").agg(*add)
    # half a page of either outcome keeps the overall share off 0 and 1
    top = host.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("u"))
    suffix = K.cut(_level(suffix.crossJoin(F.broadcast(top)), "suffix").select("suffix", _mean().alias("u")))
    domain = K.cut(_level(domain.join(K.small(suffix), "suffix"), "domain").select("domain", "suffix", _mean().alias("u")))
    host = _level(host.join(K.small(domain), ["domain", "suffix"]), "host")
    total = F.col("a") + F.col("b")
    return host.select("host", "domain", "suffix", "n", _mean().alias("mean"), F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1))).alias("sd"))


def judge(pages: DataFrame, labels: DataFrame, *, rules: str | None = None, z: float = Z, bound: float = BOUND, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """page_id, host, domain, suffix, labelled, mean, bound, keep of every page."""
    known = K.cut(reputations(pages, labels, rules=rules, id_col=id_col, url_col=url_col, label_id=label_id, label_col=label_col).select("host", "domain", "suffix", "n", "mean", "sd"))
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), host_of(F.col(f"`{url_col}`").cast("string")).alias("host"))
    low = F.col("mean") - z * F.col("sd")
    return rows.join(K.small(known), "host", "left").select(
        "page_id", "host", "domain", "suffix", F.coalesce("n", F.lit(0)).cast("bigint").alias("labelled"), F.round("mean", 6).alias("mean"), F.round(low, 6).alias("bound"), F.coalesce(F.round(low, 6) >= bound, F.lit(False)).alias("keep")
    )


def sql(rules: str | None = None) -> str:
    """What judge(pages, labels) gives, for DuckDB."""
    known = suffix_rules(rules)
    names = ", ".join("('" + n.replace("'", "''") + f"', {k})" for n, k in known) or "('', 0)"

    def level(name: str, groups: str) -> str:
        return f"""
{name}_g AS ({groups}),
{name}_r AS (SELECT CASE WHEN sum(n) - count(*) > 0 THEN least({R_MOST}::double, greatest({R_LEAST}::double,
    (sum(n * pow(good / n::double - u, 2) / (u * (1 - u))) - count(*)) / (sum(n) - count(*)))) ELSE {R_START}::double END AS r FROM {name}_g WHERE n > 0),
{name}_p AS (SELECT g.*, (1 / r - 1) * u + good AS a, (1 / r - 1) * (1 - u) + n - good AS b FROM {name}_g g, {name}_r)"""

    return f"""
WITH rule(name, kind) AS (VALUES {names}),
parsed AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\\.+$', ''), '') AS host FROM pages),
own AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM parsed WHERE host IS NOT NULL),
tails AS (SELECT host, len(l) AS n, unnest(range(1, len(l) + 1)) AS k, l FROM own),
hit AS (SELECT host, max(CASE WHEN kind & {NOT} > 0 THEN k - 1 END) AS no, max(greatest(CASE WHEN kind & {PLAIN} > 0 THEN k ELSE 1 END, CASE WHEN kind & {WILD} > 0 AND n > k THEN k + 1 ELSE 1 END)) AS yes
    FROM tails JOIN rule ON array_to_string(l[-k:], '.') = name GROUP BY host),
placed AS (SELECT host, l, regexp_matches(host, '^([0-9.]+|\\[.*)$') AS num, coalesce(no, yes, 1) AS n FROM own LEFT JOIN hit USING (host)),
parts AS (SELECT host, CASE WHEN num THEN host ELSE array_to_string(l[-(n + 1):], '.') END AS domain, CASE WHEN num THEN '' ELSE array_to_string(l[-n:], '.') END AS suffix FROM placed),
hosts AS (SELECT page_id, host, domain, suffix FROM parsed LEFT JOIN parts USING (host)),
known AS (SELECT doc_id AS id, max(CASE WHEN quality > 0 THEN 1 ELSE 0 END) AS y FROM labels WHERE quality IS NOT NULL GROUP BY 1),
host AS (SELECT host, domain, suffix, count(y) AS n, coalesce(sum(y), 0) AS good FROM hosts LEFT JOIN known ON id = page_id WHERE host IS NOT NULL GROUP BY ALL),
top AS (SELECT (sum(good) + 0.5::double) / (sum(n) + 1) AS u FROM host),
{level("suffix", "SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(u) AS u FROM host, top GROUP BY suffix")},
{level("domain", "SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.good) AS good, any_value(p.a / (p.a + p.b)) AS u FROM host h JOIN suffix_p p USING (suffix) GROUP BY ALL")},
{level("host", "SELECT h.host, h.n, h.good, p.a / (p.a + p.b) AS u FROM host h JOIN domain_p p ON h.domain = p.domain AND h.suffix = p.suffix")},
final AS (SELECT host, n, a / (a + b) AS mean, a / (a + b) - {Z}::double * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM host_p)
SELECT page_id, h.host, domain, suffix, coalesce(n, 0)::bigint AS labelled, round(mean, 6) AS mean, round(low, 6) AS bound, coalesce(round(low, 6) >= {BOUND}, false) AS keep
FROM hosts h LEFT JOIN final f ON h.host = f.host"""
