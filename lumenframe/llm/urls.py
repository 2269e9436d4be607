"""URL filters by rules and by an empirical-Bayes reputation of hosts.

Reputation: a labelled page counts as bad if it is toxic or of low quality. The
rate of bad pages of a suffix is shrunk towards the overall rate, a registered
domain's towards its suffix, a host's towards its domain. Each level's prior
weight is the beta-binomial concentration estimated from the spread of that
level's own rates (analysis-of-variance moments). A host is blocked when the
lower bound of its posterior bad rate exceeds ``BLOCK_ABOVE``.

Rules go before reputation: a rule names a host and a path prefix, fits the host
and its subdomains, and the longest fitting rule decides.

Plan: DataFrame functions only. Outcomes shrink to one row per host by partial
aggregation before anything else is shuffled by host; the page rows then join a
table of hosts. Joins by host, domain and suffix deal a key of many rows over many
tasks (``spread_join``). Level totals are aggregates, not collected.

Null urls and urls without ``://`` have an empty host and path and are judged as
the host ``''``. Pages without a label and labels without a page count nowhere.
A page labelled twice is bad if any label says so. Null labels are not bad ones.
Repeated rows stay. Where the labelled hosts show no spread (one host, one page a
host, all bad, all good) the level's prior weight is ``MOST_WEIGHT``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, table, written

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BLOCK_ABOVE = 0.3
#: The overall rate of bad pages before any label is seen, worth one page.
PRIOR_BAD = 0.05
Z = 1.645
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
#: Public suffixes of two labels under which names are registered (fixed values).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.cn", "co.in", "co.kr", "co.za", "com.mx", "com.tr")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url) -> tuple[F.Column, F.Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_columns(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule's text and verdict, else null. The rules travel in the plan: keep them few."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):  # the longest comes outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def levels(host) -> tuple[F.Column, F.Column]:
    """Registered domain and suffix."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(wide, three).otherwise(two), F.when(wide, two).otherwise(F.substring_index(host, ".", -1))


def weight(rates: DataFrame) -> DataFrame:
    """One row ``s``: the concentration of ``(n, k)`` groups, from 1 to 1000."""
    sums = rates.agg(
        F.count(F.lit(1)).cast("double").alias("g"), F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"),
    )
    p = F.try_divide("k", "n")
    spread = F.col("kk") - F.col("k") * p
    noise = p * (1 - p)
    rho = F.try_divide(spread - noise * (F.col("g") - 1), noise * (F.col("n") - F.try_divide("nn", "n") - (F.col("g") - 1)))
    ok = (F.col("g") > 1) & (noise > 0) & (rho > 1e-9)
    return sums.select(F.when(ok, F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.try_divide(F.lit(1.0), rho) - 1))).otherwise(F.lit(MOST_WEIGHT)).alias("s"))


def outcomes(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """``(host, n, k)``: labelled pages and bad ones of every host that has any."""
    bad = labels.groupBy(F.col(label_id).alias("id")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    rows = pages.select(F.col(id_col).alias("id"), host_and_path(F.col(url_col))[0].alias("host"))
    return rows.join(bad, "id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))


def reputation(hosts: DataFrame, rates: DataFrame) -> DataFrame:
    """``(host, bad_rate, low)`` for every row of ``hosts``: posterior mean and lower bound."""
    domain, suffix = levels(F.col("host"))
    rates = rates.withColumn("domain", domain).withColumn("suffix", suffix)
    by_domain = rates.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = by_suffix.agg(((F.coalesce(F.sum("k"), F.lit(0)) + PRIOR_BAD) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("m0"))
    # three single rows
    priors = total.crossJoin(weight(by_suffix).withColumnRenamed("s", "s1")).crossJoin(weight(by_domain).withColumnRenamed("s", "s2")).crossJoin(weight(rates).withColumnRenamed("s", "s3"))
    named = lambda df, tag: df.withColumnRenamed("n", f"n{tag}").withColumnRenamed("k", f"k{tag}")
    known = hosts.select("host").withColumn("domain", domain).withColumn("suffix", suffix)
    known = known.join(named(rates.select("host", "n", "k"), 3), "host", "left")
    sizes = [known.groupBy(c).agg(F.count(F.lit(1)).alias("n")) for c in ("domain", "suffix")]
    known = spread_join(known, named(by_domain.select("domain", "n", "k"), 2), ["domain"], "host", sizes[0], how="left")
    known = spread_join(known, named(by_suffix, 1), ["suffix"], "host", sizes[1], how="left")
    known = known.fillna(0, ["n1", "k1", "n2", "k2", "n3", "k3"]).crossJoin(F.broadcast(priors))
    m1 = (F.col("k1") + F.col("s1") * F.col("m0")) / (F.col("n1") + F.col("s1"))
    m2 = (F.col("k2") + F.col("s2") * m1) / (F.col("n2") + F.col("s2"))
    a, b = F.col("k3") + F.col("s3") * m2, F.col("n3") - F.col("k3") + F.col("s3") * (1 - m2)
    known = known.withColumn("a", a).withColumn("b", b)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    low = mean - Z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return known.select("host", mean.alias("bad_rate"), low.alias("low"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, block_above: float = BLOCK_ABOVE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict, bad_rate, low)`` for every page."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    sizes = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    known = written(reputation(sizes.select("host"), outcomes(pages, labels, id_col, url_col)), "reputation")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    joined = spread_join(rows, known, ["host"], "path", sizes, how="left")
    own = F.when(F.col("low") > block_above, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "low")


def op9_urls(spark, sf_dir) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _weight_sql(name: str) -> str:
    return f"""(SELECT CASE WHEN g > 1 AND p * (1 - p) > 0 AND rho > 1e-9 THEN greatest({LEAST_WEIGHT}, least({MOST_WEIGHT}, 1 / rho - 1)) ELSE {MOST_WEIGHT} END FROM (
 SELECT g, p, (kk - k * p - p * (1 - p) * (g - 1)) / nullif(p * (1 - p) * (n - nn / n - (g - 1)), 0) AS rho FROM (
  SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n * n)::DOUBLE AS nn, sum(k * k / n) AS kk, sum(k)::DOUBLE / sum(n) AS p FROM {name})))"""


ORACLE = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, string_split(host, '.') AS p FROM (SELECT DISTINCT host FROM u)),
w AS (SELECT host, p, array_to_string(p[-2:], '.') IN {TWO_LABEL_SUFFIXES} AS wide FROM h),
names AS (SELECT host, array_to_string(CASE WHEN wide THEN p[-3:] ELSE p[-2:] END, '.') AS domain, CASE WHEN wide THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM w),
r3 AS (SELECT host, count(*) AS n, sum(bad) AS k FROM u JOIN l ON page_id = doc_id GROUP BY host),
r2 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM r3 JOIN names USING (host) GROUP BY domain, suffix),
r1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM r2 GROUP BY suffix),
c AS (SELECT (SELECT (coalesce(sum(k), 0) + {PRIOR_BAD}) / (coalesce(sum(n), 0) + 1) FROM r1) AS m0, {_weight_sql("r1")} AS s1, {_weight_sql("r2")} AS s2, {_weight_sql("r3")} AS s3),
m AS (SELECT names.host, coalesce(r3.n, 0) AS n, coalesce(r3.k, 0) AS k, s3,
  (coalesce(r2.k, 0) + s2 * ((coalesce(r1.k, 0) + s1 * m0) / (coalesce(r1.n, 0) + s1))) / (coalesce(r2.n, 0) + s2) AS m2
  FROM names LEFT JOIN r3 USING (host) LEFT JOIN r2 ON r2.domain = names.domain LEFT JOIN r1 ON r1.suffix = names.suffix, c),
b AS (SELECT host, (k + s3 * m2) / (n + s3) AS mean, n + s3 AS w FROM m),
v AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (w + 1)) AS low FROM b),
fit AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule) AS rn FROM u,
  (VALUES ('block', 'com', '/en/', 'com/en/'), ('allow', 'example.com', '/en/7', 'example.com/en/7'), ('allow', 'net', '/de/', 'net/de/'),
   ('block', 'example.net', '/de/8', 'example.net/de/8'), ('block', 'org', '/es/', 'org/es/')) AS t(verdict, rh, rp, rule)
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, CASE WHEN low > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN v USING (host) LEFT JOIN fit ON fit.page_id = u.page_id AND rn = 1
"""
