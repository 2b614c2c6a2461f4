"""URL filtering: path rules first, then empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are pooled for each host. A host's bad rate is shrunk towards its registered
domain's, that towards its suffix's, and that towards the overall rate: each level is a beta-binomial whose prior
strength is estimated from the data by moments. A host is blocked when the lower posterior bound of its bad rate
exceeds a threshold, so little evidence never blocks. Everything is DataFrame functions; statistics are partial sums
per host, so a host with a third of all pages costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The rules of the contract: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host is blocked when mean - Z * sd of its posterior bad rate is over LIMIT.
Z, LIMIT = 1.645, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule whose host is this host or a parent of it and whose path begins this path; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def registered_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0)


def _strength(groups: DataFrame, parent: Column) -> DataFrame:
    """One row: the prior strength (pseudo-count) of beta-binomial groups (n, bad) around their parents' rates, by moments."""
    pq = parent * (1 - parent)
    s = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - parent, 2))
    size, k = F.sum("n"), F.count(F.lit(1))
    top = s - F.sum(pq)
    below = F.avg(pq) * (size - F.sum(F.col("n") * F.col("n")) / size - (k - 1))
    phi = F.when(below > 0, F.least(F.greatest(top / below, F.lit(0.0001)), F.lit(0.5))).otherwise(F.lit(0.5))
    return groups.agg((1 / phi - 1).alias("k"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes(host, bad 0/1) -> (host, n, bad, rate, bound): posterior mean and lower bound of each host's bad rate.

    Null hosts or outcomes take no part; no outcome at all gives no row.
    """
    hosts = (
        outcomes.where("host is not null and bad is not null")
        .groupBy("host")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
        .withColumn("domain", registered_domain(F.col("host")))
        .withColumn("suffix", suffix(F.col("host")))
    )
    whole = hosts.agg((F.sum("bad") / F.sum("n")).alias("parent"))
    pooled = lambda key, d: d.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def shrunk(groups: DataFrame) -> DataFrame:
        strength = _strength(groups, F.col("parent"))  # one row
        return groups.join(F.broadcast(strength)).withColumn("rate", (F.col("bad") + F.col("k") * F.col("parent")) / (F.col("n") + F.col("k")))

    suffixes = shrunk(pooled(["suffix"], hosts).join(F.broadcast(whole))).select("suffix", F.col("rate").alias("parent"))
    domains = shrunk(pooled(["suffix", "domain"], hosts).join(suffixes, "suffix")).select("domain", F.col("rate").alias("parent"))
    out = shrunk(hosts.join(domains, "domain"))
    rate, weight = F.col("rate"), F.col("n") + F.col("k")
    return out.select("host", "n", "bad", "rate", (rate - Z * F.sqrt(rate * (1 - rate) / (weight + 1))).alias("bound"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): the outcome of a page is the label of the document whose number ends its path; bad is low quality or toxic."""
    host, path = split_url(F.col("url"))
    numbered = pages.select(host.alias("host"), F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("long").alias("doc_id")).where("doc_id is not null and host != ''")
    marks = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return numbered.join(marks, "doc_id").select("host", "bad")


def filter_urls(pages: DataFrame, reputation: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, source): the fitting rule's verdict, else block if the host's bound is over limit.

    Every row of pages gives a row: null urls have empty host and path and are allowed; repeated rows stay; other columns are not read.
    """
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", fitting_rule(F.col("host"), F.col("path")))
    r = reputation.select(F.col("host").alias("of_host"), "bound")
    # where a rule decides, the key is null: such rows need no reputation and meet in no partition
    joined = p.withColumn("ask", F.when(F.col("fit").isNull(), F.col("host"))).join(r, F.col("ask") == F.col("of_host"), "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, host_reputation(labelled_outcomes(pages, table(spark, sf_dir, "labels"))))


_SQL = r"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), raw as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from cut
), p as (
  select page_id, coalesce(translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') as path from raw
), numbered as (
  select host, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html|/)?$', 1), '') as bigint) as doc_id from p where host != ''
), marks as (
  select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by doc_id
), hosts as (
  select host, count(*)::double as n, sum(bad)::double as bad, regexp_extract(host, '[^.]*\.?[^.]*$') as dom,
         string_split(host, '.')[-1] as suf
  from numbered join marks using (doc_id) group by host
), s0 as (select suf, sum(n) as n, sum(bad) as bad, (select sum(bad) / sum(n) from hosts) as parent from hosts group by suf
), s as (select suf, (bad + k * parent) / (n + k) as rate from s0, (select KAPPA as k from s0)
), d0 as (select dom, sum(n) as n, sum(bad) as bad, any_value(rate) as parent from hosts join s using (suf) group by dom
), d as (select dom, (bad + k * parent) / (n + k) as rate from d0, (select KAPPA as k from d0)
), h0 as (select host, n, bad, rate as parent from hosts join d using (dom)
), hr as (select host, n + k as w, (bad + k * parent) / (n + k) as rate from h0, (select KAPPA as k from h0)
), fit as (
  select *, case when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
    when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
    when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
    when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule from p
)
select page_id, fit.host as host, path, rule,
  case rule when 'www.example.com/en/' then 'allow' when 'com/' then 'allow' when 'example.com/en/' then 'block'
    when 'net/es/' then 'block' when 'net/fr/' then 'block'
    else case when rate - 1.645 * sqrt(rate * (1 - rate) / (w + 1)) > 0.5 then 'block' else 'allow' end end as verdict
from fit left join hr on fit.host = hr.host
""".replace(
    "KAPPA",
    "1 / (case when avg(parent * (1 - parent)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) > 0 then least(greatest((sum(n * pow(bad / n - parent, 2))"
    " - sum(parent * (1 - parent))) / (avg(parent * (1 - parent)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1))), 0.0001), 0.5) else 0.5 end) - 1",
)

QUERIES = {"op3_url_filters": op3_url_filters}
ORACLE = {"op3_url_filters": _SQL}
