r"""URL filters: explicit host rules, then empirical-Bayes host reputation.

Labelled page outcomes (bad or good) are counted per host and shrunk through beta-binomial priors from the suffix to the
registered domain to the host.  Each level's prior has its parent's posterior mean; its strength comes from the spread
between that level's members (method of moments).  A host is blocked if the lower bound of its posterior bad rate is
above ``LIFT`` times the bad rate of all outcomes: if it is surely worse than pages are in general.  DataFrame functions
only.  The result has the host's outcomes, bad ones, posterior mean and lower bound (6 digits) beside the verdict.

A suffix is the last label, or the last two where a country's domains are given below a general label (``co.uk``); the
registered domain has one label more.

``host``: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; ``path``: then up to ``?``,
``#`` or the end.  A null url, or one without ``://``, has both empty and gets the verdict of an unlabelled host.
Outcomes that are null do not count; several for one page count as bad if any is bad.  Repeated rows are judged one by
one; a repeated labelled row counts again.  Columns other than page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, small, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"/([0-9]{1,18})(?:[/.]|$)"
Z, LIFT, LEAST, MOST = 1.645, 1.25, 2.0, 1000.0
SUFFIX = r"(?:(?:ac|co|com|edu|gov|go|mil|ne|net|or|org)\.[a-z]{2}|[^.]*)$"
REGISTERED = r"[^.]+\.(?:(?:ac|co|com|edu|gov|go|mil|ne|net|or|org)\.[a-z]{2}|[^.]+)$"


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(2), UPPER, LOWER), part(3)


def _rule(host: Column, path: Column, rules, want) -> Column:
    """``want(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
        out = F.when(fits, want(r)).otherwise(out)
    return out


def _levels(host: Column) -> tuple[Column, Column]:
    reg = F.regexp_extract(host, REGISTERED, 0)
    return F.when(reg == "", host).otherwise(reg), F.regexp_extract(host, SUFFIX, 0)


def _strength(k: int, n: int, b: int, squares: float, mean: float) -> float:
    """How alike the members of a level are: the prior's weight in outcomes.  ``squares`` is the sum of b * b / n over members."""
    if not n:
        return LEAST
    between = (squares - 2 * mean * b + mean * mean * n) / n - mean * (1 - mean) * (k - 1) / n
    return MOST if between <= 0 else min(MOST, max(LEAST, mean * (1 - mean) / between - 1))


def reputation(outcomes: DataFrame, z: float = Z) -> tuple[DataFrame, float]:
    """((host, n, b, mean, lower), overall rate) from (host, n, b): outcomes and bad ones, added up here; n may be 0.

    The hosts' sums are written once, and one aggregate of them gives all priors' strengths.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    reg, suffix = _levels(F.col("host"))
    hosts = durable(hosts.withColumns({"reg": reg, "suffix": suffix}))
    regs = hosts.groupBy("reg", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    levels = [x.filter("n > 0").select(F.lit(k).alias("level"), "n", "b") for k, x in enumerate((suffixes, regs, hosts))]
    found = levels[0].unionAll(levels[1]).unionAll(levels[2]).groupBy("level").agg(F.count(F.lit(1)), F.sum("n"), F.sum("b"), F.sum(F.col("b") * F.col("b") / F.col("n"))).collect()  # three rows
    seen = {r[0]: tuple(r)[1:] for r in found}
    _, n, b, _ = seen.get(2, (0, 0, 0, 0.0))
    root = (b + 1) / (n + 2)
    ms, mr, mh = (_strength(*seen.get(k, (0, 0, 0, 0.0)), root) for k in range(3))
    post = lambda prior, m: (F.lit(m) * prior + F.col("b")) / (F.lit(m) + F.col("n"))
    suffixes = suffixes.select("suffix", post(F.lit(root), ms).alias("suffix_mean"))
    regs = regs.join(suffixes, "suffix").select("reg", post(F.col("suffix_mean"), mr).alias("reg_mean"))
    hosts = hosts.join(regs, "reg").withColumns({"mean": post(F.col("reg_mean"), mh), "weight": F.lit(mh) + F.col("n")})
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return hosts.select("host", "n", "b", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - z * sd, 6).alias("lower")), root


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, lift: float = LIFT) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_n, host_bad, host_mean, host_lower) of all pages; ``outcomes`` has (page_no, bad) for numbers in url paths."""
    host, path = host_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", NUMBER, 1)
    pages = pages.withColumn("page_no", F.when(number != "", number.cast("long")))
    one = outcomes.groupBy("page_no").agg(F.max("bad").alias("bad")).filter("page_no is not null and bad is not null")
    # only pages with a number meet the outcomes: those without would all share one key
    known = pages.filter("page_no is not null").join(one, "page_no").select("host", F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("b"))
    hosts, root = reputation(known.unionAll(pages.select("host", F.lit(0).cast("long"), F.lit(0).cast("long"))))
    out = pages.join(small(durable(hosts)), "host")
    rule = _rule(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2])
    said = _rule(F.col("host"), F.col("path"), rules, lambda r: r[0])
    own = F.when(F.col("lower") > lift * root, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), F.col("n").alias("host_n"), F.col("b").alias("host_bad"), F.col("mean").alias("host_mean"), F.col("lower").alias("host_lower"))


def outcomes_from_labels(labels: DataFrame) -> DataFrame:
    """A page is bad if its document is labelled toxic or of low quality."""
    return labels.select(F.col("doc_id").alias("page_no"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), outcomes_from_labels(table(spark, sf_dir, "labels")))


def _sql() -> str:
    def case(want):
        ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{want((v, h, p))}'" for v, h, p in ranked) + " END"

    strength = lambda t: f"""(SELECT coalesce(max(CASE WHEN v <= 0 THEN {MOST} ELSE least({MOST}, greatest({LEAST}, r * (1 - r) / v - 1)) END), {LEAST}) m FROM (
      SELECT r, (sum(b * b / n::double) - 2 * r * sum(b) + r * r * sum(n)) / sum(n) - r * (1 - r) * (count(*) - 1) / sum(n) v FROM {t}, root WHERE n > 0 GROUP BY r))"""  # noqa: E731
    return rf"""
    WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 2), ''), '{UPPER}', '{LOWER}') host, coalesce(regexp_extract(url, '{URL}', 3), '') path FROM pages),
    p AS (SELECT *, TRY_CAST(nullif(regexp_extract(path, '{NUMBER}', 1), '') AS BIGINT) page_no FROM u),
    one AS (SELECT doc_id page_no, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NULL OR quality IS NULL THEN NULL ELSE 0 END) bad FROM labels GROUP BY 1),
    h AS (SELECT host, count(bad) n, coalesce(sum(bad), 0)::bigint b, CASE WHEN regexp_extract(host, '{REGISTERED}') = '' THEN host ELSE regexp_extract(host, '{REGISTERED}') END reg, regexp_extract(host, '{SUFFIX}') suffix
          FROM p LEFT JOIN one USING (page_no) GROUP BY host),
    g AS (SELECT reg, suffix, sum(n) n, sum(b) b FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) n, sum(b) b FROM g GROUP BY ALL),
    root AS (SELECT (coalesce(sum(b), 0) + 1) / (coalesce(sum(n), 0) + 2)::double r FROM s),
    ms AS {strength('s')}, mr AS {strength('g')}, mh AS {strength('h')},
    sp AS (SELECT suffix, (ms.m * r + b) / (ms.m + n) mean FROM s, root, ms),
    gp AS (SELECT g.reg, (mr.m * sp.mean + b) / (mr.m + n) mean FROM g JOIN sp USING (suffix), mr),
    hp AS (SELECT host, n, b, (mh.m * gp.mean + b) / (mh.m + n) mean, mh.m + n w FROM h JOIN gp USING (reg), mh),
    hr AS (SELECT host, n host_n, b host_bad, round(mean, 6) host_mean, round(mean - {Z} * sqrt(mean * (1 - mean) / (w + 1)), 6) host_lower FROM hp)
    SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule,
           coalesce({case(lambda r: r[0])}, CASE WHEN host_lower > {LIFT} * r THEN 'block' ELSE 'allow' END) AS verdict, host_n, host_bad, host_mean, host_lower FROM p JOIN hr USING (host), root"""


QUERIES = {"op3_url_filters": op3_url_filters}
ORACLE = {"op3_url_filters": _sql()}
