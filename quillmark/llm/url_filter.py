"""URL filters: rules on hosts and paths, then trust and distrust spread over the hosts' link graph.

Rules decide the urls that they fit.  For the others, hosts are judged: a host's trust and distrust
start at the shares of its pages that rules allow and block (an empty path counts as `/` there); a host that is only linked to starts with what a
rule for all of its pages says.  Trust follows links (personalised PageRank from trusted hosts, in units of the
restart).  Distrust follows them backwards from blocked hosts: a host gets DAMPING times the mean distrust of
its links' targets, for the share of its pages that isn't blocked itself, so a wholly blocked host has 1, one
that links to blocked hosts only has DAMPING, and one bad link among thousands brings next to nothing.
A host is blocked if the distrust that its links bring it is at least BLOCKED and above its trust: what rules
say of some of its pages says nothing of others.

Everything is DataFrame functions.  Links are summed to host edges before they are shuffled.  Only the
blocked hosts are joined to the pages, so a host of a third of all pages isn't one task's.  A null
url, or one without `://`, has an empty host and path; such pages count as one host that links nowhere.
Null html has no links.  Repeated rows are judged alike and count as pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import textkit as tk

# The rules that the query is specified by.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, ROUNDS, BLOCKED = 0.85, 12, 0.5
#: Decimal places that scores are compared by, so that the order of a sum doesn't matter.
PLACES = 9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""[hH][rR][eE][fF][ \t\r\n]*=[ \t\r\n]*["']?([a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#"'<> \t\r\n]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits the columns host and path; null if none does."""
    fits = []
    for h, p, verdict in rules:
        rule = F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        ok = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        fits.append(F.when(ok, rule))
    return F.array_max(F.array(*fits))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    linked = F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(2)))
    rows = pages.select(host(F.col("url")).alias("src"), linked.alias("to")).select("src", F.translate("to", _UPPER, _LOWER).alias("dst"))
    return rows.filter("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust, brought) after the rounds; brought is the distrust that links bring.  seeds: host, trust0, distrust0; links: src, dst, n."""
    hosts = seeds.unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("trust0"), F.lit(0.0).alias("distrust0"))).groupBy("host").agg(F.sum("trust0").alias("trust0"), F.sum("distrust0").alias("distrust0"))
    out = links.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("n_out"))
    shares = links.join(out.withColumnRenamed("host", "src"), "src").withColumn("share", F.col("n") / F.col("n_out"))
    forth = shares.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("share").alias("wt"), F.lit(0.0).alias("wd"))
    back = shares.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), F.col("share").alias("wd"))
    # every host gets a sum in each round, be it 0
    own = hosts.select(F.col("host").alias("from"), F.col("host").alias("to"), F.lit(0.0).alias("wt"), F.lit(0.0).alias("wd"))
    edges = tk.cut(forth.unionByName(back).unionByName(own))
    base = tk.cut(hosts)
    score = base.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"), F.lit(0.0).alias("brought"))
    for _ in range(rounds if not links.isEmpty() else 0):
        # a host of a third of all links is dealt over tasks; this also cuts the rounds' lineage
        sent = tk.join_few(edges, score.select(F.col("host").alias("from"), "trust", "distrust"), ["from"], "to")
        given = sent.groupBy("to").agg(F.sum(F.col("wt") * F.col("trust")).alias("t"), F.sum(F.col("wd") * F.col("distrust")).alias("d"))
        score = base.join(given, base["host"] == given["to"]).select("host", (F.col("trust0") + damping * F.col("t")).alias("trust"), (F.col("distrust0") + (1 - F.col("distrust0")) * damping * F.col("d")).alias("distrust"), (damping * F.col("d")).alias("brought"))
    return score


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    at = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = at.withColumn("best", best_rule(rules))
    # an empty path is a host's root, and as such falls under what rules say of all of it
    rooted = at.withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path"))).withColumn("best", best_rule(rules))
    share = lambda v: F.avg(F.when(F.col("best.verdict") == v, 1.0).otherwise(0.0))
    seeds = rooted.groupBy("host").agg(share("allow").alias("trust0"), share("block").alias("distrust0"))
    links = tk.cut(host_links(pages))
    # hosts without a page of their own
    away = links.select(F.col("dst").alias("host")).distinct().join(seeds.select("host"), "host", "left_anti").withColumn("path", F.lit("/"))
    whole = [r for r in rules if r[1] == "/"]
    said = away.withColumn("said", best_rule(whole)["verdict"] if whole else F.lit(None).cast("string"))
    is_ = lambda v: F.coalesce((F.col("said") == v).cast("double"), F.lit(0.0))
    seeds = seeds.unionByName(said.select("host", is_("allow").alias("trust0"), is_("block").alias("distrust0")))
    bad = spread(seeds, links).filter(F.round("brought", PLACES) >= BLOCKED).filter(F.round("brought", PLACES) > F.round("trust", PLACES)).select("host", F.lit("block").alias("by_links"))
    return tk.join_few(judged, bad, ["host"], "page_id", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "by_links", F.lit("allow")).alias("verdict"))


def op6_urls(spark, sf_dir: str) -> DataFrame:
    return judge_urls(tk.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    link = _LINK.replace("'", "''")
    return f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {rules}),
rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
placed AS (SELECT page_id, html, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fit AS (SELECT page_id, host, path, html, (SELECT max({{'n': length(h || p), 'rule': h || p, 'v': v}}) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best,
  (SELECT max({{'n': length(h || p), 'v': v}}) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(CASE WHEN path = '' THEN '/' ELSE path END, p)) AS seed FROM placed),
seeds AS (SELECT host, avg(CASE WHEN seed.v = 'allow' THEN 1.0 ELSE 0.0 END) AS t0, avg(CASE WHEN seed.v = 'block' THEN 1.0 ELSE 0.0 END) AS d0 FROM fit GROUP BY host),
found AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 2)), '{_UPPER}', '{_LOWER}') AS dst FROM placed),
links AS (SELECT src, dst, count(*) AS n FROM found WHERE src <> dst AND src <> '' GROUP BY ALL),
away AS (SELECT host, (SELECT max({{'n': length(h), 'v': v}}) FROM rules WHERE p = '/' AND (host = h OR ends_with(host, '.' || h))).v AS v FROM (SELECT DISTINCT dst AS host FROM links) WHERE host NOT IN (SELECT host FROM seeds)),
hosts AS (SELECT host, sum(t0) AS t0, sum(d0) AS d0 FROM (SELECT * FROM seeds UNION ALL SELECT host, CASE WHEN v = 'allow' THEN 1.0 ELSE 0.0 END, CASE WHEN v = 'block' THEN 1.0 ELSE 0.0 END FROM away UNION ALL SELECT src, 0, 0 FROM links) GROUP BY host),
edges AS (
  SELECT src AS f, dst AS t, n / sum(n) OVER (PARTITION BY src) AS wt, 0.0 AS wd FROM links
  UNION ALL SELECT dst, src, 0.0, n / sum(n) OVER (PARTITION BY src) FROM links
  UNION ALL SELECT host, host, 0.0, 0.0 FROM hosts),
score(i, host, trust, distrust, brought) AS (
  SELECT 0, host, CAST(t0 AS DOUBLE), CAST(d0 AS DOUBLE), CAST(0 AS DOUBLE) FROM hosts
  UNION ALL
  SELECT s.i + 1, h.host, CAST(any_value(h.t0) + {DAMPING} * sum(e.wt * s.trust) AS DOUBLE), CAST(any_value(h.d0) + (1 - any_value(h.d0)) * {DAMPING} * sum(e.wd * s.distrust) AS DOUBLE), CAST({DAMPING} * sum(e.wd * s.distrust) AS DOUBLE)
  FROM score s JOIN edges e ON e.f = s.host JOIN hosts h ON h.host = e.t WHERE s.i < {ROUNDS} GROUP BY s.i, h.host)
SELECT f.page_id, f.host, f.path, f.best.rule AS rule,
  coalesce(f.best.v, CASE WHEN round(s.brought, {PLACES}) >= {BLOCKED} AND round(s.brought, {PLACES}) > round(s.trust, {PLACES}) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit f JOIN score s ON s.host = f.host AND s.i = {ROUNDS}
"""
