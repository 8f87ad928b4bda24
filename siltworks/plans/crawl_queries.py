"""Crawls of all hosts of the page table at once, and their health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import html as H
from siltworks.operators import crawling
from siltworks.plans.registry import query
from siltworks.session import table

#: Each host is a crawl from its first page. A page's address is its number on its host, so that the links lead to pages of the table.
MOST_DEPTH, MOST_PAGES = 3, 25
POLICY = crawling.CrawlPolicy(most_depth=MOST_DEPTH, most_pages=MOST_PAGES, skip_equal_content=True)


def site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, roots, rules) over all pages of the table."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", crawling.host_of(F.col("url")).alias("host"))
    of_host = Window.partitionBy("host")
    pages = pages.withColumn("k", F.row_number().over(of_host.orderBy("page_id")) - 1).withColumn("n", F.count(F.lit(1)).over(of_host))
    address = F.concat(F.lit("http://"), F.col("host"), F.lit("/p"))
    kind = F.when(F.col("page_id") % 11 == 3, "application/pdf").when(F.col("page_id") % 11 != 5, "text/html; charset=utf-8")
    to = lambda h, i: (F.col("k") * 3 + F.length(h) + i) % (F.col("n") + 1)
    links = F.transform(H.hrefs(F.col("html")), lambda h, i: F.when((F.length(h) + i) % 9 == 0, "http://other.example.org/x").otherwise(F.concat(address, to(h, i).cast("string"))))
    store = pages.select(
        F.concat(address, F.col("k").cast("string")).alias("url"), kind.alias("content_type"), F.concat(F.lit("h"), (F.length("html") % 12).cast("string")).alias("content_hash"),
        F.when(F.col("page_id") % 13 == 7, "timeout").alias("error"), links.alias("links"),
    )
    hosts = pages.select("host").distinct()
    roots = hosts.select(F.col("host").alias("crawl"), F.concat(F.lit("http://"), F.col("host"), F.lit("/p0/")).alias("url"))
    rules = hosts.where(F.length("host") % 3 == 0).select("host", F.explode(F.array(*[F.struct(F.lit(i).alias("line"), F.lit(p).alias("path"), F.lit(a).alias("allow")) for i, (p, a) in enumerate((("/p12", True), ("/p1", False)))])).alias("r"))
    return store, roots, rules.select("host", "r.*")


def _level_sql(d: int) -> str:
    """What a crawler does with the addresses of depth d, as SQL."""
    seen = f"UNION ALL SELECT crawl, url, -1 FROM first{d - 1}" if d else ""
    hashes = f"UNION ALL SELECT crawl, hash, -1 FROM hash{d - 1}" if d else ""
    have = f"coalesce((SELECT have FROM have{d - 1} h WHERE h.crawl = j.crawl), 0)" if d else "0"
    carried = f"UNION ALL SELECT crawl, have FROM have{d - 1}" if d else ""
    return f"""
first{d} AS (SELECT crawl, url, min(pos) AS first FROM (SELECT crawl, url, pos FROM front{d} {seen}) GROUP BY ALL),
raw{d} AS (SELECT f.crawl, f.url, f.pos, s.hash, CASE WHEN blocked(f.crawl, f.url) THEN 'robots' WHEN s.url IS NULL OR s.err IS NOT NULL THEN NULL
    WHEN s.kind NOT LIKE '%html%' THEN 'content-type:' || s.kind END AS reason, NOT blocked(f.crawl, f.url) AND (s.url IS NULL OR s.err IS NOT NULL) AS failed
  FROM front{d} f JOIN first{d} x ON f.crawl = x.crawl AND f.url = x.url AND f.pos = x.first LEFT JOIN store s ON s.url = f.url),
hash{d} AS (SELECT crawl, hash, min(pos) AS first FROM (SELECT crawl, hash, pos FROM raw{d} WHERE reason IS NULL AND NOT failed {hashes}) GROUP BY ALL),
judged{d} AS (SELECT r.crawl, r.url, r.pos, failed, CASE WHEN r.reason IS NULL AND NOT failed AND h.first < r.pos THEN 'duplicate-content' ELSE r.reason END AS reason
  FROM raw{d} r LEFT JOIN hash{d} h ON h.crawl = r.crawl AND h.hash = r.hash),
counted{d} AS (SELECT crawl, pos, {have} + row_number() OVER (PARTITION BY crawl ORDER BY pos) AS n FROM judged{d} j WHERE reason IS NULL AND NOT failed),
stop{d} AS (SELECT crawl, pos AS stop FROM counted{d} WHERE n = {MOST_PAGES}),
have{d} AS (SELECT crawl, max(n) AS have FROM (SELECT crawl, n FROM counted{d} {carried}) GROUP BY crawl),
pops{d} AS (SELECT p.* FROM (
    SELECT crawl, pos, url, CASE WHEN failed THEN 'error' WHEN reason IS NULL THEN 'page' ELSE 'skip' END AS outcome, reason FROM judged{d}
    UNION ALL SELECT f.crawl, f.pos, f.url, 'skip', 'duplicate' FROM front{d} f JOIN first{d} x ON f.crawl = x.crawl AND f.url = x.url AND f.pos > x.first) p
  LEFT JOIN stop{d} s ON s.crawl = p.crawl WHERE stop IS NULL OR pos <= stop),
met{d} AS (SELECT j.crawl, j.pos, l.li, l.url, s.stop, CASE WHEN l.url LIKE 'http://other.%' THEN 'external-domain' WHEN blocked(j.crawl, l.url) THEN 'robots' END AS reason
  FROM judged{d} j LEFT JOIN stop{d} s ON s.crawl = j.crawl JOIN links l ON l.src = j.url WHERE j.reason IS NULL AND NOT failed AND (stop IS NULL OR j.pos < stop)),
front{d + 1} AS (SELECT m.crawl, m.url, row_number() OVER (ORDER BY m.crawl, m.pos, m.li) AS pos FROM met{d} m LEFT JOIN first{d} x ON x.crawl = m.crawl AND x.url = m.url
  WHERE m.reason IS NULL AND m.stop IS NULL AND (x.first IS NULL OR x.first > m.pos)),"""


def _events_sql() -> str:
    parts = []
    for d in range(MOST_DEPTH + 1):
        parts.append(f"SELECT crawl, {d} AS level, pos, -1 AS li, url, {d} AS depth, outcome, reason FROM pops{d}")
        if d < MOST_DEPTH:
            parts.append(f"SELECT crawl, {d}, pos, li, url, {d + 1}, 'skip', reason FROM met{d} WHERE reason IS NOT NULL")
    return " UNION ALL ".join(parts)


_SITE_SQL = r"""
num AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS k, count(*) OVER (PARTITION BY host) AS n
  FROM (SELECT page_id, html, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages)),
store AS (SELECT 'http://' || host || '/p' || k AS url, CASE page_id % 11 WHEN 3 THEN 'application/pdf' ELSE 'text/html' END AS kind, 'h' || (length(html) % 12) AS hash, CASE WHEN page_id % 13 = 7 THEN 'timeout' END AS err FROM num),
hrefs AS (SELECT host, k, n, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS li FROM (SELECT host, k, n, regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1) AS h FROM num)),
links AS (SELECT 'http://' || host || '/p' || k AS src, li, CASE WHEN (length(href) + li) % 9 = 0 THEN 'http://other.example.org/x' ELSE 'http://' || host || '/p' || ((k * 3 + length(href) + li) % (n + 1)) END AS url FROM hrefs),
front0 AS (SELECT DISTINCT host AS crawl, 'http://' || host || '/p0' AS url, 0 AS pos FROM num),"""
_EVENTS_SQL = f"WITH {_SITE_SQL}{''.join(_level_sql(d) for d in range(MOST_DEPTH + 1))} ev AS ({_events_sql()}), placed AS (SELECT crawl, row_number() OVER (PARTITION BY crawl ORDER BY level, pos, li) AS place, url, depth, outcome, reason FROM ev)"
_BLOCKED = "(length({0}) % 3 = 0 AND substr({1}, length('http://' || {0}) + 1) LIKE '/p1%' AND substr({1}, length('http://' || {0}) + 1) NOT LIKE '/p12%')"
for _crawl, _url in (("f.crawl", "f.url"), ("j.crawl", "l.url")):
    _EVENTS_SQL = _EVENTS_SQL.replace(f"blocked({_crawl}, {_url})", _BLOCKED.format(_crawl, _url))


@query(f"{_EVENTS_SQL} SELECT crawl, place, url, depth, outcome, reason FROM placed")
def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, error and skip of the crawls of all hosts, in the order a crawler meets them."""
    return crawling.crawl_events(*site(spark, sf_dir), POLICY)


@query(f"""{_EVENTS_SQL},
h AS (SELECT *, last_value(CASE outcome WHEN 'page' THEN 'healthy' WHEN 'error' THEN 'degraded' END IGNORE NULLS) OVER w AS st,
    last_value(CASE outcome WHEN 'page' THEN '' WHEN 'error' THEN url END IGNORE NULLS) OVER w AS bad,
    count(*) FILTER (WHERE outcome = 'page') OVER w AS pages, count(*) FILTER (WHERE outcome = 'skip') OVER w AS skips,
    last_value(CASE WHEN outcome = 'page' THEN url END IGNORE NULLS) OVER w AS last_page FROM placed WINDOW w AS (PARTITION BY crawl ORDER BY place)),
f AS (SELECT crawl, max(place) + 1 AS place, arg_max(coalesce(st, 'running'), place) AS st, arg_max(coalesce(bad, ''), place) AS bad, max(pages) AS pages, max(skips) AS skips, max_by(coalesce(last_page, ''), place) AS last_page FROM h GROUP BY crawl)
SELECT crawl, 0::BIGINT AS place, 'start' AS kind, 'running' AS state, NULL AS last_error, NULL AS last_error_url, 0::BIGINT AS pages, 0::BIGINT AS skips, NULL AS last_page FROM f
UNION ALL SELECT crawl, place, outcome, coalesce(st, 'running'), CASE WHEN bad <> '' THEN 'not fetched' END, nullif(bad, ''), pages, skips, last_page FROM h
UNION ALL SELECT crawl, place, 'finished', CASE st WHEN 'degraded' THEN 'degraded' ELSE 'healthy' END, CASE WHEN bad <> '' THEN 'not fetched' END, nullif(bad, ''), pages, skips, nullif(last_page, '') FROM f""")
def crawl_health_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health of each crawl after each of its events."""
    events = crawling.health_events(crawling.crawl_events(*site(spark, sf_dir), POLICY))
    return crawling.crawl_health(events).drop("url", "detail")
