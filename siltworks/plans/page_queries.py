"""HTML operators over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import html as H
from siltworks.operators import graph
from siltworks.plans.registry import query
from siltworks.session import table

_LINKS = """unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*"([^"]*)"', 1))"""


@query(f"SELECT page_id, {_LINKS} AS href FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("href"))


@query(f"SELECT url, list_sort(list(DISTINCT href))::VARCHAR AS links FROM (SELECT url, {_LINKS} AS href FROM pages) GROUP BY url")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("url", F.explode(H.hrefs(F.col("html"))).alias("href"))
    rows = graph.sitemap(links, "url", "href")
    quoted = F.transform("links", lambda x: F.when(x.rlike(r"[,'\"\[\]{}()\s\\:=]") | (F.length(x) == 0), F.concat(F.lit("'"), x, F.lit("'"))).otherwise(x))
    return rows.select("url", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("links"))


@query("SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][\\w-]*)', 1))) AS tag FROM pages) GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(H.tags(F.col("html"))).alias("tag"))
    per_page = tags.groupBy("tag", "page_id").agg(F.count(F.lit(1)).alias("c"))
    return per_page.groupBy("tag").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_pages"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(html, '(?i)<b[\\s>]')")
def pages_with_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(H.has_tag(F.col("html"), "b")).select("page_id", "url")


@query("SELECT DISTINCT trim(unnest(regexp_extract_all(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)), ' ') AS header FROM pages")
def distinct_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.explode(H.tag_texts(F.col("html"), "h1")).alias("header")).distinct()


@query("SELECT min(length(html))::INT AS shortest, max(length(html))::INT AS longest, count(*) FILTER (WHERE length(html) > 3000) AS n_long FROM pages")
def html_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("html")
    return table(spark, sf_dir, "pages").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.count_if(n > 3000).alias("n_long"))


@query("""
SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS bare, md5(regexp_replace(html, '(?i)</?b\\b[^>]*>', '', 'g')) AS unbold,
  md5(regexp_replace(html, '(?s)<script.*?</script>', '', 'g')) AS unframed, len(regexp_extract_all(html, '(?s)(<script.*?</script>)', 1))::INT AS n_frames FROM pages""")
def html_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    framed = F.replace(F.replace(h, F.lit("<script"), F.lit("<iframe")), F.lit("</script>"), F.lit("</iframe>"))
    back = F.replace(F.replace(H.without_iframes(framed), F.lit("<iframe"), F.lit("<script")), F.lit("</iframe>"), F.lit("</script>"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(H.without_comments(h)).alias("bare"), F.md5(H.without_tag(h, "b")).alias("unbold"), F.md5(back).alias("unframed"), F.size(H.iframes(framed)).alias("n_frames"))


@query("""
SELECT page_id, regexp_matches(html, '(?is)^\\s*<p[ >]') AND regexp_matches(html, '(?is)(</p>|</iframe>)\\s*$') AS draft_ok,
  len(list_filter(regexp_extract_all(html, '(?is)<h1>(.*?)</h1>', 1), lambda x: length(x) > 40))::INT AS n_long_headers FROM pages""")
def header_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    made = H.demote_long_headers(h, "h1", 40)
    lost = F.regexp_count(h, F.lit("<h1>")) - F.regexp_count(made, F.lit("<h1>"))
    return table(spark, sf_dir, "pages").select("page_id", H.well_formed_draft(h).alias("draft_ok"), lost.alias("n_long_headers"))


@query("""
SELECT a.page_id, b.page_id AS other_id FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages) a
JOIN (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages) b ON a.host = b.host AND b.page_id = a.page_id + 1""")
def same_domain_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    other = pages.select(F.col("page_id").alias("other_id"), F.col("url").alias("other_url"))
    return pages.join(other, F.col("other_id") == F.col("page_id") + 1).where(H.same_domain(F.col("url"), F.col("other_url"))).select("page_id", "other_id")


@query()
def resolved_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: relative addresses follow the rules of urljoin; tests hold it against the library."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(H.resolved_links("url", H.hrefs(F.col("html")))).alias("link"))


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the text comes from an HTML parser."""
    return table(spark, sf_dir, "pages").select("page_id", H.page_text("html").alias("text"))


@query()
def tidied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the rewriting rules are tested on examples."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(H.tidied("html")).alias("digest"))
