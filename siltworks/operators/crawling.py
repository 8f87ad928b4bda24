"""Crawls over a table of fetched pages: queues, robots rules, skips in the order a crawler meets them, and the health of each crawl.

A crawler takes addresses from a queue. Addresses of one depth leave it before those of the next, and those of one depth in the order of the pages that
link to them and of the links in each. So a whole depth of all crawls is worked on at once: its rows carry their place in the queue, and what the
crawler would have seen before is what has a lesser place or lies in an earlier depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltworks.functions import html as H
from siltworks.functions.frames import ranked
from siltworks.operators import scans
from siltworks.session import drop_scratch, scratch

PAGES = "url string, content_type string, content_hash string, error string, links array<string>"
EVENTS = ["crawl", "place", "url", "depth", "outcome", "reason"]


@dataclass(frozen=True)
class CrawlPolicy:
    """most_depth: pages of that depth are crawled, their links are not followed; most_pages: per crawl. None sets no limit."""

    most_depth: int | None = None
    most_pages: int | None = None
    respect_robots: bool = True
    skip_equal_content: bool = False


def host_of(url: Column) -> Column:
    """Host and port, lower-cased."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def robots_path(url: Column) -> Column:
    """What robots rules are held against: path and query with escapes resolved, / where there is none."""
    raw = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), r"\+", "%2B")
    path = F.coalesce(F.try_url_decode(raw), raw)
    return F.when(path == "", "/").otherwise(path)


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, line, path, allow) of the group that a robots file (host, text) has for an agent; hosts without one allow all. Rules keep their order."""

    def rules_of(text: str) -> list[tuple[int, str, bool]]:
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        groups = [g for g in parser.entries if g.applies_to(agent)] or ([parser.default_entry] if parser.default_entry else [])
        return [(i, r.path, r.allowance) for i, r in enumerate(groups[0].rulelines)] if groups else []

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(host, *rule) for host, text in zip(batch["host"], batch["text"], strict=True) for rule in rules_of(text or "")]
            yield pd.DataFrame(rows, columns=["host", "line", "path", "allow"])

    found = files.select("host", "text").mapInPandas(convert, "host string, line int, path string, allow boolean")
    unquoted = F.regexp_replace("path", r"\+", "%2B")
    return found.withColumn("path", F.coalesce(F.try_url_decode(unquoted), "path"))


@F.pandas_udf(StringType())
def text_digest(html: pd.Series) -> pd.Series:
    """128-bit BLAKE2s of the visible text; that of the empty text for a null page."""
    return html.map(lambda h: hashlib.blake2s((H.text_of(h) or "").encode(), digest_size=16).hexdigest())


def fetched_pages(pages: DataFrame) -> DataFrame:
    """PAGES from rows of url and html, and of content_type and error where they are there: links resolved against the address, the digest of the
    visible text."""
    have = {c: F.col(c) if c in pages.columns else F.lit(None).cast("string") for c in ("content_type", "error")}
    return pages.select("url", have["content_type"].alias("content_type"), text_digest("html").alias("content_hash"), have["error"].alias("error"), H.page_links("url", "html").alias("links"))


def _allowed(rows: DataFrame, url: str, groups: DataFrame | None) -> DataFrame:
    """rows with allowed: what the first rule says whose path the address starts with; without one, yes. A file's rules are one row (a robots
    file is bounded by what crawlers read of it)."""
    if groups is None:
        return rows.withColumn("allowed", F.lit(True))
    path = robots_path(F.col(url))
    joined = rows.join(groups, host_of(F.col(url)) == F.col("r_host"), "left")
    first = F.try_element_at(F.filter("r_rules", lambda r: (r["path"] == "*") | F.startswith(path, r["path"])), F.lit(1))
    return joined.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("r_host", "r_rules")


def crawl_events(pages: DataFrame, roots: DataFrame, rules: DataFrame | None = None, policy: CrawlPolicy = CrawlPolicy()) -> DataFrame:
    """(crawl, place, url, depth, outcome, reason): what each crawl does, in order from 1.

    pages: PAGES. roots: (crawl, url), the crawls with their first address. rules: (host, line, path, allow). Outcomes are page, error (no
    such page, or its error is set) and skip, for a reason: duplicate (taken from the queue before), robots, content-type:..., duplicate-content (with
    skip_equal_content), or, for a link that is not queued, external-domain or robots. An address is queued as often as links to it are met before it is
    taken. A page without content type is HTML. Of several pages of one address the one of least digest is fetched. Null and non-http addresses are
    no links. Of several roots of a crawl the least is taken.
    """
    groups = None
    if rules is not None and policy.respect_robots:
        collected = F.array_sort(F.collect_list(F.struct("line", "path", "allow")))
        groups = scratch(rules.groupBy(F.lower("host").alias("r_host")).agg(collected.alias("r_rules")), "rules")
    of_page = F.struct("content_hash", "content_type", "error", "links")
    store = scratch(pages.where("url IS NOT NULL").groupBy("url").agg(F.min(of_page).alias("p")).select("url", "p.*"), "store")
    start = roots.where("url IS NOT NULL").groupBy("crawl").agg(F.min("url").alias("url"))
    front = start.select("crawl", F.rtrim("url", F.lit("/")).alias("url")).withColumn("domain", host_of(F.col("url")))
    front = scratch(front.withColumn("pos", F.lit(0).cast("long")), "front")
    seen = hashes = counts = None
    events: list[DataFrame] = []
    depth = 0
    while not front.isEmpty():
        taken = front.select("crawl", "url", "pos")
        if seen is not None:
            taken = taken.unionByName(seen.withColumn("pos", F.lit(-1).cast("long")))
        firsts = scratch(taken.groupBy("crawl", "url").agg(F.min("pos").alias("first")), "firsts")
        popped = front.join(firsts, ["crawl", "url"])
        fresh = _allowed(popped.where("pos = first"), "url", groups).join(store, "url", "left")
        kind = F.coalesce("content_type", F.lit("text/html"))
        failed = F.col("content_hash").isNull() | F.col("error").isNotNull()
        reason = F.when(~F.col("allowed"), "robots").when(~failed & ~F.contains(kind, F.lit("html")), F.concat(F.lit("content-type:"), kind))
        judged = fresh.withColumn("reason", reason).withColumn("outcome", F.when(reason.isNotNull(), "skip").when(failed, "error").otherwise("page"))
        judged = scratch(judged.select("crawl", "domain", "url", "pos", "outcome", "reason", "content_hash", "links"), "judged")
        if policy.skip_equal_content:
            held = judged.where("outcome = 'page'").select("crawl", "content_hash", "pos")
            if hashes is not None:
                held = held.unionByName(hashes.withColumn("pos", F.lit(-1).cast("long")))
            known = scratch(held.groupBy("crawl", "content_hash").agg(F.min("pos").alias("h_first")), "hashes")
            again = (F.col("outcome") == "page") & (F.col("h_first") < F.col("pos"))
            judged = judged.join(known, ["crawl", "content_hash"], "left")
            judged = judged.withColumn("reason", F.when(again, "duplicate-content").otherwise(F.col("reason"))).withColumn("outcome", F.when(again, "skip").otherwise(F.col("outcome"))).drop("h_first")
            judged = scratch(judged, "judged")
            hashes = known.select("crawl", "content_hash")
        stops = None
        if policy.most_pages is not None:
            stops, counts = _stops(judged.where("outcome = 'page'"), counts, policy.most_pages)
        pops = judged.select("crawl", "pos", "url", "outcome", "reason").unionByName(
            popped.where("pos > first").select("crawl", "pos", "url", F.lit("skip").alias("outcome"), F.lit("duplicate").alias("reason"))
        )
        pops = pops.withColumns({"at": F.lit(-1), "depth": F.lit(depth), "level": F.lit(depth)})
        if stops is not None:
            pops = pops.join(stops, "crawl", "left").where("stop IS NULL OR pos <= stop").drop("stop")
        events.append(scratch(pops, "pops"))
        crawled = judged.where("outcome = 'page'")
        if stops is not None:
            crawled = crawled.join(stops, "crawl", "left").where("stop IS NULL OR pos < stop")
        going = policy.most_depth is None or depth < policy.most_depth
        drop_scratch(front)
        if not going:
            break
        links = crawled.select("crawl", "domain", "pos", *(["stop"] if stops is not None else []), F.posexplode("links").alias("at", "url")).where("url IS NOT NULL")
        inside = host_of(F.col("url")) == F.col("domain")
        met = _allowed(links, "url", groups)
        met = scratch(met.withColumn("reason", F.when(~inside, "external-domain").when(~F.col("allowed"), "robots")), "links")
        events.append(
            met.where("reason IS NOT NULL").select(
                "crawl", "pos", "url", F.lit("skip").alias("outcome"), "reason", "at", F.lit(depth + 1).alias("depth"), F.lit(depth).alias("level")
            )
        )
        queued = met.where("reason IS NULL").join(firsts, ["crawl", "url"], "left").where("first IS NULL OR first > pos")
        if stops is not None:
            queued = queued.where("stop IS NULL")
        placed = ranked(queued.select("crawl", "domain", "url", F.col("pos").alias("from"), "at"), ["crawl", "from", "at"], "pos")
        front = scratch(placed.select("crawl", "domain", "url", "pos"), "front")
        seen = firsts.select("crawl", "url")
        depth += 1
    if not events:
        return roots.sparkSession.createDataFrame([], f"crawl {dict(roots.dtypes)['crawl']}, place long, url string, depth int, outcome string, reason string")
    every = events[0]
    for part in events[1:]:
        every = every.unionByName(part)
    order = ["level", "pos", "at"]
    out = scans.running(every, ["crawl"], order, total={"place": F.lit(1).cast("long")})
    return out.select("crawl", "place", "url", "depth", "outcome", "reason")


def _stops(crawled: DataFrame, counts: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame]:
    """(crawl, stop): the place of the page that fills a crawl's limit, of those of this depth, and the pages each crawl has after it."""
    rows = crawled.select("crawl", "pos")
    numbered = scans.running(rows, ["crawl"], ["pos"], total={"n": F.lit(1).cast("long")})
    if counts is not None:
        numbered = numbered.join(counts, "crawl", "left").withColumn("n", F.col("n") + F.coalesce("have", F.lit(0))).drop("have")
    numbered = scratch(numbered, "numbered")
    stops = numbered.where(F.col("n") == most).select("crawl", F.col("pos").alias("stop"))
    now = numbered.groupBy("crawl").agg(F.max("n").alias("have"))
    if counts is not None:
        now = now.unionByName(counts).groupBy("crawl").agg(F.max("have").alias("have"))
    return stops, scratch(now, "counts")


#: What sets a crawl's state; a finish that went well leaves a degraded crawl degraded.
STATE = {"start": "running", "page": "healthy", "error": "degraded", "failed": "degraded"}


def crawl_health(events: DataFrame, key: str = "crawl", order: str = "place", rows_per_range: int | None = None) -> DataFrame:
    """events (key, order, kind, url, detail) with the health of their crawl after each of them: state, last_error, last_error_url, pages, skips,
    last_page.

    Kinds: start, page, skip, error, finished, failed; others change nothing. A crawl is idle before its first event that sets a state, running from a
    start, healthy after a page, degraded after one error that was final until the next page, and after a finish what it was if degraded, else healthy.
    A start clears the error and counts pages and skips anew. Events of equal order come by kind, url and detail.
    """
    local = scans.in_ranges(events.select(key, order, "kind", "url", "detail"), [key, order, "kind", "url", "detail"], rows_per_range)
    kind = F.col("kind")
    setter = F.when(kind.isin(*STATE), kind)
    mark = F.when(kind.isin(*STATE, "finished"), kind)
    error = F.when(kind == "error", F.struct(F.col("detail").alias("e"), F.col("url").alias("u"))).when(
        kind.isin("start", "page"), F.struct(F.lit(None).cast("string").alias("e"), F.lit(None).cast("string").alias("u"))
    )
    page = F.when(kind == "page", F.struct(F.col("url").alias("u"))).when(kind == "start", F.struct(F.lit(None).cast("string").alias("u")))
    totals = {"all_pages": (kind == "page").cast("long"), "all_skips": (kind == "skip").cast("long")}
    one = scratch(scans.folded(local, [key], {"setter": setter, "mark": mark, "error": error, "page": page}, totals), "health")
    base = F.when(kind == "start", F.struct(F.col("all_pages").alias("p"), F.col("all_skips").alias("s")))
    two = scans.folded(one, [key], {"base": base})
    by_setter = F.when(F.col("setter") == "start", "running").when(F.col("setter") == "page", "healthy").when(F.col("setter").isNotNull(), "degraded")
    state = F.when((F.col("mark") == "finished") & ~F.coalesce(by_setter == "degraded", F.lit(False)), "healthy").otherwise(F.coalesce(by_setter, F.lit("idle")))
    return two.select(
        key, order, "kind", "url", "detail", state.alias("state"), F.col("error.e").alias("last_error"), F.col("error.u").alias("last_error_url"),
        (F.col("all_pages") - F.coalesce("base.p", F.lit(0))).alias("pages"), (F.col("all_skips") - F.coalesce("base.s", F.lit(0))).alias("skips"), F.col("page.u").alias("last_page"),
    )


def health_events(events: DataFrame) -> DataFrame:
    """crawl_events() as crawl_health() takes them, with a start before and a finish after them."""
    rows = events.select("crawl", "place", F.col("outcome").alias("kind"), "url", F.coalesce("reason", F.when(F.col("outcome") == "error", "not fetched")).alias("detail"))
    ends = events.groupBy("crawl").agg(F.max("place").alias("n"))
    nothing = F.lit(None).cast("string")
    around = ends.select("crawl", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit("start").alias("kind")), F.struct((F.col("n") + 1).alias("place"), F.lit("finished").alias("kind")))).alias("e"))
    return rows.unionByName(around.select("crawl", "e.place", "e.kind", nothing.alias("url"), nothing.alias("detail")))
