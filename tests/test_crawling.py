"""Crawls against a crawler that takes one address after the other, and running folds against loops."""

import os
import random
from collections import deque
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F
from siltworks.functions import html as H
from siltworks.operators import crawling, scans
from siltworks.plans import crawl_queries
from siltworks.session import drop_scratch

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def crawl_loop(store, root, allowed, policy):
    """store: url -> (content_type, digest, error, links). The events of one crawl in order."""
    root = root.rstrip("/")
    domain = urlsplit(root).netloc.lower()
    queue, seen, hashes, events, pages = deque([(root, 0)]), set(), set(), [], 0
    while queue:
        url, depth = queue.popleft()
        if url in seen:
            events.append((url, depth, "skip", "duplicate"))
            continue
        seen.add(url)
        if not allowed(url):
            events.append((url, depth, "skip", "robots"))
            continue
        page = store.get(url)
        if page is None or page[2] is not None:
            events.append((url, depth, "error", None))
            continue
        kind = page[0] or "text/html"
        if "html" not in kind:
            events.append((url, depth, "skip", f"content-type:{kind}"))
            continue
        if policy.skip_equal_content and page[1] in hashes:
            events.append((url, depth, "skip", "duplicate-content"))
            continue
        hashes.add(page[1])
        events.append((url, depth, "page", None))
        pages += 1
        if policy.most_pages is not None and pages >= policy.most_pages:
            break
        if policy.most_depth is not None and depth >= policy.most_depth:
            continue
        for link in page[3]:
            if urlsplit(link).netloc.lower() != domain:
                events.append((link, depth + 1, "skip", "external-domain"))
            elif not allowed(link):
                events.append((link, depth + 1, "skip", "robots"))
            elif link not in seen:
                queue.append((link, depth + 1))
    return events


def by_crawl(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.crawl, r.place)):
        out.setdefault(r.crawl, []).append(r)
    for rows in out.values():
        assert [r.place for r in rows] == list(range(1, len(rows) + 1))
    return {c: [(r.url, r.depth, r.outcome, r.reason) for r in rows] for c, rows in out.items()}


def random_site(seed, hosts=3, pages=40):
    r = random.Random(seed)
    store = {}
    names = [f"h{i}.example.com" for i in range(hosts)]
    for host in names:
        for p in range(pages):
            links = [f"http://{r.choice(names) if r.random() < 0.15 else host}/p{r.randrange(pages + 3)}" for _ in range(r.randrange(6))]
            links += links[:1] * r.randrange(2)
            store[f"http://{host}/p{p}"] = (r.choice([None, "text/html", "text/html", "image/png"]), f"d{r.randrange(pages)}", r.choice([None] * 9 + ["timeout"]), links)
    return names, store


@pytest.mark.parametrize(
    ("seed", "policy"),
    [
        (1, crawling.CrawlPolicy(skip_equal_content=True)),
        (4, crawling.CrawlPolicy(most_pages=11, most_depth=3, skip_equal_content=True)),
        (5, crawling.CrawlPolicy(respect_robots=False, most_pages=1)),
    ],
)
def test_crawls_like_loop(spark, seed, policy):
    names, store = random_site(seed)
    pages = spark.createDataFrame([(u, *v) for u, v in store.items()], crawling.PAGES).repartition(3)
    roots = spark.createDataFrame([(h, f"http://{h}/p0/") for h in names], "crawl string, url string")
    files = {names[0]: "User-agent: *\nAllow: /p12\nDisallow: /p1\n", names[1]: "User-agent: other\nDisallow: /\n\nUser-agent: silt\nDisallow: /p3\nDisallow:\n"}
    rules = crawling.robots_rules(spark.createDataFrame(list(files.items()), "host string, text string"), "silt")
    parsers = {}
    for host, text in files.items():
        parsers[host] = RobotFileParser()
        parsers[host].parse(text.splitlines())

    def allowed(url):
        host = urlsplit(url).netloc
        return not policy.respect_robots or host not in parsers or parsers[host].can_fetch("silt", url)

    want = {h: crawl_loop(store, f"http://{h}/p0/", allowed, policy) for h in names}
    assert by_crawl(crawling.crawl_events(pages, roots, rules, policy)) == want
    drop_scratch()


def test_query_like_loop(spark):
    pages, roots, rules = crawl_queries.site(spark, FOLDER)
    store = {r.url: (r.content_type, r.content_hash, r.error, r.links) for r in pages.collect()}
    lines = {}
    for r in sorted(rules.collect(), key=lambda r: r.line):
        lines.setdefault(r.host, []).append((r.path, r.allow))

    def allowed(url):
        parts = urlsplit(url)
        return next((ok for path, ok in lines.get(parts.netloc, []) if parts.path.startswith(path)), True)

    want = {r.crawl: crawl_loop(store, r.url, allowed, crawl_queries.POLICY) for r in roots.collect()}
    got = by_crawl(crawl_queries.crawl_events(spark, FOLDER))
    assert got == want
    assert {reason for rows in want.values() for *_, reason in rows} >= {"duplicate", "robots", "external-domain", "duplicate-content", "content-type:application/pdf"}
    drop_scratch()


def test_pages_from_html(spark):
    html = "<a href=' /b/ '>x</a><A HREF=\"c#top\">y</a><a href='mailto:a@b'>m</a><a href=#x>f</a><a href='ftp://x/y'>z</a><a>none</a>text<script>no</script>"
    rows = spark.createDataFrame([("http://h.org/a", html), ("http://h.org/b", None)], "url string, html string")
    got = {r.url: r for r in crawling.fetched_pages(rows).collect()}
    assert got["http://h.org/a"].links == ["http://h.org/b", "http://h.org/c"]
    assert got["http://h.org/b"].links == [] and got["http://h.org/b"].content_hash == crawling.text_digest.func(__import__("pandas").Series([""]))[0]
    roots = spark.createDataFrame([("c", "http://h.org/a")], "crawl string, url string")
    assert by_crawl(crawling.crawl_events(crawling.fetched_pages(rows), roots)) == {
        "c": [("http://h.org/a", 0, "page", None), ("http://h.org/b", 1, "page", None), ("http://h.org/c", 1, "error", None)]
    }


def test_robots_paths(spark):
    urls = ["http://h.org", "http://h.org/a%20b?x=1+2#f", "http://h.org?q", "https://U@H.org:80/%zz"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in rows.select(crawling.robots_path(F.col("u"))).collect()]
    assert got == ["/", "/a b?x=1+2", "?q", "/%zz"]


def test_no_roots_and_no_pages(spark):
    pages = spark.createDataFrame([], crawling.PAGES)
    none = spark.createDataFrame([], "crawl string, url string")
    assert crawling.crawl_events(pages, none).collect() == []
    roots = spark.createDataFrame([("c", "http://h.org/"), ("d", None)], "crawl string, url string")
    assert by_crawl(crawling.crawl_events(pages, roots)) == {"c": [("http://h.org", 0, "error", None)]}


def health_loop(events):
    state, error, error_url, pages, skips, last = "idle", None, None, 0, 0, None
    out = []
    for kind, url, detail in events:
        if kind == "start":
            state, error, error_url, pages, skips, last = "running", None, None, 0, 0, None
        elif kind == "page":
            state, error, error_url, pages, last = "healthy", None, None, pages + 1, url
        elif kind == "skip":
            skips += 1
        elif kind == "error":
            state, error, error_url = "degraded", detail, url
        elif kind == "failed":
            state = "degraded"
        elif kind == "finished" and state != "degraded":
            state = "healthy"
        out.append((state, error, error_url, pages, skips, last))
    return out


@pytest.mark.parametrize("per_range", [7, 1000])
def test_health_like_loop(spark, per_range):
    r = random.Random(3)
    kinds = ["start", "page", "skip", "error", "finished", "failed", "other"]
    rows = [(c, i, r.choices(kinds, [1, 6, 6, 2, 1, 1, 1])[0], f"u{i}", f"e{i}") for c, n in (("a", 200), ("b", 3), ("c", 1), (None, 20)) for i in range(n)]
    frame = spark.createDataFrame(rows, "crawl string, place long, kind string, url string, detail string").repartition(3)
    got = {(x.crawl, x.place): (x.state, x.last_error, x.last_error_url, x.pages, x.skips, x.last_page) for x in crawling.crawl_health(frame, rows_per_range=per_range).collect()}
    for crawl in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == crawl]
        for row, want in zip(mine, health_loop([x[2:] for x in mine]), strict=True):
            assert got[crawl, row[1]] == want


def test_running_folds_over_ranges(spark):
    r = random.Random(4)
    rows = [(None if k == 3 else k, i, r.choice([None, r.randrange(9)])) for k in range(6) for i in range(r.randrange(1, 60) if k else 300)]
    frame = spark.createDataFrame(rows, "k int, i int, v long")
    got = scans.running(frame, ["k"], ["i"], {"seen": F.col("v")}, {"sum": F.col("v")}, rows_per_range=20).collect()
    assert len(got) == len(rows)
    have = {(x.k, x.i): (x.seen, x["sum"]) for x in got}
    for key in {k for k, _, _ in rows}:
        last, total = None, 0
        for k, i, v in rows:
            if k == key:
                last, total = v if v is not None else last, total + (v or 0)
                assert have[k, i] == (last, total)
