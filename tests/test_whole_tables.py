"""Queries without SQL against plain Python over whole tables."""

import hashlib
import json
import os
import re
from difflib import SequenceMatcher
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
import pytest
from pyspark.sql import functions as F
from siltworks.functions.text import DEFAULT_REDACTIONS
from siltworks.plans import registry, text_queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def table(name):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def ours(spark, name):
    return registry.QUERIES[name](spark, FOLDER).toPandas()


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_redaction(spark):
    got = ours(spark, "redaction_configured").set_index("doc_id")
    patterns = [re.compile(p, re.ASCII) for p in (*DEFAULT_REDACTIONS, *text_queries._PATTERNS)]
    changed = 0
    for doc, text in table("documents")[["doc_id", "text"]].itertuples(index=False):
        want = text
        for p in patterns:
            want = p.sub(lambda m: m[0][:2] + "[REDACTED]", want)
        assert got.loc[doc, "digest"] == md5(want) and got.loc[doc, "changed"] == (want != text)
        changed += want != text
    assert changed


def test_content_ids_and_slugs(spark):
    got = ours(spark, "blake2s_content_ids").set_index("doc_id")["content_id"]
    assert all(got[d] == hashlib.blake2s(t.encode()).hexdigest() for d, t in table("documents")[["doc_id", "text"]].itertuples(index=False))
    slugs = ours(spark, "url_slugs").set_index("page_id")["slug"]
    for page, url in table("pages")[["page_id", "url"]].itertuples(index=False):
        last = urlsplit(url).path.rsplit("/", 1)[-1] or "index"
        kept = re.sub(r"[^a-zA-Z0-9._-]+", "_", last)[:80] or "page"
        assert slugs[page] == f"{kept}-{hashlib.blake2s(url.encode(), digest_size=8).hexdigest()}"


def test_links(spark):
    got = ours(spark, "resolved_page_links").groupby("page_id")["link"].apply(list).to_dict()
    for page, url, html in table("pages")[["page_id", "url", "html"]].itertuples(index=False):
        want = []
        for href in re.findall(r'(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', html):
            full = urldefrag(urljoin(url, href)).url
            if href and not href.startswith(("#", "mailto:")) and urlsplit(full).scheme in ("http", "https"):
                want.append(full.removesuffix("/"))
        assert got.get(page, []) == want


def test_sections(spark):
    got = ours(spark, "bad_sections").set_index("page_id")["bad"]
    for page, html in table("pages")[["page_id", "html"]].itertuples(index=False):
        starts = [m.start() for m in re.finditer("<p>", html)]
        parts = [html[a:b] for a, b in zip(starts, [*starts[1:], len(html)], strict=True)]
        assert list(got[page]) == [i for i, part in enumerate(parts, 1) if not re.search(r"<p[ >]", part)]


@pytest.mark.parametrize("compat", [False, True])
def test_sentences(spark, compat):
    rows = ours(spark, "sentence_chunks_compat" if compat else "sentence_chunks").sort_values(["doc_id", "chunk"])
    got = rows.groupby("doc_id")["chunk_text"].apply(list).to_dict()
    for doc, text in table("documents")[["doc_id", "text"]].itertuples(index=False):
        done, held, n = [], [], 0
        for sentence in text.split(". "):
            size = len(re.findall(r"\S+", sentence))
            if n and n + size > 120:
                done.append(". ".join(held))
                held, n = [], 0
            if size > 120 and compat:
                continue
            held.append(sentence)
            n += size
        if n and not compat:
            done.append(". ".join(held))
        assert got.get(doc, []) == done


def test_word_ratios(spark):
    got = ours(spark, "word_diff_ratio").set_index("key")
    c = table("conversations")
    text = {(a, b): t for a, b, t in c[["conv_id", "turn", "text"]].itertuples(index=False)}
    want = {f"{a}/{b}": SequenceMatcher(None, (t or "").split(), (text[a, b + 1] or "").split()).ratio() for (a, b), t in text.items() if (a, b + 1) in text}
    assert got["ratio"].to_dict() == want and got["differs"].to_dict() == {k: v < 0.96 for k, v in want.items()}


def test_json_reports_hold_the_record(spark):
    from siltworks.operators import logs
    from siltworks.plans.log_queries import order_logs

    rows = logs.redact_record(logs.parse_logs(order_logs(spark, FOLDER)))
    told = {r["doc_id"]: r["report"] for r in logs.report(rows, "json").select("doc_id", "report").collect()}
    digests = ours(spark, "log_json_reports").set_index("doc_id")["digest"]
    for r in rows.select("doc_id", "tool", "status", "summary", "errors", "tests", "artifacts").collect():
        report = json.loads(told[r["doc_id"]])
        assert digests[r["doc_id"]] == md5(told[r["doc_id"]])
        assert (report["tool"], report["status"], report["summary"]) == (r["tool"], r["status"], r["summary"])
        assert [e["message"] for e in report["errors"]] == [e["message"] for e in r["errors"]] and report["artifacts"] == r["artifacts"]
        assert report["tests"]["failed"] == r["tests"]["failed"] and len(report["tests"]["cases"]) == len(r["tests"]["cases"])


def markdown(r, severity):
    """A report of one record, written out."""
    parts = [f"# {r.tool} Report\n\n- **Ecosystem:** {r.ecosystem}\n- **Command:** `{r.command}`\n- **Status:** {r.status}\n- **Severity:** {severity}", f"## Summary\n\n{r.summary}"]
    told = [f"Tool: {r.tool}", f"Ecosystem: {r.ecosystem}", f"Status: {r.status}", f"Summary: {r.summary}"]
    if r.tests:
        told.append(f"Tests: passed={r.tests.passed} failed={r.tests.failed} skipped={r.tests.skipped}")
    for name, issues in (("Errors", r.errors), ("Warnings", r.warnings)):
        told += [f"{name}:", *(f"  - {i.message} ({i.file}:{i.line})" for i in issues)] if issues else []
    told += ["Artifacts:", *(f"  - {a}" for a in r.artifacts)] if r.artifacts else []
    told += ["Metadata:", *(f"  - {e.key}: {e.value}" for e in r.entries)] if r.metadata else []
    parts.append("## Explanation\n\n" + "\n".join(told))
    body = ["## Issues"]
    for name, issues in (("Errors", r.errors), ("Warnings", r.warnings)):
        lines = []
        for i in issues:
            place = i.file and f" ({i.file}" + (f":{i.line}" if i.line is not None else "") + (f":{i.column}" if i.column is not None else "") + ")"
            lines.append(f"- {i.message}" + (f" [{i.code}]" if i.code else "") + (place or ""))
        body += [f"### {name}", "\n".join(lines)] if lines else []
    parts.append("\n\n".join(body if len(body) > 1 else [*body, "No issues were reported by this adapter."]))
    if r.tests:
        overview = [f"- Passed: {r.tests.passed}", f"- Failed: {r.tests.failed}", f"- Skipped: {r.tests.skipped}"] + ([f"- Duration: {r.tests.duration:.2f}s"] if r.tests.duration is not None else [])
        cases = [f"- {c.name} — {c.status}" + (f" ({c.duration:.2f}s)" if c.duration is not None else "") + (f": {c.message}" if c.message else "") for c in r.tests.cases]
        parts.append("\n\n".join(["## Tests", "### Summary", "\n".join(overview), "### Cases", "\n".join(cases) or "No individual test cases were reported."]))
    else:
        parts.append("## Tests\n\nNo test results were provided.")
    parts.append("## Guardrails\n\nNo guardrail configuration available.")
    parts.append("## Artifacts\n\n" + ("\n".join(f"  - {a}" for a in r.artifacts) or "No artifacts recorded."))
    parts.append("## Metadata\n\n" + ("\n".join(f"- {k}: {v}" for k, v in sorted(r.metadata.items())) or "No additional metadata captured."))
    return "\n\n".join(parts)


def test_markdown_reports(spark):
    from siltworks.operators import logs
    from siltworks.plans.log_queries import order_logs

    records = logs.redact_record(logs.parse_logs(order_logs(spark, FOLDER)))
    digests = ours(spark, "log_reports").set_index("doc_id")["digest"]
    # A map that is collected loses its order.
    rows = records.withColumn("severity", logs.severity()).withColumn("entries", F.map_entries("metadata")).collect()
    assert len(rows) == len(digests)
    for r in rows:
        assert md5(markdown(r, r.severity)) == digests[r.doc_id]


def test_page_texts(spark):
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.open = [], []

        def handle_starttag(self, tag, attrs):
            self.open += [tag] if tag in {"script", "style", "noscript"} else []

        def handle_endtag(self, tag):
            if self.open[-1:] == [tag]:
                self.open.pop()

        def handle_data(self, data):
            if not self.open and data.strip():
                self.parts.append(data.strip())

    got = ours(spark, "page_texts").set_index("page_id")["text"]
    for page, html in table("pages")[["page_id", "html"]].itertuples(index=False):
        parser = Text()
        parser.feed(html)
        parser.close()
        assert got[page] == "\n".join(parser.parts)
