import hashlib
import re
from difflib import SequenceMatcher
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from siltworks.functions import extensions, html, text, values


def one(spark, column, **given):
    row = {k: v for k, v in given.items()}
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'long'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("x")).first()["x"]


def test_redaction_keeps_two_characters(spark):
    assert one(spark, text.redact(F.col("t")), t="AssertionError: API_KEY=not-a-real leaked") == "AssertionError: AP[REDACTED] leaked"
    assert one(spark, text.redact(F.col("t")), t="token: abc x") == "to[REDACTED] x"
    patterns = (*text.DEFAULT_REDACTIONS, r"[\w.]+@[\w.]+\.[a-z]{2,}", r"\b\d{1,3}(?:\.\d{1,3}){3}\b")
    t = "mail a.b@c.org from 10.0.0.12\nsecret = x password:y\nünï token=é"
    want = t
    for p in patterns:
        want = re.sub(p, lambda m: m[0][:2] + "[REDACTED]", want)
    assert one(spark, text.redact(F.col("t"), patterns), t=t) == want


def test_key_values(spark):
    got = one(spark, text.key_values(F.col("t")), t='A=1 b="two words" a=3 empty="" =x c=')
    assert got == {"a": "3", "b": "two words", "empty": '""'}
    assert one(spark, text.key_values(F.col("t")), t="") == {}


def test_globs(spark):
    assert one(spark, text.matches_any_glob(F.col("t"), ["build/"]), t="x/build/y.py")
    assert not one(spark, text.matches_any_glob(F.col("t"), ["build/"]), t="x/build")
    assert one(spark, text.matches_any_glob(F.col("t"), ["*.p[yi]"]), t="x/a.py")
    assert not one(spark, text.matches_any_glob(F.col("t"), ["?.py"]), t="ab.py")


def test_imports_and_modules(spark):
    f = lambda level, target, package=0: one(spark, text.absolute_import(F.col("m"), F.col("p") == 1, F.col("lv"), F.col("t")), m="a.b.c", p=package, lv=level, t=target)
    assert f(0, "x.y") == "x.y" and f(1, "d") == "a.b.d" and f(2, "d") == "a.d" and f(1, "d", 1) == "a.b.c.d"
    assert f(3, "d") is None and f(1, None) == "a.b"
    assert one(spark, text.module_name(F.col("t")), t="src/a/__init__.py") == "a"


def chunks(t, most, compat):
    done, held, n = [], [], 0
    for s in t.split(". "):
        size = len(s.split())
        if n + size > most and n:
            done.append(". ".join(held))
            held, n = [], 0
        if size > most and compat:
            continue
        held.append(s)
        n += size
    return done if compat or not n else [*done, ". ".join(held)]


def test_sentence_chunks(spark):
    t = ". ".join(" ".join("w" * (i % 3 + 1) for _ in range(i % 7 + 1)) for i in range(40)) + ". " + " ".join(["long"] * 30) + ". end"
    for compat in (False, True):
        assert one(spark, text.chunk_sentences(F.col("t"), 12, compat), t=t) == chunks(t, 12, compat)


def test_headers_and_definitions(spark):
    assert one(spark, text.inject_headers(F.col("t")), t="A\nb c\n\n\nD\n") == "<h2>A</h2><p>b c</p>\n<h2>D</h2><p></p>"
    assert one(spark, text.definitions(F.col("t")), t="class A:\n    def m(self): pass\ndef f(): pass\n") == ["A", "f"]
    assert one(spark, text.safe_filename(F.col("t")), t="  --??") == "untitled"
    assert one(spark, text.markdown_escape(F.col("t")), t="a*b\n[c]") == "a\\*b \\[c\\]"


def test_numbers(spark):
    assert one(spark, values.metric_delta(F.col("a"), F.col("b")), a=2.0, b=3.0) == (1.0, "increase", 50.0)
    assert one(spark, values.metric_delta(F.col("a"), F.col("b")), a=0.0, b=3.0)["percent"] is None
    assert one(spark, values.threshold_severity(F.col("a"), F.lit(10)), a=20.0) == "medium"
    back = values.to_sexagesimal(F.col("a"))
    assert abs(one(spark, values.from_sexagesimal(back["degrees"], back["minutes"], back["seconds"]), a=-12.3456) + 12.3456) < 1e-9
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, values.retry_after_seconds(F.col("t"), now), t="Mon, 01 Jan 2024 00:01:40 GMT") == 100.0
    assert one(spark, values.retry_after_seconds(F.col("t"), now), t="nonsense") is None
    assert one(spark, values.blake2s_hex(F.col("t")), t="é") == hashlib.blake2s("é".encode()).hexdigest()


def test_arrays(spark):
    d = spark.createDataFrame([(1, 3.0, 0.0), (2, 4.0, 0.0)], "k int, a double, b double")
    assert [tuple(r) for r in values.normalise_columns(d, ["a", "b"]).orderBy("k").collect()] == [(1, 0.6, 0.0), (2, 0.8, 0.0)]
    n = spark.range(6).withColumn("g", F.lit(1))
    assert [r["window"] for r in values.rolling_windows(n, ["g"], ["id"], "id", 3).orderBy("id").collect()] == [[0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert sorted(len(r["items"]) for r in values.batched(n.where("id < 5"), ["g"], ["id"], "id", 2).collect()) == [1, 2, 2]


def test_word_diff():
    frame = pd.DataFrame({"key": ["a"], "before": ["x y z"], "after": ["x z"]})
    got = next(values.word_diff_ratios(iter([frame])))
    assert got["ratio"][0] == SequenceMatcher(None, ["x", "y", "z"], ["x", "z"]).ratio() and got["differs"][0]


def test_html(spark):
    base = "http://h.example/a/b?x=1"
    for link in ("../c/", "/d#f", "http://o.example/", "mailto:x@y", "#top", "ftp://z", "", None):
        got = html.normalise_link(base, link)
        want = None if not link or link[0] == "#" or link.startswith(("mailto:", "ftp:")) else urljoin(base, link).split("#")[0].removesuffix("/")
        assert got == want
    assert html.text_of("<p>a<script>no</script> b &amp; c</p>") == "a\nb & c"
    page = "<p>Overview</p>\n<p>1. **Locate** items:</p>\n<p>2. **Inspect** items</p>\n<p> </p>\n<ul><li>Prefix: value</li></ul>"
    assert html.strip_empty("<p> </p><p><br/></p><p>x<br/></p>") == "<p>x<br/></p>"
    assert html.listify("<p>1. a</p><hr><p>2. b 3. c</p><p>d</p><p>4. e</p>") == "<ol><li>a</li><li>b c</li></ol><hr><p>d</p><ol><li>e</li></ol>"
    assert html.promote_short(f"<p class='k'>{'x' * 63}</p><p>{'x' * 64}</p><p></p>") == f"<h2 class='k'>{'x' * 63}</h2><p>{'x' * 64}</p><p></p>"
    assert html.bold_prefixes(f"<li>a <b>b</b>: c:d</li><li>{'x' * 41}: y</li><li>z</li>") == f"<li><strong>a b</strong>: c:d</li><li>{'x' * 41}: y</li><li>z</li>"
    assert html.section_by_h2("<i>i</i><p>l</p><h2>a</h2><p>x</p><h2>b</h2>") == "<article><section><p>l</p></section><i>i</i><section><h2>a</h2><p>x</p></section><section><h2>b</h2></section></article>"
    assert html.section_by_h2("<article><p>l</p></article>") == "<article><p>l</p></article>"
    assert html.strong_spacing("<strong> a</strong><strong> <b>c</b></strong>") == "<strong>a</strong><strong> <b>c</b></strong>"
    assert html.tidy(page) == "<article><section><h2>Overview</h2>\n<ol><li><strong>Locate items</strong>:</li><li><strong>Inspect</strong> items</li></ol>\n\n\n<ul><li><strong>Prefix</strong>: value</li></ul></section></article>"
    long = "<h2>" + "x" * 120 + "</h2><h2>ok</h2>"
    assert one(spark, html.demote_long_headers(F.col("t")), t=long) == "<p>" + "x" * 120 + "</p><h2>ok</h2>"
    assert one(spark, html.bad_sections(F.col("t")), t="<h2>a</h2><p>x</p><h2>b</h2>") == [2]


def test_registries(spark):
    r = extensions.Registry()
    r.register("a", lambda x: x + 1)
    assert r.call("a", 1) == 2
    hooks = extensions.Hooks()
    hooks.on("h", lambda: 1 / 0)
    hooks.on("h", lambda: 5)
    assert hooks.fire("h") == [None, 5] and hooks.summary() == {"h": 2}
    logs = spark.createDataFrame([("python", "ERROR message=x")], "adapter string, raw string")
    assert extensions.apply_parser("structured", logs).first()["errors"][0]["message"] == "x"


def test_url_slugs(spark):
    import hashlib

    from siltworks.functions import text as T

    urls = ["https://h.example/a/b c.html?q=1#f", "https://h.example", "https://h.example/x/", "https://h.example/" + "y" * 100, None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(T.url_slug(F.col("u")).alias("s")).collect()
    digest = lambda u: hashlib.blake2s(u.encode(), digest_size=8).hexdigest()
    assert [r["s"] for r in rows] == [f"b_c.html-{digest(urls[0])}", f"index-{digest(urls[1])}", f"index-{digest(urls[2])}", "y" * 80 + f"-{digest(urls[3])}", None]


def test_examples_and_settings(spark, tmp_path):
    from siltworks.sources import readers

    for name in ("python/b.log", "python/a.log", "go/x.log", "go/no.txt"):
        (tmp_path / "examples" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "examples" / name).write_text("x")
    assert [(r["adapter"], r["name"]) for r in readers.list_examples(spark, f"{tmp_path}/examples").collect()] == [("go", "x.log"), ("python", "a.log"), ("python", "b.log")]
    assert readers.list_examples(spark, f"{tmp_path}/examples", "go").count() == 1
    (tmp_path / "c.toml").write_text("[a]\nb = 1\n")
    (tmp_path / "c.json").write_text('{"a": 2}')
    assert readers.read_config(f"{tmp_path}/c.toml") == {"a": {"b": 1}} and readers.read_config(f"{tmp_path}/c.json") == {"a": 2}
