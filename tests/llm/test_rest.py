import hashlib
import math
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from siltworks.llm import hilbert, mixing, phrases, pulearn, render, rules


def test_rules_counts_and_base(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = rules.verdicts(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in rows:
        counts = brute.base_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert r["base_failed"] == failed and (r["kept"] is False or not failed)
    assert rules.verdicts(no_docs, labels).collect() == []
    kept = rules.keep_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r["doc_id"]) for r in rows if r["kept"])


def test_binomial_tail_is_exact():
    for n, k, p in ((50, 0, 0.1), (200, 3, 0.05), (1000, 2, 0.01)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(rules.tail_probability(n, k, p) - want) < 1e-12
    assert rules.certified(10_000, [0, 0, 200], 0.005, 0.001) == 2
    assert rules.certified(100, [0], 0.005, 0.001) == 0


def test_cutoffs_are_taken_for_what_they_gain():
    cuts = (0.9, 0.5, 0.1)
    assert rules.best_cutoff(cuts, [0, 0, 0], [3, 7, 7]) == 0.5
    assert rules.best_cutoff(cuts, [0, 1, 9], [3, 7, 12]) == 0.5
    assert rules.best_cutoff(cuts, [0, 4], [0, 4]) is None and rules.best_cutoff(cuts, [], []) is None


@pytest.mark.parametrize("extra", [False, True])
def test_verdicts_match_a_plain_version(spark, odd_docs, extra):
    """The whole table of sf0.01 with its labels, and again with odd rows and labels of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    if extra:
        odd = odd_docs.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text", "lang")
        docs = docs.unionByName(odd).unionByName(odd.where("doc_id = 10000009"))
        more = [(10_000_001, 1), (10_000_001, None), (10_000_003, 0), (10_000_009, 0), (10_000_010, 1), (10_000_010, 0), (None, 1), (77_777_777, 1), (10_000_012, 1)]
        labels = labels.unionByName(spark.createDataFrame(more, "doc_id long, quality int"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    known = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            known[r["doc_id"]] = min(known.get(r["doc_id"], 1), r["quality"])
    want = brute.quality_verdicts(rows, known, rules.CUTOFFS, rules.RISK, rules.ERROR)
    got = sorted(((r["doc_id"], r["kept"], r["rejected_by"]) for r in rules.verdicts(docs, labels).collect()), key=str)
    assert got == sorted(want, key=str)
    beyond = [by for _, kept, by in got if not kept and not by.startswith("base")]
    assert len(beyond) >= 10


def test_certified_cutoffs_bound_false_rejections(spark):
    good = " ".join(f"good{i}" for i in range(40))
    bad = " ".join(f"bad{i}***" for i in range(40))
    rows = [(i, good if i % 10 else bad, "en") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    got = rules.verdicts(docs, labels).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in got} == {True: 8100, False: 900}


def test_small_strata_take_pooled_cutoffs(spark):
    good = " ".join(f"good{i}" for i in range(40))
    bad = " ".join(f"bad{i}***" for i in range(40))
    lang = lambda i: "en" if i % 50 < 44 else "de" if i % 50 < 49 else "xx"
    docs = spark.createDataFrame([(i, bad if i // 50 % 5 == 0 or lang(i) == "xx" else good, lang(i)) for i in range(4000)], "doc_id long, text string, lang string")
    quality = (F.expr("doc_id div 50 % 5 <> 0") | (F.col("lang") == "xx")).cast("int").alias("quality")
    labels = docs.where("lang <> 'xx' OR doc_id < 100").select("doc_id", quality)
    rows = rules.verdicts(docs, labels).join(docs, "doc_id").groupBy("lang", "kept").count().collect()
    # German has 320 good labels, too few alone; both labelled documents of xx are good and look bad.
    assert {(r["lang"], r["kept"]): r["count"] for r in rows} == {("en", True): 2816, ("en", False): 704, ("de", True): 320, ("de", False): 80, ("xx", True): 80}


def test_pooled_cutoff_heeds_own_labels():
    assert rules.unrefuted(300, [0, 0, 0], 0.005, 0.001) == 3
    assert rules.unrefuted(300, [0, 40, 40], 0.005, 0.001) == 1
    row = {"n": 50, "n_pool": 5000, "top_word_share_good": [0] * 8, "top_word_share_low": [0] * 8, "top_word_share_good_pool": [0, 0, 0, 5, 5, 500, 500, 500], "top_word_share_low_pool": [1, 2, 3, 9, 9, 10, 10, 10]}
    assert rules.cutoff_of(row, "top_word_share", 0.005, 0.001) == 0.6
    assert rules.cutoff_of(row | {"top_word_share_good": [0, 9] + [9] * 6}, "top_word_share", 0.005, 0.001) == 0.9
    assert rules.cutoff_of(row | {"n_pool": 60}, "top_word_share", 0.005, 0.001) is None


def test_mixing(odd_docs, no_docs, corpus_docs):
    assert mixing.mix(no_docs).collect() == []
    for docs in (odd_docs, corpus_docs):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()), key=str)
        taken, target = defaultdict(int), {}
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source_size"], r["target"]] += r["taken"]
            target[r["source_size"], r["target"]] = r["target"]
        total = sum(r["size"] for r in rows)
        assert abs(sum(target.values()) - total) < 1e-6 * total
        for k, t in target.items():
            assert abs(taken[k] - t) <= max(70, 0.02 * t)


def test_targets_fill_to_a_level(spark):
    sizes = {"0a": 10, "0b": 1000, "0c": 400, "0d": 0}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "mx_key string, mx_source_size long")).collect()
    got = {r["mx_key"]: r["mx_target"] for r in rows}
    assert got["0a"] == 30 and got["0d"] == 0
    assert abs(got["0b"] - (1410 - 30) * 2 / 3) < 1e-9 and abs(got["0c"] - (1410 - 30) / 3) < 1e-9


def test_mixed_documents(corpus_docs, odd_docs):
    for docs in (corpus_docs, odd_docs):
        want = defaultdict(int)
        for r in mixing.mix(docs).collect():
            want[r["doc_id"]] += r["taken"]
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns
        got = defaultdict(int)
        for r in out.collect():
            got[r["doc_id"]] += len(brute.words(r["text"]))
            assert r["n_chars"] == len(r["text"])
        assert {k: v for k, v in want.items() if v} == dict(got)


def lz_phrases(text):
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    return seen


def test_phrases_are_a_greedy_parse():
    for text in ("", "a", "aaaaaaa", "abracadabra abracadabra", "日本日本日本語"):
        parser = phrases.Parser()
        parser.feed(text, 0)
        cuts = [0, *parser.ends]
        assert {text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)} == lz_phrases(text)


def test_likeness_estimates_the_overlap_of_phrase_sets():
    import random

    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    misses = []
    for k in range(60):
        a = [r.choice(words) for _ in range(400)]
        b = list(a)
        for _ in range(7 * k):
            b[r.randrange(len(b))] = r.choice(words)
        a, b = " ".join(a), " ".join(b)
        x, y = lz_phrases(a), lz_phrases(b)
        got = phrases.likeness(phrases.phrase_signature(a), phrases.phrase_signature(b))
        misses.append(abs(got - len(x & y) / len(x | y)))
    assert sum(misses) / len(misses) < 0.04 and max(misses) < 0.15
    assert phrases.likeness(phrases.phrase_signature(""), phrases.phrase_signature("")) == 1.0
    assert phrases.likeness(phrases.phrase_signature("abc"), phrases.phrase_signature("")) == 0.0


def test_edit_robustness(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(phrases, "DOCS_PER_TASK", 4)
    assert phrases.edit_robustness(no_docs).collect() == []
    rows = phrases.edit_robustness(odd_docs).collect()
    hashed = odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    docs = [(r["doc_id"], r["text"]) for r in sorted(hashed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"], r["text"]))]
    assert len(rows) == len(docs)
    want = defaultdict(list)
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, other, near = (phrases.phrase_signature(x) for x in (text, edited, after))
        want[doc].append((len(text), hashlib.sha256(edited.encode()).hexdigest(), phrases.as_text(own), phrases.as_text(other), phrases.likeness(own, other), phrases.likeness(own, near)))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    single = phrases.edit_robustness(odd_docs.where("doc_id = 7")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


def test_hilbert_curve_steps_by_one():
    bits = 4
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = hilbert.curve_index(grid, bits)
    assert sorted(index.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards_match_a_plain_version(spark, odd_docs):
    import math
    import zlib

    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd_docs):
        rows = [(r["doc_id"], r["text"] or "", r["lang"], r["source"]) for r in docs.collect()]
        cells = []
        for column in (2, 3):
            names = sorted({r[column] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
            cells.append({x: i * 1024 // len(names) for i, x in enumerate(names)})
        grid = [(cells[0][r[2]], cells[1][r[3]], min(1023, math.floor(math.log2(len(r[1].encode()) + 16) * 40))) for r in rows]
        curve = hilbert.curve_index(np.array(grid)).tolist()
        least = {}
        for r, c in zip(rows, curve, strict=True):
            least[r[1]] = min(c, least.get(r[1], c))
        got = hilbert.shard(docs).collect()
        facts = lambda r: (r[0] is not None, r[0], len(r[1].encode()) + 16, zlib.crc32(r[1].encode()), least[r[1]])
        assert sorted(map(facts, rows)) == sorted((r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"], r["curve"]) for r in got)
        ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
        assert [r["curve"] for r in ordered] == sorted(least[r[1]] for r in rows)
        # Rows of a text stand in one run, so no more texts than there are cuts are parted.
        runs = [(r["text_crc32"], r["size"]) for r in ordered]
        assert sum(a != b for a, b in zip(runs[:-1], runs[1:], strict=True)) == len(set(runs)) - 1
        homes = defaultdict(set)
        for r in got:
            homes[r["text_crc32"], r["size"]].add(r["shard"])
        assert sum(len(x) - 1 for x in homes.values()) <= 39
        n = len(rows)
        starts = [-(-s * n // 40) for s in range(41)]
        assert [(r["shard"], r["slot"]) for r in ordered] == [(s, i) for s in range(40) for i in range(starts[s + 1] - starts[s])]


def test_places_of_a_hot_text(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("text_key"), F.when(F.col("id") % 3 == 2, 5).otherwise(F.col("id") % 700 + 9).alias("curve"), "id")
    got = hilbert.one_place(rows).groupBy("text_key").agg(F.collect_set("curve").alias("c"), F.count("*").alias("n")).collect()
    assert {r["text_key"]: (r["c"], r["n"]) for r in got} == {0: ([9], 1000), 1: ([9], 1000), 2: ([5], 1000)}


def test_sharding(odd_docs, no_docs, corpus_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(hilbert, "ROWS_PER_TASK", 20)
    assert hilbert.shard(no_docs).collect() == []
    for docs in (odd_docs, corpus_docs):
        rows = hilbert.shard(docs).collect()
        assert len(rows) == docs.count()
        slots = defaultdict(list)
        for r in rows:
            assert r["law"] == "rows" and r["grown_shard"] is None
            slots[r["shard"]].append(r["slot"])
        counts = [len(slots.get(s, [])) for s in range(40)]
        assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(40))
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    hilbert.write_clustered(odd_docs, f"{tmp_path}/out", 3)
    assert odd_docs.sparkSession.read.parquet(f"{tmp_path}/out").count() == odd_docs.count()


def labelled_kinds(spark):
    good = "the quick brown fox number%d jumps over the lazy dog and runs home to eat some food with friends"
    junk = "%%%d### buy!! NOW!! $$$ click*** here*** &&& win!! CASH!! ### %%%"
    rows = [(i, (good % i) if i % 3 else junk.replace("%d", str(i))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, docs.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))


def test_classifier(spark, odd_docs, no_docs):
    docs, labels = labelled_kinds(spark)
    out = {r["doc_id"]: r for r in pulearn.score_documents(docs, labels).collect()}
    import zlib

    wrong = 0
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        wrong += r["held_out"] and r["predicted"] != int(i % 3 != 0)
    assert wrong == 0
    # Labelled negatives are used nowhere, but they are no unlabelled texts either.
    silent = labels.withColumn("quality", F.when(F.col("quality") == 1, 1).otherwise(0))
    assert {r["doc_id"]: round(r["score"], 6) for r in pulearn.score_documents(docs, silent).collect()} == {i: round(r["score"], 6) for i, r in out.items()}
    odd = pulearn.score_documents(odd_docs, labels.limit(0)).collect()
    assert len(odd) == odd_docs.count() and all(r["score"] == 0.5 for r in odd)
    assert pulearn.score_documents(no_docs, labels).collect() == []


def test_classifier_scores_odd_rows_by_a_fitted_model(spark, odd_docs):
    docs, labels = labelled_kinds(spark)
    odd = odd_docs.select((F.col("doc_id") + 100_000).alias("doc_id"), "text")
    labels = labels.unionByName(spark.createDataFrame([(100_001, None), (100_002, 1), (100_002, 0), (None, 1), (100_004, 1), (100_004, 1), (5_000_000, 1)], "doc_id long, quality int"))
    rows = pulearn.score_documents(docs.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("features", F.lit(1)), labels).collect()
    assert len(rows) == 900 + odd.count()
    by = defaultdict(set)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        by[r["doc_id"]].add((r["score"], r["held_out"]))
    assert all(len(x) == 1 for x in by.values())
    score = {k: next(iter(v))[0] for k, v in by.items()}
    assert score[100_004] == score[100_005] != 0.5
    assert next(iter(by[None]))[1] is False
    kinds = [next(iter(by[i]))[0] >= 0.3 for i in range(900)]
    assert sum(k != bool(i % 3) for i, k in enumerate(kinds)) <= 5


def softplus(x):
    return math.log1p(math.exp(-abs(x))) + max(x, 0.0)


def test_risk_and_gradient_match_a_plain_version():
    r = np.random.default_rng(3)
    positive, unlabelled = r.normal(0.5, 1, (40, 5)), r.normal(0, 1, (70, 5))
    positive[:, 4] = unlabelled[:, 4] = 1

    def plain(w, prior):
        f = lambda rows: [sum(a * b for a, b in zip(x, w, strict=True)) for x in rows]
        fp, fu = f(positive.tolist()), f(unlabelled.tolist())
        bracket = sum(map(softplus, fu)) / 70 - prior * sum(map(softplus, fp)) / 40
        decay = sum(v * v for v in w[:-1]) * pulearn.WEIGHT_DECAY / 2
        return prior * sum(softplus(-x) for x in fp) / 40 + max(0, bracket) + decay, bracket, decay

    for prior, w in ((0.4, np.array([0.3, -0.2, 0.1, 0.5, 0.2])), (0.95, np.array([1.5, 1.2, 1.1, 1.5, 0.2]))):
        sums = pulearn.softplus_sums(unlabelled[:30], w) + pulearn.softplus_sums(unlabelled[30:], w)
        risk, bracket, gradient = pulearn.nonnegative_risk(w, positive, sums, prior)
        want = plain(w.tolist(), prior)
        assert abs(risk - want[0]) < 1e-6 and abs(bracket - want[1]) < 1e-9
        assert (bracket < 0) == (prior == 0.95)
        goal = (lambda v: plain(v, prior)[0]) if bracket >= 0 else (lambda v: plain(v, prior)[2] - plain(v, prior)[1])
        for i in range(5):
            up, down = w.copy(), w.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert abs((goal(up.tolist()) - goal(down.tolist())) / 2e-5 - gradient[i]) < 1e-6


def test_prior_is_that_of_the_mixture(spark):
    r = np.random.default_rng(8)
    width = pulearn.n_features()
    draw = lambda n, at: np.concatenate([r.normal(at, 1, (n, 4)), r.normal(0, 1, (n, width - 4))], 1).astype("<f4")
    positive = draw(1500, 1.5)
    for share in (0.2, 0.7):
        n = 8000
        rows = np.concatenate([draw(int(n * share), 1.5), draw(n - int(n * share), -1.5)])
        table = spark.createDataFrame([(bytearray(x.tobytes()),) for x in rows], "features binary")
        start = pulearn.PUModel(rows.mean(0).astype(float), rows.std(0).astype(float))
        assert abs(pulearn.estimated_prior(start, [positive[0::2], positive[1::2]], table) - share) < 0.06


def test_rendering():
    v = render.visible_text
    assert v(None) == v("") == ""
    assert v("<p>a<p>b <b>c</b>\n d") == "a\n\nb c d"
    assert v("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>") == "- x\n- y\n  1. 1\n  2. 2"
    assert v("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>s<td>22</table>") == "Name       N\nlong name  1\ns          22"
    assert v("<div hidden>no</div><span style='display: none'>no</span>a<br>b<script>x='<p>'</script><!-- no -->&amp;") == "a\nb&"
    assert v("<pre>  k\n   z</pre>") == "  k\n   z"
    assert v("<head><title>no</title></head><body>yes</p>end") == "yes\n\nend"
    assert v("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_rendering_at_any_depth():
    v = render.visible_text
    assert v("<div>" * 200 + "<ul><li>a<li>b</ul>") == "- a\n- b"
    assert v("<div>" * 50_000 + "deep <b>text") == "deep text"
    assert v("<b>" * 30_000 + "<p>x<p>y") == "x\n\ny"
    assert v("<table><tr><td>" * 3000 + "x") == "x"
    lists = v("".join(f"<ul><li>a{i}" for i in range(2000)))
    assert [x.strip() for x in lists.split("\n")] == [f"- a{i}" for i in range(2000)]
    assert lists.split("\n")[3] == "      - a3" and lists.split("\n")[1000] == " " * 80 + "- a1000"
    wide = v("<table>" + "".join(f"<tr><td>{i}<td>b" for i in range(20_000)) + "</table>")
    assert wide.count("\n") == 19_999 and wide.startswith("0      b\n1      b")
    assert v("<p>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert v("<svg>" + "<g>" * 20_000 + "<text>t") == "t"


def test_rendering_loses_no_table_text():
    v = render.visible_text
    assert v("<table><tbody><td>x</td><td>y</td></table>") == "x  y"
    assert v("<table><td>a<td>b<tr><td>c</table>") == "a  b\nc"
    assert v("<table><tbody><form><tr><td>x<td>y</tr></form></tbody></table>") == "x  y"
    assert v("<table><tbody>stray<tr><td>x</table>") == "stray\nx"
    assert v("<table><thead><div>stray</div></thead><tbody hidden>no<tr><td>no</table>") == "stray"
    assert v("<table><colgroup><col><tbody><tr><td>x<td>y</table>") == "x  y"
    assert v("<table><colgroup><col><tr><td>x</table>") == v("<table><colgroup><col><td>x</table>") == "x"
    assert v("<table><colgroup> text<tr><td>x</table>") == "text\nx"
    assert v("<table><caption>c<td>x</table>") == "c\nx"


def test_rendering_shows_drawings_and_formulas():
    v = render.visible_text
    assert v("a <svg><title>no</title><rect/><defs/><text>up <tspan>on</tspan></text> no <text>two</text></svg> b") == "a up on two b"
    assert v("<svg><defs><text>no</text></defs><title/><style/><text><![CDATA[1 < 2]]></text></svg>after") == "1 < 2 after"
    assert v("<svg><g><path d='M0'><p>out") == "out"
    assert v("<svg><foreignObject><p>in<p>side</foreignObject><text display=none>no</text></svg>") == "in\n\nside"
    assert v("<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math>") == "x= 1 2"
    assert v("<a href=x/>kept</a> <desc>kept</desc>") == "kept kept"


def test_rendering_reads_tags_of_any_length():
    v = render.visible_text
    assert v('a<b data-x="' + "<i>no</i> " * 5000 + '">c</b>') == "ac"
    assert v("<b " + " ".join(f'a{i}="x > y"' for i in range(3000)) + ">c") == "c"
    assert v("<b " + "x" * 5000 + " title='1 > 2'>c") == "c"
    assert v("<p don't>a<p title=it's>b") == "a\n\nb"
    assert v("<b title='>a</b> b") == "a b"
    assert v("<b t='>a</b> <i hidden u=\"'\" v='>b</i>") == "a"
    assert v("x > y <!-- no") == "x > y"


def test_rendering_rows(spark):
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None), (2, "v", "<" * 500)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, render.extract_text(pages).collect()), key=str)
    assert len(got) == 4 and (1, "u", "x", 1, 1) in got and (None, None, "", 0, 0) in got
    assert render.extract_text(pages.limit(0)).collect() == []
