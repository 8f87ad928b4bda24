"""Redaction, words and text functions over documents, benchmark, parts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import text as T
from siltworks.functions import values as V
from siltworks.plans.registry import query
from siltworks.session import scratch, table

_SECRET = r"(?i)(ap|se|to|pa)(i[_-]?key|cret|ken|ssword)\s*[:=]\s*\S+"
#: Configured patterns beside the default: addresses, dotted quads, long hexadecimal strings.
_PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\b[0-9a-f]{32,}\b")
#: What their matches hold.
_HELD = {**T.HELD_BY_MATCHES, _PATTERNS[0]: "@", _PATTERNS[1]: r"\d\.\d"}


@query(rf"""
SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE r <> text) AS n_redacted, sum(length(r))::BIGINT AS redacted_chars,
  CASE WHEN count(*) FILTER (WHERE r <> text) > 0 THEN 'warning' ELSE 'ok' END AS severity
FROM (SELECT source, text, regexp_replace(text, '{_SECRET}', '\1[REDACTED]', 'g') AS r FROM documents) GROUP BY source""")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "text", T.redact(F.col("text")).alias("r"))
    changed = F.count_if(F.col("r") != F.col("text"))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), changed.alias("n_redacted"), F.sum(F.length("r")).alias("redacted_chars"), F.when(changed > 0, "warning").otherwise("ok").alias("severity")
    )


@query(rf"SELECT doc_id, md5(regexp_replace(text, '{_SECRET}', '\1[REDACTED]', 'g')) AS digest FROM documents")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest"))


@query(r"""
SELECT doc_id, md5(r) AS digest, r <> text AS changed FROM (
  SELECT doc_id, text, regexp_replace(text, '\b([0-9a-f]{2})[0-9a-f]{30,}\b', '\1[REDACTED]', 'g') AS r FROM documents)""")
def redaction_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.redact(F.col("text"), _PATTERNS[2:])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"), (out != F.col("text")).alias("changed"))


@query()
def redaction_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the patterns in turn need lookahead to keep two characters; a test holds it against Python's re."""
    out = T.redact(F.col("text"), (*T.DEFAULT_REDACTIONS, *_PATTERNS), _HELD)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", out.alias("r"))
    return docs.select("doc_id", F.md5("r").alias("digest"), (F.col("r") != F.col("text")).alias("changed"))


_WORDS = r"""
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) AS pos FROM documents)"""


@query(f"""
WITH {_WORDS}, c AS (SELECT word, count(*) AS n, min(doc_id * 1000000 + pos) AS f FROM w WHERE word NOT IN ('the', 'of', 'and', 'a', 'in', 'de', 'la') GROUP BY word)
SELECT word, n, row_number() OVER (ORDER BY n DESC, f) AS place FROM c ORDER BY n DESC, f LIMIT 50""")
def word_frequency_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    stop = spark.createDataFrame([(w,) for w in ("the", "of", "and", "a", "in", "de", "la")], "word string")
    counted = T.word_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text", stop)
    order = [F.col("n").desc(), "first_key", "first_pos"]
    top = counted.orderBy(*order).limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("word", "n", "place")


@query(f"WITH {_WORDS} SELECT word, count(*) AS n FROM w GROUP BY word")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.word_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text").select("word", "n")


@query("SELECT c, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''")
    return chars.groupBy("c").agg(F.count(F.lit(1)).alias("n_docs"))


@query("""
SELECT item_id, length(text)::BIGINT AS n, list_transform(range(1, (SELECT max(length(text)) FROM benchmark) + 1), lambda i: CASE WHEN i <= length(text) THEN unicode(substr(text, i::BIGINT, 1)) ELSE 0 END)::VARCHAR AS ids FROM benchmark""")
def token_ids_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts, filled up to the longest one."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.length("text").cast("long").alias("n"))
    longest = items.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    ids = V.padded(F.when(F.col("n") == 0, F.array().cast("array<int>")).otherwise(codes), longest)
    return items.select("item_id", "n", F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]")).alias("ids"))


@query(r"""
SELECT doc_id, md5(CASE WHEN length(t) > 0 THEN t ELSE 'untitled' END) AS file_name, md5(regexp_replace(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
  md5(lower(trim(regexp_replace(p, '[^\p{L}\p{N}_]+', ' ', 'g')))) AS title
FROM (SELECT doc_id, p, regexp_replace(regexp_replace(trim(regexp_replace(p, '[^a-zA-Z0-9\-_. ]', '', 'g')), '\s+', '-', 'g'), '^[-._ ]+|[-._ ]+$', '', 'g') AS t
  FROM (SELECT doc_id, text AS p FROM documents))""")
def slugs_and_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of whole texts, as digests."""
    p = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.safe_filename(p)).alias("file_name"), F.md5(T.category_slug(p)).alias("slug"), F.md5(T.clean_title(p)).alias("title"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([\\`*_{}\[\]<>#|])', '\\\1', 'g'), '[\r\n]+', ' ', 'g')) AS escaped,
  md5(replace(replace(replace(replace(text, chr(10), ' '), '\n', ' '), '  ', ' '), '  ', ' ')) AS one_line,
  md5(replace(replace(text, '\', '\\'), '"', '\"')) AS label FROM documents""")
def escaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.markdown_escape(t)).alias("escaped"), F.md5(T.remove_newlines(t)).alias("one_line"), F.md5(T.label_escape(t)).alias("label"))


@query(r"""
SELECT doc_id, md5(regexp_replace(replace(regexp_replace(lower(text), '\bexcept\b.*', '', 'g'), 'e.g.', ''), '[^\p{L}\p{N}_\s]', '', 'g')) AS digest FROM documents""")
def preprocess_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.preprocess_description(F.col("text"))).alias("digest"))


@query("""
SELECT p_partkey, CASE WHEN contains(lower(t1), 'ring') THEN t1 || repeat(' RING', 5) ELSE t1 END AS boosted, substr(p_brand, 1, 2) AS code FROM (
 SELECT p_partkey, p_brand, CASE WHEN contains(lower(t0), 'standard') THEN t0 || repeat(' standard', 5) ELSE t0 END AS t1 FROM (SELECT p_partkey, p_brand, p_name || ' ' || p_type AS t0 FROM part))""")
def boosted_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.boost_keywords(text, ["standard", "RING"]).alias("boosted"), F.substring("p_brand", 1, 2).alias("code"))


@query(r"""
SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0))::INT AS n_sections, length(text) > 0 AS some FROM documents""")
def header_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.inject_headers(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(made, F.lit("<h2>")).alias("n_sections"), (F.length("text") > 0).alias("some"))


@query("""
SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn, role, text) AS conversation, count(*) AS n_turns FROM conversations GROUP BY conv_id""")
def flatten_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    line = lambda s: F.concat(F.upper(s["role"]), F.lit(": "), s["text"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", line), "\n").alias("conversation"), F.size("t").cast("long").alias("n_turns"))


@query()
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: packing is a fold. A test holds both variants against a loop."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.chunk_sentences(F.col("text"), 120)).alias("chunk", "chunk_text"))


@query()
def sentence_chunks_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that loses the last chunk and over-long sentences."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.chunk_sentences(F.col("text"), 120, compat=True)).alias("chunk", "chunk_text"))


@query(r"""
WITH l AS (SELECT o_orderkey, 'Key=' || o_orderkey || ' status="' || o_orderstatus || ' x" price=' || o_custkey || ' key=last' || o_custkey AS line FROM orders)
SELECT o_orderkey, 'last' || regexp_extract(line, 'last(\d+)', 1) AS k, regexp_extract(line, 'status="([^"]+)"', 1) AS status, regexp_extract(line, 'price=(\S+)', 1) AS price, 3 AS n FROM l""")
def key_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    line = F.format_string('Key=%d status="%s x" price=%d key=last%d', "o_orderkey", "o_orderstatus", "o_custkey", "o_custkey")
    kv = o.select("o_orderkey", T.key_values(line).alias("m"))
    return kv.select("o_orderkey", F.col("m.key").alias("k"), F.col("m.status").alias("status"), F.col("m.price").alias("price"), F.size("m").alias("n"))


@query(r"""
SELECT p_partkey, path, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(path, '^(src|lib)/', ''), '\.py$', ''), '/', '.'), '(^|\.)__init__$', ''), '', '') AS module,
  regexp_matches(path, '(^|/)tests?/') OR regexp_matches(path, '(^|/)test_[^/]*\.py$') OR regexp_matches(path, '(^|/)[^/]*_test\.py$') AS is_test,
  NOT regexp_matches(path, '(^|/)\.\.(/|$)') AS safe, '[sensitive-file-' || substr(sha256(path), 1, 12) || ']' AS masked,
  contains(path, 'Brand#1') OR regexp_matches(path, '(^|/)tests/') AS excluded
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/tests/' WHEN 2 THEN '../' ELSE '' END || p_brand || '/' || CASE p_partkey % 3 WHEN 0 THEN '__init__' WHEN 1 THEN 'test_a' ELSE 'mod' || p_partkey END || '.py' AS path FROM part)""")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("p_size") % 4 == 0, "src/").when(F.col("p_size") % 4 == 1, "lib/tests/").when(F.col("p_size") % 4 == 2, "../").otherwise("")
    name = F.when(F.col("p_partkey") % 3 == 0, "__init__").when(F.col("p_partkey") % 3 == 1, "test_a").otherwise(F.concat(F.lit("mod"), F.col("p_partkey").cast("string")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(head, F.col("p_brand"), F.lit("/"), name, F.lit(".py")).alias("path"))
    path = F.col("path")
    return p.select(
        "p_partkey", "path", T.module_name(path).alias("module"), T.is_test_path(path).alias("is_test"), T.safe_relative_path(path).alias("safe"), T.masked_path(path).alias("masked"),
        T.matches_any_glob(path, ["*Brand#1*", "tests/"]).alias("excluded"),
    )


@query("""
SELECT r_name || '.' || n_name || '.' || c_mktsegment AS module, unnest([r_name, r_name || '.' || n_name, r_name || '.' || n_name || '.' || c_mktsegment]) AS prefix,
  CASE WHEN c_mktsegment LIKE 'A%' THEN 'private' ELSE 'public' END AS visibility
FROM (SELECT DISTINCT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def package_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = rows.select(F.concat_ws(".", "r_name", "n_name", "c_mktsegment").alias("module"), F.when(F.col("c_mktsegment").startswith("A"), "_x").otherwise("x").alias("n")).distinct()
    return named.select("module", F.explode(T.package_prefixes(F.col("module"))).alias("prefix"), T.visibility(F.col("n")).alias("visibility"))


@query(r"""
SELECT doc_id, sha256('document' || chr(0) || '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' || chr(10)) AS digest FROM documents""")
def stable_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = V.canonical_json({c: F.col(c) for c in ("n_chars", "lang", "doc_id")})
    return table(spark, sf_dir, "documents").select("doc_id", V.stable_digest("document", body).alias("digest"))


@query()
def blake2s_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: DuckDB has no BLAKE2s; a test holds it against hashlib."""
    return table(spark, sf_dir, "documents").select("doc_id", V.blake2s_hex("text").alias("content_id"))


@query(r"""
SELECT b.item_id, lower(trim(regexp_replace(b.text, '[^\p{L}\p{N}_]+', ' ', 'g'))) AS title, f.doc_id FROM benchmark b
LEFT JOIN (SELECT lower(trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'))) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1) f
ON f.k = lower(trim(regexp_replace(b.text, '[^\p{L}\p{N}_]+', ' ', 'g')))""")
def title_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.operators.joining import first_match

    title = T.clean_title(F.col("text"))
    merged = first_match(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), title, title, ["doc_id"], ["doc_id"])
    return merged.select("item_id", title.alias("title"), "doc_id")


@query("""
WITH g AS (SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1)
SELECT d.doc_id, g.first_doc, g.n FROM documents d JOIN g ON md5(d.text) = g.h WHERE g.n > 1""")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    groups = d.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    return d.join(groups, "h").select("doc_id", "first_doc", "n")


_PIECES = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')"


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents),
ph AS (SELECT phrase, row_number() OVER (ORDER BY phrase) AS rank FROM (SELECT t[3] AS phrase FROM w WHERE len(t) >= 3 UNION SELECT t[5] || ' ' || t[6] FROM w WHERE len(t) >= 6 UNION SELECT t[7] || ' ' || t[8] || ' ' || t[9] FROM w WHERE len(t) >= 9)),
p AS (SELECT doc_id, {_PIECES} AS p FROM documents),
s AS (SELECT doc_id, p, unnest(range(CASE WHEN regexp_matches(p[1], '^[\\p{{L}}\\p{{N}}_]') THEN 1 ELSE 2 END, len(p) + 1, 2)) AS i FROM p WHERE len(p) > 0),
g AS (SELECT DISTINCT doc_id, r FROM (SELECT doc_id, unnest([p[i], CASE WHEN i + 2 <= len(p) THEN p[i] || p[i + 1] || p[i + 2] END, CASE WHEN i + 4 <= len(p) THEN p[i] || p[i + 1] || p[i + 2] || p[i + 3] || p[i + 4] END]) AS r FROM s)),
f AS (SELECT doc_id, phrase, rank, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS n FROM g JOIN ph ON r = phrase)
SELECT doc_id, phrase, rank FROM f WHERE n <= 15""")
def dictionary_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen phrases of a large dictionary, made of one, two and three words of every document, that each document holds."""
    from siltworks.functions.frames import ranked
    from siltworks.operators import keywords

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.regexp_extract_all(F.regexp_extract(F.lower("text"), keywords.FIRST_NINE, 0), F.lit(keywords.WORD), F.lit(0)).alias("t"))
    run = lambda first, last: F.when(F.size("t") >= last, F.array_join(F.slice("t", first, last - first + 1), " "))
    made = scratch(words.select(F.explode(F.array(run(3, 3), run(5, 6), run(7, 9))).alias("phrase")).where("phrase IS NOT NULL").distinct(), "made")  # read three times to be ranked
    return keywords.found_phrases(docs, "doc_id", "text", ranked(made, ["phrase"], "rank"))
