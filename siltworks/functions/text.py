"""Text functions as column expressions. All stay in the JVM."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The redaction pattern applied when none is configured.
DEFAULT_REDACTIONS = (r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*[^\s\n]+",)
#: What any match of a pattern holds, in a form that Java finds faster than the pattern: texts without it need not be searched for the pattern.
HELD_BY_MATCHES = {DEFAULT_REDACTIONS[0]: r"[ytndYTND]\s*[:=]"}
# Characters that Markdown output escapes.
MARKDOWN_SPECIAL = r"([\\`*_{}\[\]<>#|])"
WORD = r"[\p{L}\p{N}_]+"


def redact(text: Column, patterns: Sequence[str] = DEFAULT_REDACTIONS, held: Mapping[str, str] = HELD_BY_MATCHES) -> Column:
    """Each pattern in turn: a match keeps its first two characters, the rest becomes [REDACTED]. Patterns may not refer to groups by number.

    Most texts match none of the patterns and stay as they are, and to find that out takes a fraction of the time that replacing takes; held may name
    for a pattern a simpler one that is found wherever the pattern is.
    """
    found, out = F.lit(False), text
    for pattern in patterns:
        hit = text.rlike(pattern)
        found = found | (text.rlike(held[pattern]) & hit if pattern in held else hit)
        out = F.regexp_replace(out, rf"(?s)(?=(.{{1,2}}))(?-s:{pattern})", "$1[REDACTED]")
    return F.when(found, out).otherwise(text)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else, as NOCASE comparison folds."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_values(text: Column) -> Column:
    """Map of key=value and key="quoted value" tokens; keys in lower case, the last of equal keys wins."""
    # A match ends at a quote or before white space, so the next one starts where a word does; a word without = after it is given up at once. One pattern takes the key off the value, and the quotes if nothing but the value is between them.
    found = F.regexp_extract_all(text, F.lit(r'(?<!\w)(\w++=(?:"[^"]+"|\S+))'), F.lit(1))
    pairs = F.transform(found, lambda t: F.struct(F.lower(F.substring_index(t, "=", 1)).alias("key"), F.regexp_replace(t, r'^\w+=(?:"([^"]+)"\z)?', "$1").alias("value")))
    # A lambda's argument is worked out once, however often its body names it.
    once = F.transform(F.array(pairs), lambda ps: F.map_from_entries(F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda o: o["key"] == p["key"]))))
    return F.when(text.isNotNull(), F.element_at(once, 1))


def safe_filename(text: Column, default: str = "untitled") -> Column:
    """Letters, digits, dash, underscore, dot and space stay; white space becomes one dash; ends are trimmed."""
    # \w is a-z, A-Z, 0-9 and underscore here; Java takes thirteen times as long over the ranges written out.
    kept = F.regexp_replace(text, r"[^\w\-. ]+", "")
    dashed = F.regexp_replace(F.trim(kept), r"\s+", "-")
    trimmed = F.regexp_replace(dashed, r"^[-._ ]+|[-._ ]+$", "")
    # One chain: a condition on it would work it out twice.
    named = F.regexp_replace(trimmed, r"^\z", default.replace("\\", "\\\\").replace("$", "\\$"))
    return F.coalesce(named, F.lit(default))


def category_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def clean_title(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")))


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, MARKDOWN_SPECIAL, r"\\$1"), r"[\r\n]+", " ")


def label_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def remove_newlines(text: Column) -> Column:
    """Newlines and written-out newlines become spaces, double spaces one, twice over."""
    for old, new in (("\n", " "), ("\\n", " "), ("  ", " "), ("  ", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def preprocess_description(text: Column) -> Column:
    """Lower case, without exceptions to the end of the line, examples and punctuation."""
    text = F.regexp_replace(F.lower(text), r"\bexcept\b.*", "")
    return F.regexp_replace(F.replace(text, F.lit("e.g."), F.lit("")), r"[^\p{L}\p{N}_\s]", "")


def boost_keywords(text: Column, keywords: Sequence[str], times: int = 5) -> Column:
    """Each keyword that the text so far contains is appended times over."""
    out = text
    for keyword in keywords:
        out = F.when(F.contains(F.lower(out), F.lit(keyword.lower())), F.concat(out, F.lit(f" {keyword}" * times))).otherwise(out)
    return out


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def inject_headers(text: Column) -> Column:
    """Paragraphs apart by blank lines become a heading (first line) and a paragraph (the rest)."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: F.length(p) > 0)
    head = lambda p: F.substring_index(p, "\n", 1)
    rest = lambda p: F.substring(p, F.length(head(p)) + 1, F.length(p))
    made = F.transform(parts, lambda p: F.concat(F.lit("<h2>"), strip(head(p)), F.lit("</h2><p>"), strip(rest(p)), F.lit("</p>")))
    return F.array_join(made, "\n")


def glob_to_regex(pattern: str) -> str:
    """fnmatch rules as an anchored regex: * any run, ? one character, [] sets."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1)) >= 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def _liked(pattern: str) -> Callable[[Column], Column]:
    return lambda c: c.rlike(pattern)


def matches_any_glob(path: Column, patterns: Sequence[str]) -> Column:
    """A path matches as a whole or by any of its parts; a trailing slash means a folder on the way."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    hit = F.lit(False)
    for pattern in patterns:
        if pattern.endswith("/"):
            folder = glob_to_regex(pattern[:-1])
            hit = hit | F.exists(folders, _liked(folder))
        else:
            whole = glob_to_regex(pattern)
            hit = hit | path.rlike(whole) | F.exists(parts, _liked(whole))
    return hit


def is_test_path(path: Column) -> Column:
    """A folder test or tests, or a file test_*.py or *_test.py, in any case of letters."""
    return path.rlike(r"(?i)(^|/)tests?/") | path.rlike(r"(?i)(^|/)test_[^/]*\.py$") | path.rlike(r"(?i)(^|/)[^/]*_test\.py$")


def module_name(path: Column) -> Column:
    """Dotted module of a source path: a leading src or lib, the suffix and __init__ go."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^(src|lib)/", ""), r"\.py$", "")
    return F.regexp_replace(F.replace(bare, F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")


def visibility(name: Column) -> Column:
    return F.when(name.rlike(r"^__.*__$"), "dunder").when(name.startswith("_"), "private").otherwise("public")


def package_prefixes(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def absolute_import(module: Column, is_package: Column, level: Column, target: Column) -> Column:
    """Name that a relative import of that level means; null where it climbs above the top."""
    parts = F.split(module, r"\.")
    base = F.size(parts) - level + F.when(is_package, 1).otherwise(0)
    prefix = F.array_join(F.slice(parts, F.lit(1), F.greatest(base, F.lit(0))), ".")
    joined = F.when(F.length(F.coalesce(target, F.lit(""))) == 0, prefix).when(F.length(prefix) == 0, target).otherwise(F.concat(prefix, F.lit("."), target))
    return F.when(level == 0, target).when(base > 0, joined)


def safe_relative_path(path: Column) -> Column:
    return ~path.rlike(r"^(/|[A-Za-z]:)") & ~path.rlike(r"(^|/)\.\.(/|$)") & (F.length(path) > 0)


def masked_path(path: Column) -> Column:
    return F.concat(F.lit("[sensitive-file-"), F.substring(F.sha2(path, 256), 1, 12), F.lit("]"))


def definitions(source: Column) -> Column:
    """Names of top-level classes and functions, classes first."""
    classes = F.regexp_extract_all(source, F.lit(r"(?m)^class ([\p{L}\p{N}_]+)"), F.lit(1))
    return F.concat(classes, F.regexp_extract_all(source, F.lit(r"(?m)^def ([\p{L}\p{N}_]+)"), F.lit(1)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_frequencies(docs: DataFrame, key: str, text: str, stop_words: DataFrame | None = None) -> DataFrame:
    """(word, n, first_key, first_pos): how often each word occurs and where first. Counting is combined before the shuffle."""
    exploded = docs.select(F.col(key).alias("k"), F.posexplode(words(F.col(text))).alias("pos", "word"))
    if stop_words is not None:
        exploded = exploded.join(stop_words, "word", "left_anti")
    counted = exploded.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "pos")).alias("first"))
    return counted.select("word", "n", F.col("first.k").alias("first_key"), F.col("first.pos").alias("first_pos"))


def chunk_sentences(text: Column, most: int, compat: bool = False) -> Column:
    """Sentences (split at ". ") packed in order into chunks of at most most words.

    compat drops sentences longer than most and the chunk still open at the end, as the tool this replaces did; otherwise a long
    sentence is a chunk by itself and the last chunk is kept.
    """
    count = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: F.length(w) > 0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, sentence: Column) -> Column:
        n = count(sentence)
        full = acc["n"] + n > most
        done = F.when(full & (acc["n"] > 0), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        fresh = F.struct(done.alias("done"), sentence.alias("open"), n.alias("n"))
        more = F.struct(acc["done"].alias("done"), F.when(acc["n"] > 0, F.concat(acc["open"], F.lit(". "), sentence)).otherwise(sentence).alias("open"), (acc["n"] + n).alias("n"))
        kept = F.when(full, fresh).otherwise(more)
        if compat:
            drop = F.struct(done.alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
            return F.when(F.lit(n > most), drop).otherwise(kept) if isinstance(n, int) else F.when(n > most, drop).otherwise(kept)
        return kept

    finish = (lambda acc: acc["done"]) if compat else (lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.aggregate(F.split(text, r"\. "), start, step, finish)


def sector_code(code: Column) -> Column:
    """The first two characters."""
    return F.substring(code.cast("string"), 1, 2)


def url_slug(url: Column) -> Column:
    """The last part of the path, safe for file names and 80 characters at most, with a short digest of the whole address."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    kept = F.substring(F.regexp_replace(F.when(last == "", "index").otherwise(last), r"[^a-zA-Z0-9._-]+", "_"), 1, 80)
    return F.concat(F.when(kept == "", "page").otherwise(kept), F.lit("-"), short_digest(url))


@F.pandas_udf(StringType())
def short_digest(text: pd.Series) -> pd.Series:
    """BLAKE2s of 8 bytes; no built-in function has it."""
    return text.map(lambda t: None if t is None else hashlib.blake2s(t.encode(), digest_size=8).hexdigest())
