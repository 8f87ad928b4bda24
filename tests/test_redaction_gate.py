"""Redaction searches before it replaces: texts without a match are left alone, and the result is that of replacing in turn."""

import re

from pyspark.sql import functions as F
from siltworks.functions import text as T
from siltworks.plans import text_queries

TEXTS = (
    None, "", "x", "plain words: nothing = here", "API-KEY = abc and toKen:\n z", "mail me: a.b@example.org, or c@d", "10.20.30.40 and 1.2.3", "f" * 40, "tail secret=", "password = x",
    "key 0123456789abcdef0123456789abcdef token=0123456789abcdef0123456789abcdef", "\n" + "ab" * 20, "se\ncret: y",
)


def _in_turn(text, patterns):
    for p in patterns:
        text = re.sub(f"(?a:{p.removeprefix('(?i)')})", lambda m: m[0][:2] + "[REDACTED]", text, flags=re.I if p.startswith("(?i)") else 0)
    return text


def test_texts_are_searched_before_they_are_redacted(spark):
    patterns = (*T.DEFAULT_REDACTIONS, *text_queries._PATTERNS)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.r for r in rows.select("i", T.redact(F.col("t"), patterns, text_queries._HELD).alias("r")).collect()}
    assert got == {i: None if t is None else _in_turn(t, patterns) for i, t in enumerate(TEXTS)}
    # What a match is said to hold is looked for first: with a condition that no text meets, nothing is replaced.
    none = rows.select(F.count_if(T.redact(F.col("t"), patterns, dict.fromkeys(patterns, r"\A\b\z")) != F.col("t")).alias("n")).first()
    assert none.n == 0
