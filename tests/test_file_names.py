"""File names are made in one chain of replacements."""

import re

from pyspark.sql import functions as F
from siltworks.functions import text as T


def test_safe_filename_like_python_and_once(spark):
    texts = ["a b\t c", "", " ._-", "Ünï_x-1.y (2)", "中文", "x\n\ny ", "-a--b-", "\n", None]

    def want(t):
        kept = re.sub(r"\s+", "-", re.sub(r"[^a-zA-Z0-9\-_. ]", "", t or "").strip(" "))
        return re.sub(r"^[-._ ]+|[-._ ]+$", "", kept) or r"a$1\b"

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.safe_filename(F.col("t"), r"a$1\b").alias("f"))
    assert [r["f"] for r in rows.collect()] == [want(t) for t in texts]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"regexp_replace\(", plan)) == 4 and "case when" not in plan.lower()
