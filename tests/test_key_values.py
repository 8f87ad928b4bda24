"""Values of keys, with and without quotes; words without a value cost one pass."""

from pyspark.sql import functions as F
from siltworks.functions import text as T


def test_key_values_with_odd_quotes(spark):
    lines = ['a="x y" B=1 b=2', 'a="" b="q"r c="', "k=$1\\ =x __=é", 'a="x\ny" w', "x" * 200_000 + " z=1", "", None]
    want = [{"a": "x y", "b": "2"}, {"a": '""', "b": "q", "c": '"'}, {"k": "$1\\", "__": "é"}, {"a": "x\ny"}, {"z": "1"}, {}, None]
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select(T.key_values(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in rows] == want
