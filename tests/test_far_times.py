"""Local times of years that have five digits."""

from pyspark.sql import functions as F
from siltworks.functions import values as V


def test_local_times_beyond_the_year_9999(spark):
    seconds = [0, 86400 * 90_000, 253402300800 + 5 * 3600, 86400 * 8_999_999, None]
    rows = spark.createDataFrame([(s,) for s in seconds], "s long").select(V.local_time(F.col("s"), "America/New_York").alias("t")).collect()
    assert [r["t"] for r in rows] == ["1969-12-31 19:00:00", "2216-05-30 20:00:00", "10000-01-01 00:00:00", "26611-02-28 19:00:00", None]
