"""Exact token counts from a histogram of encoded lengths.

Documents are reduced to (length, count) where they are scanned, so what is shuffled is one row per distinct length
and task. Suffix sums over the histogram answer, for every context limit, how many documents reach it, how many
tokens there are in all and how many remain when each document is cut at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.tokens import encoder, tokenizer_path
from siltworks.session import scratch, ship_package

#: Lengths of one bucket of the two-level sums.
BUCKET = 4096


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length. Null and empty texts have length 0."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, total = encoder(path), {}
        for batch in batches:
            for text in batch["text"]:
                n = len(coder.ids(text)) // 4 if text else 0
                total[n] = total.get(n, 0) + 1
            if len(total) > 100_000:
                yield pd.DataFrame({"n_tokens": list(total), "n_docs": list(total.values())})
                total = {}
        yield pd.DataFrame({"n_tokens": np.array(list(total), np.int64), "n_docs": np.array(list(total.values()), np.int64)})

    ship_package(docs.sparkSession)
    partial = docs.select("text").mapInPandas(count, "n_tokens long, n_docs long")
    return partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram taken as a context limit: docs_at_least (length >= L), tokens_at_least (their
    tokens), docs_below_share (of all documents, those shorter than L), tokens_total (all), and truncated_total
    (the sum of min(length, L)). Between two lengths of the histogram truncated_total is linear, so these rows answer every limit.

    Sums go in two levels, within buckets of BUCKET lengths and over bucket totals, so no task sees every length.
    """
    rows = histogram.select(
        F.floor(F.col("n_tokens") / BUCKET).alias("bucket"), "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens")
    )
    totals = rows.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    later = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = totals.select(
        "bucket",
        F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("above_docs"),
        F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("above_tokens"),
        F.sum("b_docs").over(everything).alias("docs_total"),
        F.sum("b_tokens").over(everything).alias("tokens_total"),
    )
    here = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc())
    summed = (
        rows.join(above, "bucket")
        .withColumn("docs_at_least", F.sum("n_docs").over(here) + F.col("above_docs"))
        .withColumn("tokens_at_least", F.sum("tokens").over(here) + F.col("above_tokens"))
    )
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        "docs_total",
        "tokens_total",
        (1 - F.col("docs_at_least") / F.col("docs_total")).alias("docs_below_share"),
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
    )


def truncated_totals(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """(context_limit, truncated_total) for each limit of a table of limits: the nearest length at or above answers it. A limit above the longest
    document cuts nothing, so all tokens remain; without documents there are none. A null limit has no answer."""
    nearest = limits.select("context_limit").distinct().join(sums, F.col("n_tokens") >= F.col("context_limit"), "left")
    cut = nearest.groupBy("context_limit").agg(
        F.min_by(
            F.col("tokens_total") - F.col("tokens_at_least") + F.col("context_limit") * F.col("docs_at_least"), F.col("n_tokens")
        ).alias("cut")
    )
    uncut = sums.agg(F.coalesce(F.max("tokens_total"), F.lit(0)).alias("uncut"))
    total = F.when(F.col("context_limit").isNotNull(), F.coalesce("cut", "uncut"))
    return cut.crossJoin(F.broadcast(uncut)).select("context_limit", total.alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of documents does not exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    upto = sums.withColumn("upto", F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs"))
    hit = wanted.join(upto, F.col("upto") >= F.col("share") * F.col("docs_total"))
    return hit.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The histogram with its suffix sums.

    Null and empty texts have length 0. Texts are encoded whole, however long. Documents of equal length are one row, and repeated rows count as
    often as they come; doc_id and all other columns, null or not and whatever their names, are ignored. An empty table gives no rows.
    """
    return suffix_sums(scratch(length_histogram(docs, path), "lengths"))
