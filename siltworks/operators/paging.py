"""Reading evidence tables: allow-listed filters, search, sort, pages, facets and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.text import lower_ascii

MOST_PAGE_SIZE = 200
MOST_SEARCH_CHARS = 200
MOST_IDS = 100


def equals(filters: Mapping[str, object]) -> Column:
    """All given values, where they are set."""
    out = F.lit(True)
    for name, value in filters.items():
        if value not in (None, ""):
            out = out & (F.col(name) == F.lit(value))
    return out


def like_anywhere(columns: Sequence[str], needle: str) -> Column:
    """Case-insensitive (ASCII) substring in any column; wildcards in the needle mean themselves."""
    if len(needle) > MOST_SEARCH_CHARS:
        raise ValueError("search is too long")
    low = lower_ascii(F.lit(needle))
    out = F.lit(False)
    for name in columns:
        out = out | F.contains(lower_ascii(F.col(name)), low)
    return out


def one_of(column: str, values: Sequence[object], most: int = MOST_IDS) -> Column:
    if len(values) > most:
        raise ValueError(f"at most {most} values")
    return F.col(column).isin(list(values))


def no_case(column: str) -> Column:
    return lower_ascii(F.col(column))


def ordering(sort: str, direction: str, allowed: Mapping[str, Column], tie: str, flip_tie: bool = False) -> list[Column]:
    """Sort keys from an allow list. The tie-break ascends unless flip_tie, when it follows the direction."""
    if sort not in allowed or direction not in ("asc", "desc"):
        raise ValueError("unknown sort or direction")
    key = allowed[sort]
    down = direction == "desc"
    return [key.desc_nulls_last() if down else key.asc_nulls_first(), F.col(tie).desc() if down and flip_tie else F.col(tie).asc()]


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int, most: int = MOST_PAGE_SIZE) -> DataFrame:
    """Page number (from 1). A sort with a limit stays a top-k in the plan."""
    if number < 1 or not 1 <= size <= most:
        raise ValueError("page out of range")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def truncated_page(rows: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """The first size rows, each marked whether there was one more."""
    probe = rows.orderBy(*order).limit(size + 1)
    mark = Window.orderBy(*order)
    whole = mark.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return probe.withColumn("pg_n", F.row_number().over(mark)).withColumn("truncated", F.count(F.lit(1)).over(whole) > size).where(F.col("pg_n") <= size).drop("pg_n")


def facet(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values that are set, with how many rows have each."""
    return rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram_over(rows: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts for each value of a fixed domain, zero where there is none; one aggregate row, unpivoted."""
    row = rows.agg(*[F.count_if(F.col(column) == v).alias(f"v{i}") for i, v in enumerate(domain)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"v{i}").alias("n")) for i, v in enumerate(domain)])).alias("s")).select("s.*")


def flagged_sum(condition: Column) -> Column:
    """How often a condition holds; unknown counts as no, no rows as 0."""
    return F.coalesce(F.count_if(condition), F.lit(0))


def derived_status(state: Column, review: Column) -> Column:
    return F.when(state == "resolved", "resolved").otherwise(review)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def high_signal(family: Column, severity: Column, confidence: Column, measured: Sequence[str]) -> Column:
    """Cycles always; measured families from medium on in severity and confidence."""
    cycles = family.isin("dependency-cycle", "inheritance-cycle")
    strong = severity.isin("high", "medium") & confidence.isin("high", "medium")
    return cycles | (family.isin(*measured) & strong)
