"""Small record operators: posts to training rows, detail lines, categories by substring, presets, section extraction, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of each preset; js stands for javascript.
PRESETS: Mapping[str, tuple[str, ...]] = {
    "python": (".py",), "javascript": (".js", ".jsx", ".ts", ".tsx"), "web": (".html", ".css", ".js"), "docs": (".md", ".rst", ".txt"), "config": (".json", ".toml", ".yaml", ".yml", ".ini"),
}
ALIASES = {"js": "javascript"}


def training_rows(blogs: DataFrame, posts: str, title: str, content: str) -> DataFrame:
    """(title, before, after) for each nested post that has both a title and a content."""
    rows = blogs.select(F.explode(posts).alias("p")).select(F.col(f"p.{title}").alias("title"), F.col(f"p.{content}").alias("after"))
    return rows.where("title IS NOT NULL AND after IS NOT NULL").select("title", F.lit("").alias("before"), "after")


def detail_line(columns: Sequence[str], separator: str = "~") -> Column:
    """Fields of a record in one line; a missing one is empty."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def categorised(rows: DataFrame, text: str, rules: Mapping[str, Sequence[str]], default: str = "Uncategorized") -> DataFrame:
    """One row per category whose words the text contains, or the default. Rules are literals, so nothing is joined."""
    low = F.lower(F.col(text))
    hits = [F.when(F.greatest(*[F.contains(low, F.lit(w.lower())) for w in words], F.lit(False)), F.lit(name)) for name, words in rules.items()]
    found = F.array_compact(F.array(*hits))
    return rows.withColumn("category", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))))


def second_part_class(name: Column, classes: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """Class of the second part of a dashed name."""
    part = F.try_element_at(F.split(name, "-"), F.lit(2))
    out = F.lit(default)
    for label, values in classes.items():
        out = F.when(part.isin(*values), label).otherwise(out)
    return out


def preset_suffixes(name: str) -> tuple[str, ...]:
    key = ALIASES.get(name, name)
    if key not in PRESETS:
        raise ValueError(f"unknown preset: {name}")
    return PRESETS[key]


def in_preset(path: Column, name: str) -> Column:
    hit = F.lit(False)
    for suffix in preset_suffixes(name):
        hit = hit | F.endswith(path, F.lit(suffix))
    return hit


def labelled_sections(text: Column, labels: Sequence[str]) -> dict[str, Column]:
    """What stands between each label (with a colon) and the next one or the end; empty where the label is missing."""
    stop = "|".join(rf"{x}:" for x in labels)
    return {x: F.trim(F.regexp_extract(text, rf"(?s){x}:\s*(.*?)(?={stop}|\z)", 1)) for x in labels}


def medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median, least and most of repeated measurements."""
    return rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))


def fixed_interval_schedule(rows: DataFrame, key: str, order: Sequence[str], interval: float) -> DataFrame:
    """Seconds after the first request at which each request of a key may start under a fixed interval."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("starts_after", place * F.lit(interval))


def overview(counts: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of several tables in one row per name."""
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
