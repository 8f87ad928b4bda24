"""The corpus pipeline: quality rules, near duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared checkpoint
folder, drops what the stage wrote on its way and the stage's own input, and reads the result back as the next one's documents.

For all stages: docs has the columns doc_id, text, lang, source and n_chars; further columns, whatever their names, are carried by all but the last
stage. Texts are read whole, however long. An empty table gives an empty one. Rows that repeat, or share a doc_id, are rows of their own
unless a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import mixing, neardup, packing, passages, rules
from siltworks.session import drop_scratch, drop_scratch_since, scratch, scratch_paths, table


_tables: frozenset[str] = frozenset()


def _stage(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that first deletes the scratch tables of the stage called before it, unless docs still reads them (its result was not written yet)."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _tables
        if _tables:
            read = docs.inputFiles()
            mine = {path.removeprefix("file://") for path in _tables}
            if not any(path in file for path in mine for file in read):
                drop_scratch_since(scratch_paths() - _tables, docs)
        before = scratch_paths()
        out = work(spark, docs, sf_dir)
        _tables = scratch_paths() - before
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go. Null and empty texts fail the base. A null lang is a language of its own; without
    labels, and for languages without any, the base alone rejects. A score equal to its cutoff is kept. Repeated rows are judged each by itself."""
    return rules.keep_documents(docs, table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of least doc_id. Null and empty texts and rows with a null doc_id all stay. Rows of
    equal doc_id are one document and stay or go together. A pair at exactly the similarity is linked."""
    return neardup.keep_first(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of smaller doc_id holds are cut out, and n_chars is counted anew. A document that loses all its
    words goes; null and empty texts stay as they are. Rows with a null doc_id lose nothing and are no evidence; rows of equal doc_id are no
    evidence against each other."""
    return passages.cut_documents(docs)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights by repeating and thinning out their words; n_chars is counted anew. Null sources are one source,
    last in order. A document of which nothing is taken, null and empty texts among them, goes. Equal quotients go to what comes first."""
    return mixing.mixed_documents(docs)


@_stage
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What remains is tokenised and packed into sequences: one row per piece. Null and empty texts are a document of the end id alone; a null doc_id
    stays null; of bins with equal free space the last one used is taken."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Automata, signatures and token ids are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = scratch_paths()
        made = scratch(stage(spark, docs, sf_dir), name)
        drop_scratch_since(before, made)
        drop_scratch(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
