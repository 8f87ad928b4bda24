"""Quality rules whose cutoffs come with a bound on false rejection.

Each rule rejects a document whose score lies above a cutoff of its stratum (its language). On labelled documents
known to be good, cutoffs are tried from lenient to strict; a cutoff is certified when the exact binomial test refutes a
false-rejection rate above RISK at the corrected level. Testing in a fixed order needs no correction along the cutoffs (the
first failure ends it); the level is divided by the number of rules times tests (Bonferroni), one test for each stratum and one for all
strata pooled. So with probability 1 - ERROR no certified cutoff rejects more than RISK of the good documents of its stratum, whichever of
them is taken. Taken is the one that rejects the most labelled low documents less good ones, the most lenient if several do; a rule that
gains nothing rejects nothing.

A stratum whose good labels are too few to certify any cutoff, even without a false rejection (fewer than about 320 with four strata), takes the
cutoffs certified on the pool, as far as its own labels do not refute them. Their bound is RISK over the good documents of all strata together; for
a stratum with a share w of the good labels that is RISK / w at most. Where the pool too has too few labels, the rules reject nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.textstats import COUNTS, text_counts
from siltworks.llm.wordhash import encoded, slices
from siltworks.session import scratch, ship_package

#: Most false rejections of good documents by one rule in one stratum, and the chance that any bound fails.
RISK = 0.02
ERROR = 0.05
MIN_WORDS = 20

#: Rules and their cutoffs, lenient to strict.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "duplicate_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeated_word_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "punctuation_share": (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12),
    "top_word_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25),
}


def _per(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(0.0))


def rule_scores() -> dict[str, Column]:
    """Higher is worse."""
    return {
        "symbols_per_word": _per("n_symbols", "n_words"),
        "duplicate_line_share": _per("n_dup_lines", "n_lines"),
        "repeated_word_share": _per("n_repeat_words", "n_words"),
        "upper_share": _per("n_upper", "word_chars"),
        "punctuation_share": _per("n_punct", "word_chars"),
        "top_word_share": F.when(F.col("n_words") >= MIN_WORDS, _per("top_word", "n_words")).otherwise(0.0),
    }


def measure(docs: DataFrame, carry: tuple[str, ...] = ("lang",)) -> DataFrame:
    """doc_id, the carried columns and COUNTS for every whole text; null text counts as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = text_counts(encoded(batch.column("text").to_pylist()))
            columns = [batch.column(c) for c in ("doc_id", *carry)] + [pa.array(counts[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *carry, *COUNTS])

    ship_package(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)) + "".join(f", {c} long" for c in COUNTS)
    return docs.select("doc_id", *carry, "text").mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def tail_probability(n: int, failures: int, risk: float) -> float:
    """P(Bin(n, risk) <= failures), exactly summed; 1 where failures reach the mean."""
    if n == 0 or failures >= n * risk:
        return 1.0
    return _at_most(n, failures, risk)


def _at_most(n: int, failures: int, risk: float) -> float:
    k = np.arange(failures + 1, dtype=float)
    steps = np.log(np.maximum(n - k[:-1], 1)) - np.log(k[:-1] + 1) + math.log(risk) - math.log1p(-risk)
    logs = n * math.log1p(-risk) + np.concatenate(([0.0], np.cumsum(steps)))
    top = logs.max()
    return float(math.exp(top) * np.exp(logs - top).sum())


def certified(n: int, failures: list[int], risk: float, level: float) -> int:
    """How many cutoffs, lenient to strict, come before the first that the test cannot certify."""
    for k, failed in enumerate(failures):
        if tail_probability(n, failed, risk) > level:
            return k
    return len(failures)


def unrefuted(n: int, failures: list[int], risk: float, level: float) -> int:
    """How many cutoffs come before the first at which these labels show more than risk."""
    for k, failed in enumerate(failures):
        if failed and 1 - _at_most(n, failed - 1, risk) <= level:
            return k
    return len(failures)


def best_cutoff(cutoffs: tuple[float, ...], good: list[int], low: list[int]) -> float | None:
    """The cutoff that rejects the most low documents less good ones, the first of several; None where none gains anything."""
    gains = [b - g for g, b in zip(good, low, strict=True)]
    top = max(gains, default=0)
    return cutoffs[gains.index(top)] if top > 0 else None


def cutoff_of(row: dict, rule: str, risk: float, level: float) -> float | None:
    """The cutoff of a rule in a stratum: by its own labels where they are enough to certify any, else by the pool's. row holds n and n_pool good
    labels and, per rule, how many good and low ones each cutoff rejects (rule_good, rule_low, rule_good_pool, rule_low_pool)."""
    own, cuts = row[f"{rule}_good"], CUTOFFS[rule]
    if tail_probability(row["n"], 0, risk) <= level:
        k = certified(row["n"], own, risk, level)
        return best_cutoff(cuts, own[:k], row[f"{rule}_low"][:k])
    pool = row[f"{rule}_good_pool"]
    k = min(certified(row["n_pool"], pool, risk, level), unrefuted(row["n"], own, risk, level))
    return best_cutoff(cuts, pool[:k], row[f"{rule}_low_pool"][:k])


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, one cutoff column per rule, null where the rule rejects nothing). Counts over all labelled rows that the base leaves; labels that
    repeat or contradict each other count as good only if all say so, and null labels as none. One row per stratum is all that reaches the tests."""
    scores = rule_scores()
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q IN (0, 1)")
    rows = measured.where(~base_failed()).join(known, "doc_id")
    good, low = F.col("q") == 1, F.col("q") == 0
    kinds = {f"{r}_{kind}": [(scores[r] > c) & is_kind for c in cuts] for r, cuts in CUTOFFS.items() for kind, is_kind in (("good", good), ("low", low))}
    counts = rows.groupBy(F.coalesce(F.col(stratum), F.lit("")).alias("stratum")).agg(
        F.count_if(good).alias("n"), *[F.array(*map(F.count_if, tests)).alias(k) for k, tests in kinds.items()]
    )
    counts = scratch(counts, "strata")
    strata = max(1, counts.count())
    level = error / (len(CUTOFFS) * (strata + (strata > 1)))
    pool = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pool"),
        *[F.array(*[F.coalesce(F.sum(F.col(k)[i]), F.lit(0)) for i in range(len(tests))]).alias(f"{k}_pool") for k, tests in kinds.items()],
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist(
                [{"stratum": r["stratum"]} | {k: cutoff_of(r, k, risk, level) for k in CUTOFFS} for r in batch.to_pylist()],
                pa.schema([("stratum", pa.string()), *((k, pa.float64()) for k in CUTOFFS)]),
            )

    return counts.crossJoin(F.broadcast(pool)).mapInArrow(test, "stratum string" + "".join(f", {k} double" for k in CUTOFFS))


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    rejected_by lists the rules that reject, "base" among them. Null or empty texts have no words and fail the base. Texts are counted whole, however
    long. A null stratum is a stratum of its own (that of the empty string), and in one without labels the base alone rejects. A score equal to its
    cutoff is kept. Rows that repeat are judged, and counted for the cutoffs, each by itself; an empty table gives no rows, and without labels
    the base alone rejects. Other columns of docs are ignored, whatever their names.
    """
    measured = scratch(measure(docs.select("doc_id", F.col(stratum).cast("string").alias("stratum_"), "text"), ("stratum_",)), "measured")
    cuts = scratch(thresholds(measured, labels, "stratum_"), "cutoffs")
    return _judged(measured, cuts).select(
        "doc_id",
        *COUNTS[:5],
        base_failed().alias("base_failed"),
        (F.size("reasons") == 0).alias("kept"),
        F.concat_ws(",", "reasons").alias("rejected_by"),
    )


def _judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured with reasons, the rules that reject. cuts is a written table, so Spark knows that its few rows can be broadcast."""
    own = cuts.select(F.col("stratum").alias("own_stratum"), *[F.col(k).alias(f"cut_{k}") for k in CUTOFFS])
    rejects = [F.when(score > F.col(f"cut_{rule}"), F.lit(rule)) for rule, score in rule_scores().items()]
    joined = measured.join(own, F.coalesce(F.col("stratum_"), F.lit("")) == F.col("own_stratum"), "left")
    return joined.withColumn("reasons", F.array_compact(F.array(F.when(base_failed(), F.lit("base")), *rejects)))


def keep_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns; verdicts() states the cases. Rows are counted once, where they are scanned,
    and wait for the cutoffs in a table, so repeated rows and ids are no matter."""
    names = docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = text_counts(encoded(batch.column("d_text").to_pylist()))
            columns = [*batch.columns, *(pa.array(counts[:, i]) for i in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *COUNTS])

    ship_package(docs.sparkSession)
    held = docs.select(*[F.col(f"`{n}`").alias(f"d_{n}") for n in names], F.col("doc_id"), F.col(stratum).cast("string").alias("stratum_"))
    schema = ", ".join(f"`{n}` {t}" for n, t in held.dtypes) + "".join(f", {c} long" for c in COUNTS)
    measured = scratch(held.mapInArrow(count, schema), "measured")
    cuts = scratch(thresholds(measured, labels, "stratum_"), "cutoffs")
    return _judged(measured, cuts).where(F.size("reasons") == 0).select(*[F.col(f"`d_{n}`").alias(n) for n in names])
