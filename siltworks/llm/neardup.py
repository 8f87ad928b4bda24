"""Near-duplicate documents by MinHash bands, sequential Bayesian verification and exact confirmation.

Rows of equal shingle sets are one class, known by its least doc_id. Class signatures are banded, and buckets give pairs of classes to compare. A
pair's signatures are compared a batch at a time, and it is given up as soon as the posterior chance of reaching the similarity falls below MISS;
survivors are confirmed on the full sets. Links make components, which are all that is asked for, so a bucket need not give all its pairs:

1. Its classes are compared with a pivot, the class that shares most buckets with most others.
2. What the links so far leave in several components is open. If few classes lie outside the largest of them, those are compared with all open
   classes of other components.
3. Classes of buckets with many such classes (unlike texts around one common passage, say) get finer buckets, which lose no pair: the shingles
   that come first in each set, rarest first. Sets of n and m shingles that reach the similarity s have at least a = ceil(s / (1 + s) (n + m)) in
   common, so one of the first n - a + 1 of the one is among the first m - a + 1 of the other (the prefix rule of PPJoin). A shingle's place in
   a set thus bounds the size of the sets with which it can be that one. Buckets of shingles are settled by a pivot too; then their open pairs
   whose sizes the places allow are compared.

Every pair goes through the signatures first, then the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.wordhash import Words, blocks, encoded, mix, slices, windows
from siltworks.operators.links import components
from siltworks.session import scratch, ship_package

SHINGLE_WORDS = 4
#: Least similarity in percent.
SIMILAR = 80
#: A pair at the least similarity shares no band with probability (1 - 0.8**4)**28 = 4e-7.
BANDS, BAND_ROWS = 28, 4
HASHES = BANDS * BAND_ROWS
#: Hashes of one comparison step, and the posterior chance of reaching the similarity below which a pair is given up.
BATCH, MISS = 16, 1e-7
#: Most classes outside the largest component of a bucket that are compared with all others there; buckets with more are cut finer.
FEW = 8

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text with fewer words is one shingle, one without words has none."""
    out: list[np.ndarray] = []
    for _, block in blocks(texts):
        words = Words(block, lower=True)
        grams = windows(words.hashes, width)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            else:
                out.append(windows(words.hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minimum hashes of 32 bits for each set; sets must not be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) < 200_000):
            size += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[first : last - 1]]))).astype(np.int64)
        for j, factor in enumerate(_FACTORS):
            out[first:last, j] = np.minimum.reduceat((flat * factor) >> np.uint64(32), starts)
        first = last
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sigs), BANDS))
    parts = sigs.reshape(len(sigs), BANDS, BAND_ROWS).astype(np.uint64)
    for i in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys.view(np.int64)


def _least_matches(batch: int = BATCH, miss: float = MISS) -> np.ndarray:
    """For each prefix of whole batches the fewest matches with P(similarity >= SIMILAR% | matches) >= miss, under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), and its upper tail at s is the binomial sum P(Bin(n + 1, s) <= m)."""
    out = []
    s = SIMILAR / 100
    for n in range(batch, HASHES + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


LEAST = _least_matches()


def survives(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature tables stay above every bound; those given up are not compared further."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for step, least in enumerate(LEAST):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def hash_of(held: bytes) -> int:
    """64 bits of a set, the same on every machine."""
    return int.from_bytes(hashlib.blake2b(held, digest_size=8).digest(), "little", signed=True)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both) and both > 0


def shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) per row; set_key and signature are null where the set is empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(encoded(batch.column("text").to_pylist()))
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            some = [s for s in sets if len(s)]
            made = iter(signatures(some)) if some else iter(())
            sigs = [next(made).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "signature"],
            )

    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(make, "doc_id long, n_shingles long, set_key binary, signature binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, rep) for buckets of two classes or more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sigs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, HASHES)
            keys = band_keys(sigs).ravel() if n else np.empty(0, np.int64)
            reps = np.repeat(np.asarray(batch.column("rep").to_numpy(zero_copy_only=False), np.int64), BANDS)
            for at in range(0, len(keys), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(reps[part])], ["bucket", "rep"])

    rows = scratch(classes.select("rep", "signature").mapInArrow(cut, "bucket long, rep long"), "bands")
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("bucket")
    return rows.join(shared, "bucket", "left_semi")


class _Sets:
    """Full shingle sets of the classes asked for so far, each made once from its text."""

    def __init__(self, docs: DataFrame):
        self.texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
        self.table: DataFrame | None = None

    def of(self, reps: DataFrame, tag: str) -> DataFrame:
        """(rep, shingles) for at least the given reps."""
        new = reps.select("rep").distinct()
        if self.table is not None:
            new = new.join(self.table.select("rep"), "rep", "left_anti")

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                sets = shingle_sets(encoded(batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

        # Always a merge join: the ids grow with the table, and the plan should be the same at every size.
        made = scratch(self.texts.join(new.hint("merge"), "rep", "left_semi").mapInArrow(make, "rep long, shingles binary"), f"sets{tag}")
        self.table = made if self.table is None else self.table.unionByName(made)
        return self.table


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: _Sets, tag: str) -> DataFrame:
    """Those of pairs (a, b) that reach the similarity: first by their signatures, then by the full sets."""
    sigs = classes.select("rep", "signature")
    with_a = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
    with_both = with_a.join(sigs.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(n, HASHES) for c in ("sa", "sb"))
                keep = pa.array(survives(a, b))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    alive = scratch(with_both.select("a", "b", "sa", "sb").mapInArrow(prune, "a long, b long"), f"alive{tag}")
    full = sets.of(alive.select(F.explode(F.array("a", "b")).alias("rep")), tag)
    left = alive.join(full.select(F.col("rep").alias("b"), F.col("shingles").alias("tb")), "b")
    whole = left.join(full.select(F.col("rep").alias("a"), F.col("shingles").alias("ta")), "a")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=_LINK)

    return scratch(whole.select("a", "ta", "b", "tb").mapInArrow(confirm, "a long, b long").distinct(), f"links{tag}")


def _pivot_pairs(buckets: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """((bucket, pivot), distinct pairs of each class with its buckets' pivots)."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    central = buckets.join(sizes, "bucket").groupBy("rep").agg(F.sum("n").alias("weight"))
    best = F.min(F.struct(-F.col("weight"), F.col("rep")))["rep"]
    pivots = scratch(buckets.join(central, "rep").groupBy("bucket").agg(best.alias("pivot")), f"pivots{tag}")
    paired = buckets.join(pivots, "bucket").where("rep <> pivot")
    pairs = paired.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    return pivots, pairs


def _open(buckets: DataFrame, pivots: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """buckets without their pivots, with the part (component so far) of each class, the largest part of its bucket and how many classes lie outside
    that; only buckets with several parts."""
    parts = components(links)
    rest = buckets.join(pivots, "bucket").where("rep <> pivot").drop("pivot")
    placed = scratch(rest.join(parts, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep")).drop("node", "component"), f"open{tag}")
    counts = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("k"))
    whole = counts.groupBy("bucket").agg(F.max(F.struct("k", "part")).alias("top"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("parts"))
    several = whole.where("parts > 1").select("bucket", F.col("top.part").alias("largest"), (F.col("n") - F.col("top.k")).alias("outside"))
    return placed.join(several, "bucket")


def _open_pairs(opened: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Distinct pairs of open classes of one bucket and of different parts, as far as allowed(x, y)."""
    x, y = opened.where("part <> largest").alias("x"), opened.alias("y")
    met = x.join(y, F.col("x.bucket") == F.col("y.bucket")).where(
        (F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("x.largest")) | (F.col("x.rep") < F.col("y.rep")))
    )
    if allowed is not None:
        met = met.where(allowed)
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).where("a < b").distinct()


def _first_shingles(reps: DataFrame, sets: _Sets) -> DataFrame:
    """(bucket, rep, n, most): the shingles that may be the first common one of a class and a similar one, rarest first among these classes; most is
    the size up to which the other may then be. Rows that no other size of their bucket allows are left out."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for rep, held in zip(batch.column("rep").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                own = np.frombuffer(held, np.int64)
                for at in range(0, len(own), 50_000):
                    part = own[at : at + 50_000]
                    same = lambda v, k=len(part): pa.array(np.full(k, v, np.int64))
                    yield pa.RecordBatch.from_arrays([same(rep), same(hash_of(held)), same(len(own)), pa.array(part)], ["rep", "whole", "n", "bucket"])

    full = sets.of(reps, "hot").join(reps.select("rep").distinct(), "rep", "left_semi")
    rows = scratch(full.select("rep", "shingles").mapInArrow(spread, "rep long, whole long, n long, bucket long"), "spread")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    one = Window.partitionBy("rep", "whole", "n")
    met = rows.join(shared, "bucket").withColumn("place", F.row_number().over(one.orderBy("df", "bucket")) + F.col("n") - F.count(F.lit(1)).over(one))
    largest = F.expr(f"least({100 + SIMILAR} * (n - place + 1) DIV {SIMILAR} - n, 100 * n DIV {SIMILAR})")
    kept = met.withColumn("most", largest).where(100 * F.col("most") >= SIMILAR * F.col("n")).groupBy("bucket", "rep", "n").agg(F.max("most").alias("most"))
    kept = scratch(kept, "places")
    sizes = kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1")
    fits = scratch(kept.join(sizes, "bucket").where("most >= least").select("bucket", "rep", "n", "most"), "fits")
    useful = fits.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket")
    return fits.join(useful, "bucket", "left_semi")


def _links_of(buckets: DataFrame, classes: DataFrame, sets: _Sets) -> DataFrame:
    """Links that join all classes which similar pairs of any bucket join."""
    pivots, pairs = _pivot_pairs(buckets, "")
    links = _confirmed(scratch(pairs, "pairs"), classes, sets, "pivot")
    opened = scratch(_open(buckets, pivots, links, ""), "several")
    pairs = _open_pairs(opened.where(F.col("outside") <= FEW))
    crowded = opened.where(F.col("outside") > FEW).select("rep").distinct()
    if crowded.isEmpty():
        return links.unionByName(_confirmed(scratch(pairs, "pairs"), classes, sets, "few"))
    finer = scratch(_first_shingles(crowded, sets), "finer")
    pivots, more = _pivot_pairs(finer.select("bucket", "rep").distinct(), "finer")
    links = links.unionByName(_confirmed(scratch(pairs.unionByName(more).distinct(), "pairs"), classes, sets, "few"))
    fits = (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    pairs = _open_pairs(scratch(_open(finer, pivots, links, "finer"), "several"), fits)
    return links.unionByName(_confirmed(scratch(pairs, "pairs"), classes, sets, "rest"))


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of shingled(docs), classes with their set_key and component)."""
    rows = scratch(shingled(docs), "shingles")
    some = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # Rows that share a doc_id are one document: their classes have one name, and any of them may be compared.
    classes = scratch(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "classes")
    buckets = scratch(_buckets(classes), "buckets")
    parts = scratch(components(_links_of(buckets, classes, _Sets(docs))), "parts")
    named = classes.select("set_key", "rep").join(parts, F.col("rep") == F.col("node"), "left")
    return rows, named.select("set_key", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs.

    Null and empty texts have an empty set, are linked with nothing and kept. A null doc_id takes part in nothing: its component_id is null
    and it is kept. Rows that repeat a doc_id are one document; a repeated row with the same text has the same values. A pair at exactly the
    similarity is linked. Texts are taken whole, however long; an empty table gives no rows. Other columns of docs are ignored, whatever
    their names.
    """
    rows, named = near_classes(docs)
    joined = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs without those near an earlier document. Of rows that are alike in doc_id, each stays or goes with its document."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("nd_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("nd_id"), "left_anti")
