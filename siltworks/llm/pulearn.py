"""Quality classifier from trusted positives and unlabelled text (positive-unlabelled learning).

A linear model over text statistics minimises the non-negative unbiased risk: with class prior p, logistic loss l and margins f,
p * mean l(f) over positives + max(0, mean l(-f) over unlabelled - p * mean l(-f) over positives). Whenever the bracket turns negative, its
gradient is followed back instead. Steps are damped Newton steps, and the later half of them is averaged.

The positives are halved. Each half trains a model, and the other half, with the unlabelled texts, puts that model's margins to scale by the same
risk with two unknowns, slope and shift: logistic loss is proper, so the sigmoid of a scaled margin is the chance of the positive class. The
classifier is the mean of both. Labelled negatives are used nowhere.

The prior is estimated from positives and unlabelled texts too: a first model tells the two kinds apart; among the texts that look most like
positives the negatives run out, so the ratio of the shares of unlabelled and of positive texts above a cutoff comes down to the prior there.

Features of every whole text are made in one scan. All unlabelled texts of the training fold take part: each step is one pass of sums over their
features. Positives are a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.textstats import COUNTS, text_counts
from siltworks.llm.wordhash import blocks, encoded, slices
from siltworks.session import drop_scratch, scratch, ship_package

#: Most trusted positives that fitting reads.
SAMPLE_ROWS = 20_000
#: Hexadecimal digits of the order of positives by which they are counted first.
LEAD_DIGITS = 4
THRESHOLD = 0.3
FOLDS = 5
#: Steps of fitting, of telling positives apart, their rate, and the longest one.
STEPS, FIRST_STEPS, RATE, LONGEST = 24, 8, 0.4, 2.0
WEIGHT_DECAY, DAMPING = 1e-2, 1e-2
#: Margins are counted in bins of this width up to this size.
BIN_WIDTH, MOST_MARGIN = 0.02, 60
#: Cutoffs tried for the prior, and the chance that a bound used in choosing among them fails.
CUTOFFS, CONFIDENCE = 200, 0.1

#: Bytes that get a share of their own.
_BYTES = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()] + [0x0A, 0x20]


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: logarithms of sizes and shares of byte kinds, repeated words, lines and windows."""
    counts = text_counts(texts).astype(np.float64)
    c = dict(zip(COUNTS, counts.T, strict=True))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    hist = np.zeros((len(texts), 256))
    for first, block in blocks(texts):
        for i, text in enumerate(block):
            hist[first + i] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = np.maximum(hist.sum(1), 1)
    shares = [hist[:, b] / size for b in _BYTES]
    shares += [hist[:, 0x30:0x3A].sum(1) / size, hist[:, 0x61:0x7B].sum(1) / size, hist[:, 0x80:].sum(1) / size]
    shares += [c["n_upper"] / chars, c["n_symbols"] / words, c["n_punct"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words]
    shares += [c["top_word"] / words, 1 - c["n_distinct"] / words]
    logs = [np.log1p(c["n_words"]), np.log1p(c["word_chars"] / words), np.log1p(c["n_words"] / lines)]
    few = [(c["n_words"] < n).astype(float) for n in (1, 5, 10, 20, 40, 80)]
    x = np.stack([*(np.log1p(100 * s) for s in shares), *(s for s in shares[-10:]), *logs, *(v * v for v in logs), *few], 1)
    return np.clip(x, -50, 50).astype(np.float32)


def n_features() -> int:
    return features([b"a"]).shape[1]


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, features as little-endian floats) for every row; null text counts as empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = features(encoded(batch.column("text").to_pylist()))
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed], ["doc_id", "features"])

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, features binary")


def _matrix(rows: list) -> np.ndarray:
    if not rows:
        return np.zeros((0, n_features()), np.float32)
    return np.frombuffer(b"".join(bytes(r["features"]) for r in rows), "<f4").reshape(len(rows), -1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class PUModel:
    """Scores are probabilities of the positive class. weights holds one weight per feature and the bias last."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None = None):
        self.mean, self.scale = mean, scale
        self.weights = np.zeros(len(mean) + 1) if weights is None else weights

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x.astype(np.float64) - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def softplus_sums(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Over rows of inputs: their count, the sum of log(1 + exp(margin)), its gradient, and its second derivatives row by row."""
    f = z @ weights
    chance = _sigmoid(f)
    curve = (z * (chance * (1 - chance))[:, None]).T @ z
    return np.concatenate([[len(z), np.logaddexp(0, f).sum()], z.T @ chance, curve.ravel()])


def sums_over(rows: DataFrame, of) -> np.ndarray:
    """The sum over all rows of of(features matrix), a vector. Tasks add up their own rows, the rest is one aggregate per place of the vector."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(np.frombuffer(b"".join(batch.column("features").to_pylist()), "<f4").reshape(batch.num_rows, -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total, pa.float64())], ["k", "v"])

    got = rows.select("features").mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["k"]] = r["v"]
    return out


def _decay(size: int) -> np.ndarray:
    """Weight decay for all but the bias."""
    return np.append(np.full(size - 1, WEIGHT_DECAY), 1e-9)


def nonnegative_risk(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk, bracket, gradient to go down) from inputs of the positives and the softplus_sums of the unlabelled. While the bracket is negative, the
    gradient is that of minus the bracket."""
    f, size = positive @ weights, len(weights)
    bracket = unlabelled[1] / unlabelled[0] - prior * np.logaddexp(0, f).mean()
    of_bracket = unlabelled[2 : 2 + size] / unlabelled[0] - prior * (positive.T @ _sigmoid(f)) / len(f)
    of_positives = -prior * (positive.T @ _sigmoid(-f)) / len(f)
    decay = _decay(size) * weights
    risk = prior * np.logaddexp(0, -f).mean() + max(0.0, bracket) + float(decay @ weights) / 2
    return risk, bracket, (of_positives + of_bracket if bracket >= 0 else -of_bracket) + decay


def _step(gradient: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The damped Newton step, LONGEST at most."""
    step = -np.linalg.solve(curve + np.diag(_decay(len(gradient)) + DAMPING), gradient)
    return step * min(1.0, LONGEST / max(float(np.sqrt(step @ step)), 1e-12))


def fit(model: PUModel, samples: list[np.ndarray], unlabelled: DataFrame, prior: float, steps: int = STEPS, rate: float = RATE) -> list[PUModel]:
    """One model for each sample of positives, by passes that they share. Unlabelled texts enter by sums over their features alone."""
    inputs, size = [model.inputs(x) for x in samples], len(model.weights)
    now = [model.weights for _ in samples]
    late = [np.zeros(size) for _ in samples]
    for t in range(steps):
        got = sums_over(unlabelled, lambda x: np.concatenate([softplus_sums(model.inputs(x), w) for w in now])).reshape(len(samples), -1)
        for i, sums in enumerate(got):
            _, _, gradient = nonnegative_risk(now[i], inputs[i], sums, prior)
            now[i] = now[i] + rate * _step(gradient, sums[2 + size :].reshape(size, size) / sums[0])
            if t >= steps // 2:
                late[i] += now[i] / (steps - steps // 2)
    return [PUModel(model.mean, model.scale, w) for w in late]


def _binned(margins: np.ndarray) -> np.ndarray:
    half = int(MOST_MARGIN / BIN_WIDTH)
    places = np.clip(np.floor(margins / BIN_WIDTH) + half, 0, 2 * half - 1).astype(np.int64)
    return np.bincount(places, minlength=2 * half).astype(np.float64)


def to_scale(margins: np.ndarray, bins: np.ndarray, prior: float) -> tuple[float, float]:
    """(slope, shift) of least unbiased risk, from margins of positives that the model has not seen and the binned margins of the unlabelled."""
    centres = (np.arange(len(bins)) + 0.5) * BIN_WIDTH - MOST_MARGIN
    share = bins / bins.sum()
    mean = float(share @ centres)
    spread = float(np.sqrt(share @ (centres - mean) ** 2)) + 1e-9
    u = np.stack([centres / spread, np.ones(len(bins))], 1)
    p = np.array([margins.mean() / spread, 1.0])
    a, decay = np.array([1.0, 0.0]), np.array([1e-3, 1e-6])
    for _ in range(100):
        chance = _sigmoid(u @ a)
        gradient = u.T @ (share * chance) - prior * p + decay * a
        curve = (u * (share * chance * (1 - chance))[:, None]).T @ u + np.diag(decay + 1e-6)
        step = -np.linalg.solve(curve, gradient)
        a = a + step * min(1.0, LONGEST / max(float(np.sqrt(step @ step)), 1e-12))
    return (float(a[0]) / spread, float(a[1])) if a[0] > 0 else (1.0, 0.0)


def telling_apart(model: PUModel, positive: np.ndarray, unlabelled: DataFrame) -> PUModel:
    """A logistic model that tells positives from unlabelled texts, both kinds of equal weight."""
    z = model.inputs(positive)
    w, size = model.weights, len(model.weights)
    for _ in range(FIRST_STEPS):
        got, own = sums_over(unlabelled, lambda x, w=w: softplus_sums(model.inputs(x), w)), softplus_sums(z, w)
        both = got / got[0] / 2 + own / own[0] / 2
        w = w + _step(both[2 : 2 + size] - z.mean(0) / 2 + _decay(size) * w, both[2 + size :].reshape(size, size))
    return PUModel(model.mean, model.scale, w)


def mixture_prior(positive: np.ndarray, above: np.ndarray, cutoffs: np.ndarray, n: float) -> float:
    """The share of positives among n unlabelled texts, of which above[i] have margins of cutoffs[i] or more, from margins of positives that the
    model has not seen. The cutoff is the one of least ratio plus its bound of error (best bin estimation)."""
    q_p = (positive[:, None] >= cutoffs[None, :]).mean(0)
    some = q_p > 0
    q_p, q_u = q_p[some], (above / n)[some]
    error = np.sqrt(np.log(4 / CONFIDENCE) / (2 * n)) + np.sqrt(np.log(4 / CONFIDENCE) / (2 * len(positive)))
    best = int(np.argmin((q_u + error) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 0.02, 0.98))


def estimated_prior(model: PUModel, halves: list[np.ndarray], unlabelled: DataFrame) -> float:
    """Learns to tell one half of the positives from the unlabelled texts and estimates with the other."""
    teller = telling_apart(model, halves[0], unlabelled)
    margins = teller.margin(halves[1])
    cutoffs = np.unique(np.quantile(margins, np.linspace(0, 1, CUTOFFS, endpoint=False)))
    above = sums_over(unlabelled, lambda x: np.append((teller.margin(x)[:, None] >= cutoffs[None, :]).sum(0), len(x)).astype(np.float64))
    return mixture_prior(margins, above[:-1], cutoffs, above[-1])


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def first_rows(rows: DataFrame, order: str, ties: list[str], n: int) -> DataFrame:
    """The n rows of least order, a hexadecimal digest. Counts by its first digits tell which rows can be among them, so tasks hand on little more than n
    rows together, not n each."""
    lead = F.substring(order, 1, LEAD_DIGITS)
    before, last = 0, None
    for row in sorted(rows.groupBy(lead.alias("lead")).agg(F.count(F.lit(1)).alias("n")).collect()):  # at most 16**LEAD_DIGITS rows
        before, last = before + row["n"], row["lead"]
        if before >= n:
            break
    if last is None:
        return rows.limit(0)
    return rows.where(lead <= last).orderBy(order, *ties).limit(n)


def train(table: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[PUModel, float] | None:
    """(model, estimated prior), learnt on the training fold: positives are the labelled rows of quality 1 with the least md5(doc_id), at most
    sample_rows; unlabelled are all rows without a label. None where there are no positives or no unlabelled texts."""
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.col("quality").isin(0, 1))
    rows = table.where(F.col("doc_id").isNotNull() & ~held_out())
    good = rows.join(known.where("quality = 1"), "doc_id").withColumn("pu_order", F.md5(F.col("doc_id").cast("string")))
    positive = _matrix(scratch(first_rows(good, "pu_order", ["features"], sample_rows).select("features"), "positives").collect())
    unlabelled = scratch(rows.join(known, "doc_id", "left_anti").select("features"), "unlabelled")
    if not len(positive) or unlabelled.isEmpty():
        return None
    sums = sums_over(unlabelled, lambda x: np.concatenate([[len(x)], x.astype(np.float64).sum(0), (x.astype(np.float64) ** 2).sum(0)]))
    mean, square = np.split(sums[1:] / sums[0], 2)
    start = PUModel(mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3)
    halves = [positive[0::2], positive[1::2]] if len(positive) > 1 else [positive, positive]
    prior = estimated_prior(start, halves, unlabelled)
    models = fit(start, halves, unlabelled, prior)
    bins = sums_over(unlabelled, lambda x: np.concatenate([_binned(m.margin(x)) for m in models])).reshape(2, -1)
    drop_scratch(unlabelled)
    weights = np.zeros(len(start.weights))
    for model, others, counts in zip(models, reversed(halves), bins, strict=True):
        slope, shift = to_scale(model.margin(others), counts, prior)
        weights += (slope * model.weights + np.append(np.zeros(len(weights) - 1), shift)) / 2
    return PUModel(start.mean, start.scale, weights), prior


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs.

    Null and empty texts are scored as empty ones, and any text whole, however long. A label is positive only if all labels of its document say 1;
    null labels say nothing. Without labels of quality 1, or without unlabelled texts to learn from, every score is 0.5. A null doc_id is never
    learnt from and counts as not held out. Repeated rows get equal scores; among positives with equal order, features decide. A score equal to
    the threshold predicts 1. An empty table gives no rows. Other columns of docs, labels among them, are ignored, whatever their names.
    """
    table = scratch(feature_table(docs), "features")
    trained = train(table, labels, sample_rows)
    model = trained[0] if trained else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column("features").to_pylist()), "<f4").reshape(n, -1) if n else None
            got = model.score(x) if n and model is not None else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    scored = table.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
