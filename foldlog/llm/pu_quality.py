"""Quality scores by positive-unlabelled learning with the non-negative risk of Kiryo et al. (2017).

Trusted positives are texts labelled good, the unlabelled ones all texts that are not held out. With class prior p and logistic loss l,
    risk = p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)])
is minimised over a linear score of text features (rates of letter classes, repetition, word and line lengths, and
their squares). The prior is estimated over all labelled rows that are not held out; negatives are not used otherwise.

Each text is read once, into a written table of its features. A pass over that table sums the unlabelled texts' losses, slopes and
curvatures (some 740 numbers, merged on the executors) at the weights of the moment, for all of them, whatever their number and how alike they are.
Since l(f) - l(-f) = -f, p E+[l(f)] + k [bracket] is convex for k from 0 to 1, and Newton's steps find its minimum in a few passes. The
risk is its greatest value over k. If the bracket is not negative at the minimum for k = 1, that is the answer; else, where unlabelled texts
would be fitted as if all were negative, k is halved in between until the minimum has a bracket of zero (PASSES at most, in all).

The labelled sample that is fitted on is bounded: the SAMPLE positives of the least digests of their ids.

Defined cases: a null or empty text has features of zero and a score like any other; without positives or unlabelled
texts every score is the prior (a half without labels); labels that are null are left out, repeated ones of a doc_id
count once, as the greatest; rows that repeat a positive's doc_id count as one of them, by the least of their features; a
null id is not held out and teaches nothing as a label, its text is unlabelled. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.llm import kit
from foldlog.llm.quality_rules import repeat_words

SAMPLE = 6_000
PASSES, DECAY, STRIDE = 60, 1e-2, 3.0
FOLDS, THRESHOLD = 5, 0.3
#: Letter classes of bytes: 0 lower case, 1 upper case, 2 digits, 3 symbols, 4 bars, 5 exclamation marks, 6 question marks, 7 full stops, 8 commas, 9 line ends, 10 other ASCII, 11 white space, 12 beyond ASCII.
_CLASS = np.full(256, 10, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 12
_CLASS[[ord(c) for c in "#*$%&<>"]] = 3
for _c, _k in (("|", 4), ("!", 5), ("?", 6), (".", 7), (",", 8), ("\n", 9)):
    _CLASS[ord(_c)] = _k
_CLASS[[32, 9, 11, 12, 13]] = 11
CLASSES = 13
FEATURES = 18


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    rows = len(offsets) - 1
    words = kit.Words(data, offsets)
    of = np.repeat(np.arange(rows), np.diff(offsets))
    counts = np.bincount(of * CLASSES + _CLASS[data], minlength=rows * CLASSES).reshape(rows, CLASSES).astype(np.float64)
    n = np.diff(words.bounds)
    some = np.maximum(n, 1)
    size = words.ends - words.starts
    total = np.concatenate([[0], np.cumsum(size)])
    longest = np.array([size[a:b].max() if b > a else 0 for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)])
    kinds = np.array([len(np.unique(words.hash[a:b])) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)])
    out = np.empty((rows, FEATURES))
    out[:, :10] = np.sqrt(counts[:, 1:11] / some[:, None])
    out[:, 10] = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    out[:, 11] = np.log1p(n)
    out[:, 12] = np.log1p((total[words.bounds[1:]] - total[words.bounds[:-1]]) / some)
    out[:, 13] = np.log1p(longest)
    out[:, 14] = kinds / some
    out[:, 15] = repeat_words(words) / some
    out[:, 16] = np.log1p(n / (counts[:, 9] + 1))
    out[:, 17] = (counts[:, 3] + counts[:, 4] + counts[:, 5] > n / 4).astype(float)
    out[n == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_wide(x, self.mean, self.scale) @ np.append(self.weights, self.bias))


@dataclass(frozen=True)
class Sums:
    """Means over unlabelled texts at some weights: of l(-f), its slope and its curvature."""

    loss: float
    slope: np.ndarray
    curve: np.ndarray


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def unlabelled_sums(u: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of rows u (with a last column of ones), summed."""
    f = u @ w
    s = _sigmoid(f)
    return float(np.logaddexp(0, f).sum()), u.T @ s, (u * (s * (1 - s))[:, None]).T @ u


def risk(w: np.ndarray, p: np.ndarray, sums: Sums, prior: float, k: float = 1.0) -> tuple[float, float, np.ndarray, np.ndarray]:
    """p E+[l(f)] + k [bracket] at weights w, the bracket, and slope and curvature of the former."""
    fp = p @ w
    s = _sigmoid(fp)
    bracket = sums.loss - prior * np.logaddexp(0, fp).mean()
    slope = k * sums.slope - prior * (p * (1 - (1 - k) * s)[:, None]).mean(axis=0)
    curve = k * sums.curve + (1 - k) * prior * (p * (s * (1 - s))[:, None]).T @ p / len(p)
    return prior * np.logaddexp(0, -fp).mean() + k * bracket, bracket, slope, curve


def learn(p: np.ndarray, evaluate: Callable[[np.ndarray], Sums], prior: float, passes: int = PASSES, decay: float = DECAY) -> np.ndarray:
    """Weights (the last one is the bias) of least non-negative risk and decay. evaluate: a pass over the unlabelled texts."""
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    damp = np.append(np.full(len(w) - 1, decay), 0)
    left = passes

    def told(w: np.ndarray) -> Sums:
        nonlocal left
        left -= 1
        return evaluate(w)

    def lowest(w: np.ndarray, now: Sums, k: float) -> tuple[np.ndarray, Sums]:
        value = lambda w, sums: risk(w, p, sums, prior, k)[0] + 0.5 * damp @ (w * w)
        while left > 0:
            _, _, slope, curve = risk(w, p, now, prior, k)
            step = -np.linalg.solve(curve + np.diag(damp + 1e-8), slope + damp * w)
            size, before = min(1.0, STRIDE / max(np.abs(step).max(), 1e-12)), value(w, now)  # where all is flat, steps have no length of their own
            while left > 0 and size > 1e-6:
                tried = w + size * step
                sums = told(tried)
                if value(tried, sums) < before:
                    w, now = tried, sums
                    break
                size /= 4
            if before - value(w, now) < 1e-5:
                break
        return w, now

    below, above = 0.0, 1.0
    w, now = lowest(w, told(w), 1.0)
    best = w
    if risk(w, p, now, prior)[1] < 0:
        while left > 0 and above - below > 1 / 64:
            k = (below + above) / 2
            w, now = lowest(w, now, k)
            bracket = risk(w, p, now, prior)[1]
            if bracket < 0:
                above = k
            else:
                below, best = k, w
                if bracket < 1e-3:
                    break
    return best


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in kit.text_steps(batch, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(list(features(data, offsets).astype(np.float32)), type=pa.list_(pa.float32()))], names=["doc_id", "x"])


def _wide(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z, z * z / 4, np.ones((len(z), 1))], axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(np.float64)


def _totals(of: Callable[[np.ndarray], np.ndarray]):
    """Feature rows to (place, value): a task's sums of what ``of`` makes of a block of rows, and how many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(0))
                own = np.append(of(x), len(x))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

    return run


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of features; fixed decimals, so that no order of tasks shows."""
    found = rows.transform(kit.through, _totals(of), "place int, value double").groupBy("place").agg(F.sum(F.col("value").cast("decimal(34,10)")).cast("double").alias("value"))
    return found.orderBy("place").toPandas()["value"].to_numpy(dtype=np.float64)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): every text's features, in a written table."""
    given = docs.select("doc_id", "text")
    rows = given.transform(kit.through, _featured, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, x array<float>")
    return kit.Scratch(docs.sparkSession, "pu-quality").cut(rows, "features")


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """rows: what ``featured`` returns; labels: doc_id, quality. Both of all documents; rows that are held out are left out here."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    prior = 0.5 if share is None else float(np.clip(share, 0.02, 0.98))
    trusted = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")  # bounded by sample
    met = rows.join(F.broadcast(trusted), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow()
    positive = np.array(met["x"].to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
    others = rows.where(~held_out(F.col("doc_id"))).select("x")
    moments = _summed(others, lambda x: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)]))
    if not len(positive) or not len(moments):
        return Model(prior, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(2 * FEATURES), float(np.log(prior / (1 - prior))))
    n = moments[-1]
    mean = moments[:FEATURES] / n
    scale = np.maximum(np.sqrt(np.maximum(moments[FEATURES : 2 * FEATURES] / n - mean * mean, 0)), 1e-3)
    upper = np.triu_indices(2 * FEATURES + 1)

    def evaluate(w: np.ndarray) -> Sums:
        def of(x: np.ndarray) -> np.ndarray:
            loss, slope, curve = unlabelled_sums(_wide(x, mean, scale), w)
            return np.concatenate([[loss], slope, curve[upper]])

        total = _summed(others, of) / n
        half = np.zeros((len(w), len(w)))
        half[upper] = total[1 + len(w) : -1]
        return Sums(total[0], total[1 : 1 + len(w)], half + np.triu(half, 1).T)

    w = learn(_wide(positive, mean, scale), evaluate, prior)
    return Model(prior, mean, scale, w[:-1], float(w[-1]))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_vectors(batch.column(1))))], names=["doc_id", "score"])

    return rows.transform(kit.through, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = featured(docs)
    found = score(rows, fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
