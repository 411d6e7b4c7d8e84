"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features say whether an n-gram of 3 to 5 characters (lower case, white space as one blank) occurs in a text;
n-grams are hashed to a fixed number of buckets. Bucket b is scaled by r_b, the logarithm of the ratio of its
smoothed share of toxic and of other texts it occurs in, and a logistic regression with a quadratic penalty is fitted on the
scaled features. A score needs one pass over the text: the weights are one array of fixed size, broadcast.

The classifier is fitted on a bounded sample of labelled rows: ``SAMPLE`` per label, those of the smallest
hashes, and ``MOST_FEATURES`` features in all. Features are made in tasks; only their bucket numbers are
gathered. The labels weigh alike in the fit; the intercept is then shifted towards the share of toxic rows among
all labelled ones.

Defined results: a null text counts as empty; without any n-gram the score is the intercept's. Without any
labelled row, or with one label only, the score is the smoothed share of toxic labels for every text. A document
labelled more than once counts as toxic if any label says so; null labels and null ids are not learnt from.
Equal texts are learnt from once. Repeated rows give repeated rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, whole_text

#: Lengths of n-grams and the number of their buckets.
LENGTHS = (3, 4, 5)
BUCKETS = 1 << 18
#: Labelled rows of each label that are learnt from, at most, and features of all of them.
SAMPLE = 3000
MOST_FEATURES = 40_000_000
#: Smoothing of counts; rows with an n-gram and size of its ratio from which on it tells something.
SMOOTH, LEAST_ROWS, LEAST_RATIO = 1.0, 3, 0.7
#: Penalty of the regression, its steps and their size.
PENALTY, STEPS, RATE = 0.02, 60, 0.05
#: Part of the prior log-odds added to the intercept. The penalty draws scores to the middle, so the whole is too much.
PRIOR_PART = 0.5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def buckets(text: str) -> np.ndarray:
    """Distinct buckets of the text's n-grams."""
    letters = np.frombuffer(text.lower().translate(_BLANKS).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    codes = letters[keep].astype(np.uint64) + np.uint64(1)
    found, rolled = [], codes
    for n in range(2, max(LENGTHS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * _ODD + codes[n - 1 :]
        if n in LENGTHS:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * _ODD
            found.append((mixed >> np.uint64(64 - 18)).astype(np.int32))
    if not found:
        return np.empty(0, dtype=np.int32)
    return _distinct(np.concatenate(found))


_stamps = np.zeros(BUCKETS, dtype=np.int32)


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Each number once, without sorting: of equal numbers the one written last stays."""
    places = np.arange(len(numbers), dtype=np.int32)
    _stamps[numbers] = places
    return numbers[_stamps[numbers] == places]


class Model:
    """Weights per bucket, already scaled by the ratios, and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def score(self, text: str) -> float:
        z = self.intercept + float(self.weights[buckets(text)].sum(dtype=np.float64))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def fit(features: list[np.ndarray], toxic: list[bool], share: float) -> Model:
    """``share``: that of toxic rows among all labelled ones."""
    y = np.array(toxic, dtype=bool)
    prior = math.log(share / (1 - share))
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(BUCKETS), prior)
    counts = np.zeros((2, BUCKETS))
    for own, label in zip(features, y):
        counts[int(label), own] += 1  # a text's features are distinct
    sizes = np.array([(~y).sum(), y.sum()])
    shares = (counts + SMOOTH) / (sizes + 2 * SMOOTH)[:, None]
    ratio = np.log(shares[1]) - np.log(shares[0])
    ratio[(counts.sum(axis=0) < LEAST_ROWS) | (np.abs(ratio) < LEAST_RATIO)] = 0.0
    telling = [own[ratio[own] != 0] for own in features]
    index = np.concatenate(telling)
    rows = np.repeat(np.arange(len(y)), [len(own) for own in telling])
    values = ratio[index]
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w, b = np.full(BUCKETS, 0.01), 0.0
    mean, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rates = np.append(np.full(BUCKETS, RATE), 10 * RATE)
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, values * w[index], minlength=len(y)) + b
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) - y) * weight
        grad = np.append(np.bincount(index, values * error[rows], minlength=BUCKETS) + PENALTY * w, error.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        moved = rates * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        w, b = w - moved[:-1], b - moved[-1]
    return Model(w * ratio, b + PRIOR_PART * prior)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by 5; a null id is ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows of ``docs`` for which ``learnable`` (over doc_id) holds."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id is not null and toxic is not null")
    if learnable is not None:
        known = known.filter(learnable)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    shares = known.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("int")).alias("t")).first()
    share = ((shares["t"] or 0) + SMOOTH) / (shares["n"] + 2 * SMOOTH)
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = None
    for label in (False, True):
        part = known.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 x sample rows of 17 bytes
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.sha2("text", 256).alias("sha"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("sha"), pa.array(found, pa.binary())], names=["toxic", "sha", "found"]
            )

    made = rows.mapInArrow(features, "toxic boolean, sha string, found binary")
    xs, ys, seen, total = [], [], set(), 0
    for row in made.orderBy(F.crc32("sha"), "sha", "toxic").toLocalIterator():
        if row["sha"] in seen or total + len(row["found"]) // 4 > MOST_FEATURES:
            continue
        seen.add(row["sha"])
        xs.append(np.frombuffer(row["found"], dtype=np.int32))
        ys.append(bool(row["toxic"]))
        total += len(xs[-1])
    return fit(xs, ys, share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 from a score of 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        own = Model(np.frombuffer(weights, dtype=np.float32), intercept)
        for batch in batches:
            found = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    found = texts(docs).mapInArrow(run, "doc_id long, score double")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not call toxic.

    The score is added to each row where it is read; texts are not shuffled.
    """
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.intercept))

    @F.pandas_udf("double")
    def score(text):
        weights, intercept = shared.value
        own = Model(np.frombuffer(weights, dtype=np.float32), intercept)
        return text.map(own.score)

    return docs.filter(score(whole_text()) < 0.5)
