"""Hard negatives by a vertical scan of the vectors (BOND).

Rows are cut into blocks that hold their vectors by dimension, written once to the shared folder. For an anchor, a
task reads a block's dimensions in the order of the anchor's largest magnitudes. The sums so far and the least and
most that the block's smallest and largest values of the remaining dimensions can add bound every score; a row whose
bounds can't reach what is wanted leaves the candidates. What is wanted: in the first scan one of the best positives,
in the second a place among the best negatives inside a window below one of the positives' exact scores. Thresholds
of former blocks of the task count too. Rows that last through all dimensions have their exact scores.

Anchors go through in waves whose vectors fit in ``WAVE_BYTES``, which bounds what is broadcast; every wave scans the
written blocks twice. Tasks hand on rows that beat their thresholds; ranks are taken by anchor over all of them.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. A row is one
of its own also if its vec_id repeats: repeated anchors each have their result, repeated rows each can be a positive
or negative, and then (after equal scores and ids) the order of storage decides. A null vec_id is no anchor, counts
as the largest id and is returned as null. Vectors of different length are filled up with zeros; an empty vector
scores 0. Components count as at most ``LARGEST`` in size. Empty tables and tables without anchors give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread
from .common import written

#: Rows of a block; bytes of anchor vectors that are broadcast at a time.
BLOCK_BITS, WAVE_BYTES = 12, 8 << 20
#: Dimensions that are read between two looks at the bounds.
STEP = 8
#: Largest size of a whole component, so that sums of 512 products stay in 64 bits.
LARGEST = 1 << 27
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 30, 90

_LEAST = np.iinfo(np.int64).min
BLOCKS = "block long, ids array<long>, labels array<long>, planes array<binary>"
ANCHORS = "anchor long, vec_id long, label long, vector binary"
FOUND = "anchor long, slot int, place long, id long, score long"


def _whole_rows(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, labels and whole components (rows by dimensions) of the rows that take part."""
    vectors = batch.column("embedding")
    starts = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(256 * values)
    lengths = np.diff(starts)
    there = ~np.asarray(vectors.is_null()) & ~np.asarray(batch.column("label").is_null()) & (bad[starts[1:]] == bad[starts[:-1]])
    keep = np.flatnonzero(there)
    width = int(lengths[keep].max()) if len(keep) else 0
    whole = np.zeros((len(keep), width), dtype=np.int64)
    for length in np.unique(lengths[keep]):
        some = np.flatnonzero(lengths[keep] == length)
        at = starts[:-1][keep[some], None] + np.arange(length)
        whole[some[:, None], np.arange(length)] = np.clip(values[at], -LARGEST, LARGEST)
    ids = batch.column("vec_id")
    labels = batch.column("label").fill_null(0).to_numpy()
    seventh = np.asarray(ids.is_valid()) & (np.fmod(ids.fill_null(1).to_numpy(), 7) == 0)
    labels = np.where(seventh, np.fmod(labels + 1, 10), labels)
    return ids.take(pa.array(keep)), labels[keep], whole


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 24
    for batch in batches:
        for at in range(0, len(batch), 1 << BLOCK_BITS):
            ids, labels, whole = _whole_rows(batch.slice(at, 1 << BLOCK_BITS))
            if not len(labels):
                continue
            planes = [plane.astype("<i4").tobytes() for plane in whole.T]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int64())),
                 pa.array([planes], pa.list_(pa.binary()))],
                names=["block", "ids", "labels", "planes"],
            )
            block += 1


class _Block:
    """A block's dimensions, with their smallest and largest values, and its rows by label."""

    def __init__(self, row: dict) -> None:
        n = len(row["labels"])
        self.known = np.array([x is not None for x in row["ids"]], dtype=bool)
        self.ids = np.array([0 if x is None else x for x in row["ids"]], dtype=np.int64)
        self.places = (row["block"] << BLOCK_BITS) + np.arange(n)
        self.planes = np.zeros((len(row["planes"]), n), dtype=np.int64)
        for k, plane in enumerate(row["planes"]):
            self.planes[k] = np.frombuffer(plane, dtype="<i4")
        self.least, self.most = self.planes.min(axis=1), self.planes.max(axis=1)
        labels = np.array(row["labels"], dtype=np.int64)
        self.labels = labels
        self.same = {int(x): np.flatnonzero(labels == x) for x in np.unique(labels)}
        self.everyone = np.arange(n)

    def scan(self, vector: np.ndarray, rows: np.ndarray, may_stay) -> tuple[np.ndarray, np.ndarray]:
        """The ``rows`` that ``may_stay`` (bounds below and above) keeps to the end, and their exact scores."""
        width = min(len(vector), len(self.planes))
        vector = vector[:width]
        order = np.argsort(-np.abs(vector), kind="stable")
        ends = np.sort(np.stack([vector * self.least[:width], vector * self.most[:width]]), axis=0)[:, order]
        rest = np.zeros((2, width + 1), dtype=np.int64)
        rest[:, :width] = np.cumsum(ends[:, ::-1], axis=1)[:, ::-1]
        sums = np.zeros(len(rows), dtype=np.int64)
        for at in range(0, width, STEP):
            for k in order[at : at + STEP]:
                sums += vector[k] * self.planes[k][rows]
            left = rest[:, min(at + STEP, width)]
            keep = may_stay(sums + left[0], sums + left[1])
            if not keep.all():
                rows, sums = rows[keep], sums[keep]
                if not len(rows):
                    break
        return rows, sums

    def first(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Positions in ``rows`` of the ``k`` that come first."""
        return np.lexsort((self.places[rows], self.ids[rows], ~self.known[rows], -scores))[:k]


def _opened(batch: pa.RecordBatch) -> Iterator[_Block]:
    """The blocks of a batch, one at a time."""
    for k in range(len(batch)):
        yield _Block(batch.slice(k, 1).to_pylist()[0])


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, -k)[-k]) if len(scores) >= k else _LEAST


def _pushed(best: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The best scores so far, smallest first, with ``scores`` taken in."""
    return np.sort(np.concatenate([best, scores]))[len(scores) :]


def _found(rows: list[tuple[int, int, _Block, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    many = lambda pick: np.concatenate([pick(x) for x in rows])
    known = many(lambda x: x[2].known[x[3]])
    return pa.RecordBatch.from_arrays(
        [pa.array(many(lambda x: np.full(len(x[3]), x[0]))), pa.array(many(lambda x: np.full(len(x[3]), x[1])), pa.int32()),
         pa.array(many(lambda x: x[2].places[x[3]])), pa.array(many(lambda x: x[2].ids[x[3]]), mask=~known),
         pa.array(many(lambda x: x[4]))],
        names=["anchor", "slot", "place", "id", "score"],
    )


def _best_positives(wave):
    """For every anchor of the wave: rows of its label that may be among the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = wave.value
        best = np.full((len(anchors), POSITIVES), _LEAST)
        for batch in batches:
            for block in _opened(batch):
                found = []
                for k, (anchor, label, vector) in enumerate(anchors):
                    rows = block.same.get(label)
                    if rows is None:
                        continue
                    rows = rows[block.places[rows] != anchor]
                    may_stay = lambda low, high, k=k: high >= max(best[k, 0], _kth(low, POSITIVES))
                    rows, scores = block.scan(vector, rows, may_stay)
                    first = block.first(rows, scores, POSITIVES)
                    if len(first):
                        best[k] = _pushed(best[k], scores[first])
                        found.append((anchor, 0, block, rows[first], scores[first]))
                if found:
                    yield _found(found)

    return run


def _best_negatives(wave, windows):
    """For every window of an anchor: rows of other labels that may be among the best inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, limits = wave.value, windows.value
        best = {anchor: np.full((len(limits[anchor]), NEGATIVES), _LEAST) for anchor in limits}
        for batch in batches:
            for block in _opened(batch):
                found = []
                others = {}
                for anchor, label, vector in anchors:
                    if anchor not in limits:
                        continue
                    if label not in others:
                        others[label] = np.flatnonzero(block.labels != label)
                    own = best[anchor]

                    def may_stay(low, high, own=own, limits=limits[anchor]):
                        keep = np.zeros(len(low), dtype=bool)
                        for (_, least, most), known in zip(limits, own):
                            inside = low[(low >= least) & (high <= most)]
                            keep |= (low <= most) & (high >= max(least, known[0], _kth(inside, NEGATIVES)))
                        return keep

                    rows, scores = block.scan(vector, others[label], may_stay)
                    for k, (slot, least, most) in enumerate(limits[anchor]):
                        some = np.flatnonzero((scores >= max(least, own[k, 0])) & (scores <= most))
                        first = some[block.first(rows[some], scores[some], NEGATIVES)]
                        if len(first):
                            own[k] = _pushed(own[k], scores[first])
                            found.append((anchor, slot, block, rows[first], scores[first]))
                if found:
                    yield _found(found)

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _opened(batch):
            at = np.flatnonzero(block.known & (block.ids % 100 == 0))
            vectors = [v.astype("<i4").tobytes() for v in block.planes[:, at].T]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.places[at]), pa.array(block.ids[at]), pa.array(block.labels[at]), pa.array(vectors, pa.binary())],
                names=["anchor", "vec_id", "label", "vector"],
            )


def _ranked(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The first ``k`` of each group, with their ``rank``; Spark cuts every task's rows to ``k`` before it moves them."""
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _windows(positives: DataFrame) -> dict[int, list[tuple[int, int, int]]]:
    """Of each anchor of a wave: positive's rank, smallest and largest score of its negatives, if there can be any."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for r in positives.select("anchor", "rank", "score").collect():
        least, most = -(-LOW * r["score"] // 100), HIGH * r["score"] // 100
        if least <= most:
            found.setdefault(r["anchor"], []).append((r["rank"], least, most))
    return found


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see above."""
    spark = embeddings.sparkSession
    context = spark.sparkContext
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    blocks = written(spread(rows).mapInArrow(_blocks, BLOCKS))
    anchors = written(blocks.mapInArrow(_anchors, ANCHORS))
    size = anchors.agg(F.sum(F.octet_length("vector") + 24)).first()[0] or 0
    waves = math.ceil(size / WAVE_BYTES)
    results = spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    for wave in range(waves):
        own = anchors.filter(F.pmod(F.xxhash64("anchor"), F.lit(waves)) == wave)
        held = context.broadcast([
            (r["anchor"], r["label"], np.frombuffer(r["vector"], dtype="<i4").astype(np.int64)) for r in own.collect()
        ])
        positives = written(_ranked(blocks.mapInArrow(_best_positives(held), FOUND), POSITIVES, ["anchor"]))
        windows = context.broadcast(_windows(positives))
        negatives = _ranked(blocks.mapInArrow(_best_negatives(held, windows), FOUND), NEGATIVES, ["anchor", "slot"])
        of = positives.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        of = of.join(own.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        joined = negatives.join(of, ["anchor", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
        results = results.unionByName(written(joined))
    return results
