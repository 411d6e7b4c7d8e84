"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit set where over half the hashes of its word shingles have it. Fingerprints that differ
in few bits agree in some parts of the 64, so distinct fingerprints meet in groups of equal parts: with radius 3 and
four parts one part agrees, with five two, with six three. How many parts there are follows from the number of
fingerprints and only changes how often strangers meet.

Groups are compared bit-sliced: the fingerprints of a slice are laid out as 64 bit planes, a plane being a row of
64-bit words with one lane per fingerprint. The planes of all lanes and of the lanes d places on are compared at once
by exclusive or, and the differing bits of every lane are counted by carry-save in two bit counters and an overflow:
a lane that overflows is over the radius. Words of lanes that are all over it are abandoned, and with the last word
the block. A group over ``SLICE`` members is cut into slices that meet pairwise, each pair in a task's group of its
own, so no task holds more than two slices.

Links are handed on as stars: in each slice pair a member is linked with the first one of those it is connected to.
That loses no connection and keeps groups of near copies from being expanded into pairs; a slice pair that is
connected as a whole is done. Components of all stars then give the classes.

Defined results: a null text counts as empty. Texts without words have the fingerprint zero and are linked like any
other. Fewer words than a shingle are one as a whole. Repeated rows and ids give repeated rows of the same class; a
null doc_id is in a class but never names it (null if the class has no other). An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .components import components

#: Words of a shingle, seed of their hash, differing bits of a link at most.
SIZE, SEED, RADIUS = 3, 42, 3
#: Bytes of a text that are cut into words at a time, texts that a task takes out of a batch at a time.
PIECE, TEXTS = 1 << 20, 256
#: Fingerprints of a slice.
SLICE = 1 << 14
#: Planes that are compared between two looks at what is left.
STEP = 8

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ONE = np.uint64(1)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words, A-Z in lower case, a piece at a time; pieces end between words."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def _bit_counts(shingles: list[bytes]) -> np.ndarray:
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(shingles))
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """The fingerprint as an unsigned number."""
    counts, n, words = np.zeros(64, dtype=np.int64), 0, []
    for piece in _pieces(text):
        words += piece
        if len(words) >= SIZE:
            shingles = list(map(b" ".join, zip(*(words[k:] for k in range(SIZE)))))
            counts += _bit_counts(shingles)
            n += len(shingles)
            words = words[1 - SIZE :]
    if not n and words:
        counts, n = _bit_counts([b" ".join(words)]), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (its bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for at in range(0, len(batch), TEXTS):
                found += map(fingerprint, batch.column("text").slice(at, TEXTS).cast(pa.large_binary()).to_pylist())
            bits = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits)], names=["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint long")


def shared_parts(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of parts, one of which any two fingerprints within the radius share, for ``n`` fingerprints.

    Two strangers share a given mask once in 2 ** (its bits) times; more parts mean more masks of more bits.
    """
    parts = radius + 1 + (n > 1 << 24) + (n > 1 << 33)
    cuts = [64 * k // parts for k in range(parts + 1)]
    pieces = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(some) for some in combinations(pieces, parts - radius)]


class _Planes:
    """Bit planes of fingerprints, laid out once or, to be read round and round, twice."""

    def __init__(self, numbers: np.ndarray, bits: list[int], times: int = 1) -> None:
        numbers = np.tile(numbers, times)
        words = len(numbers) // 64 + 3
        spread = np.unpackbits(numbers.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        packed = np.packbits(spread[:, bits].T, axis=1, bitorder="little")
        self.words = np.zeros((len(bits), words), dtype="<u8")
        self.words.view(np.uint8)[:, : packed.shape[1]] = packed

    def read(self, planes: slice, words: np.ndarray, shift: int) -> np.ndarray:
        """The planes' ``words`` as if all lanes were ``shift`` places further down."""
        jump, part = divmod(shift, 64)
        found = self.words[planes][:, words + jump]
        if part:
            found = (found >> np.uint64(part)) | (self.words[planes][:, words + jump + 1] << np.uint64(64 - part))
        return found


def _within(left: _Planes, right: _Planes, shift: int, lanes: np.ndarray) -> np.ndarray:
    """Of the ``lanes`` (a mask): those whose left and shifted right fingerprint differ in at most ``RADIUS`` = 3 bits."""
    packed = np.packbits(lanes, bitorder="little")
    alive = np.zeros(-(-len(packed) // 8) * 8, dtype=np.uint8)
    alive[: len(packed)] = packed
    alive = alive.view("<u8")
    words = np.flatnonzero(alive)
    alive = alive[words]
    ones, twos = np.zeros_like(alive), np.zeros_like(alive)
    for at in range(0, len(left.words), STEP):
        planes = slice(at, at + STEP)
        for differ in left.read(planes, words, 0) ^ right.read(planes, words, shift):
            carry = ones & differ
            ones ^= differ
            alive &= ~(twos & carry)
            twos ^= carry
        left_over = np.flatnonzero(alive)
        if not len(left_over):
            return left_over
        if len(left_over) < len(words):
            words, alive, ones, twos = words[left_over], alive[left_over], ones[left_over], twos[left_over]
    inside = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (words[:, None] * 64 + np.arange(64))[inside.astype(bool)]


class _Stars:
    """Connected members of a slice pair."""

    def __init__(self, n: int) -> None:
        self.root, self.found, self.many = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Take in links; whether all members are connected by now."""
        if len(a):
            self.found.append((a, b))
            self.many += len(a)
        if self.many < len(self.root):
            return False
        self.settle()
        return not self.root.any()

    def settle(self) -> None:
        if self.found:
            a, b = (np.concatenate([x[k] for x in self.found]) for k in (0, 1))
            while True:
                x, y = self.root[a], self.root[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
                while (self.root != self.root[self.root]).any():
                    self.root = self.root[self.root]
            self.found, self.many = [], 0


def _compared(masks: list[int]):
    """Stars of a slice pair, or of a slice that holds many small groups."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mask, one, other = masks[int(rows["mask"].iloc[0])], rows["one"].iloc[0], rows["other"].iloc[0]
        bits = [k for k in range(64) if not mask >> k & 1]
        numbers, part = rows["fingerprint"].to_numpy().view(np.uint64), rows["part"].to_numpy()
        stars = _Stars(len(numbers))
        if one != other:
            a, b = np.flatnonzero(part == one), np.flatnonzero(part == other)
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            left, right = _Planes(numbers[a], bits), _Planes(numbers[b], bits, 2)
            lanes = np.ones(len(a), dtype=bool)
            for shift in range(len(b) if len(a) else 0):
                near = _within(left, right, shift, lanes)
                if stars.add(a[near], b[(near + shift) % len(b)]):
                    break
        else:
            keys = numbers & np.uint64(mask)
            _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
            order = np.lexsort((group, -size[group]))  # longest groups first, so that long shifts look at few lanes
            group = group[order]
            ends = np.zeros(len(size), dtype=np.int64)
            ends[group] = np.arange(1, len(order) + 1)  # the last one written stays
            room = ends[group] - np.arange(len(order))
            planes = _Planes(numbers[order], bits)
            for shift in range(1, int(size.max())):
                lanes = room > shift
                lanes = lanes[: int(np.flatnonzero(lanes)[-1]) + 1]
                near = _within(planes, planes, shift, lanes)
                if stars.add(order[near], order[near + shift]):
                    break
        stars.settle()
        inner = np.flatnonzero(stars.root != np.arange(len(numbers)))
        found = numbers.view(np.int64)
        return pd.DataFrame({"a": found[inner], "b": found[stars.root[inner]]})

    return run


def _hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def links(rows: DataFrame, size: int = SLICE) -> DataFrame:
    """Stars (a, b) that connect all distinct fingerprints within the radius of each other."""
    nodes = rows.select("fingerprint").distinct()
    nodes = written(nodes)
    n = nodes.count()
    masks = shared_parts(n)
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    places = F.explode(F.array(*(
        F.struct(F.lit(k).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(x)).alias("key")) for k, x in enumerate(signed)
    )))
    met = nodes.select("fingerprint", places.alias("at")).select("fingerprint", "at.*")
    large = written(met.groupBy("mask", "key").agg(F.count("*").alias("members")).filter(F.col("members") > size))
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = max(1, min(shuffles, -(-n // 64)), n // size)
    parts = F.ceil(F.col("members") / size).cast("int")
    part = F.coalesce(F.pmod(F.xxhash64("fingerprint", "mask"), parts).cast("int"), F.lit(0))
    met = met.join(large, ["mask", "key"], "left").withColumn("part", part)
    group = F.when(F.col("members").isNull(), F.pmod(F.xxhash64("key"), F.lit(small))).otherwise(F.col("key"))
    met = met.withColumn("group", group).withColumn("single", F.col("members").isNull())
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
    met = met.select(
        "mask", "single", "group", "fingerprint", "part", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("other")
    )
    return met.groupBy("mask", "single", "group", "one", "other").applyInPandas(_compared(masks), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint in hex and component_id, the smallest doc_id that links reach."""
    rows = written(fingerprints(docs))
    roots = written(components(links(rows)))
    least = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    known = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    known = known.withColumn("root", F.coalesce("root", "fingerprint"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.select("fingerprint", "root").join(named, "root").select("fingerprint", "component_id")
    return rows.join(known, "fingerprint").select("doc_id", _hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
