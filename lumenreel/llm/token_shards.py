"""Token ids in binary shards with a minimal perfect hash index.

Texts are dealt out by ranges of doc_id and sorted; every task encodes its texts, puts an end id behind each and
writes the raw ids (2 bytes each if the vocabulary allows it, else 4, little-endian) to one shard, under a name
of its own first and moved into place when whole, so a repeated task does no harm. A manifest has a row per
shard with the number of ids before it.

The index maps a document's key to its shard, offset and length. Keys are split into buckets by hash; in a bucket
of n keys a hash-and-displace function sends every key to a slot of its own below n: keys fall into small
groups, each group stores the displacement that brings its keys to free slots, groups of one the slot itself.
Slots store a 32-bit fingerprint of the key, so a strange key is refused (but for one in 4 billion), and the
place of the ids. A lookup hashes, reads one displacement and one slot: constant time.

Defined results: a null text counts as empty; it has the end id only. Rows without doc_id come first; their ids
are in the shards, but they have no key; ``unkeyed`` lists them. Of rows with equal doc_id all are written, in
the order of their texts; the key leads to the first, ``unkeyed`` lists the others. An empty table gives no shards and an index without keys.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from operator import itemgetter
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import texts

#: Keys of a bucket and of a group, about.
BUCKET, GROUP = 8192, 4
#: Displacements that a group tries at a time.
SEEDS = 16
#: Words whose ids a worker keeps in each of two tables, and the longest of them.
KEPT_WORDS, KEPT_LENGTH = 300_000, 48
#: Bytes of texts that are encoded together, new words that are asked for at once.
SLICE, ASKED = 8 << 20, 4096
#: Puts a blank between a letter or digit and the punctuation that ends a word.
PUNCTUATION = {"pattern": r"([A-Za-z0-9])([.,;:!?)]+)(\s|$)", "replacement": r"\1 \2\3"}
#: Bytes of ids that are gathered before they are written.
PIECE = 4 << 20
INDEX = "bucket int, n int, moves binary, prints binary, shards binary, offsets binary, lengths binary"


def open_path(uri: str) -> tuple[pa.fs.FileSystem, str]:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), parts.path
    return pa.fs.FileSystem.from_uri(uri)


class WordCoder:
    """Ids of texts by the tokenizers library, asked once for every word.

    The vocabulary's split never joins characters across a blank, so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        # tasks are the threads here; the library must not start eight of its own in each
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.kept: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> list[bytes]:
        """Codes of new words: one text of them all, its ids told apart by where they begin."""
        found = self.library.encode(" ".join(words), add_special_tokens=False)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begins = np.cumsum(lengths[:-1] + 1)
        ids = np.array(found.ids, dtype=self.kind).tobytes()
        places = np.fromiter(map(itemgetter(0), found.offsets), dtype=np.int64, count=len(found.ids))
        ends = np.searchsorted(places, begins) * self.width
        cuts = [0, *ends.tolist(), len(ids)]
        return [ids[x:y] for x, y in pairwise(cuts)]

    def codes(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        found = list(map(self.kept.get, words))
        missing = [k for k, code in enumerate(found) if code is None]
        unknown = []
        for k in missing:
            found[k] = self.older.get(words[k])
            if found[k] is None:
                unknown.append(k)
        for at in range(0, len(unknown), ASKED):
            some = unknown[at : at + ASKED]
            for k, code in zip(some, self.learn([words[k] for k in some])):
                found[k] = code
        if len(self.kept) + len(missing) > KEPT_WORDS:
            self.kept, self.older = {"": b""}, self.kept
        for k in missing[:KEPT_WORDS]:
            if len(words[k]) <= KEPT_LENGTH:
                self.kept[words[k]] = found[k]
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, ``end_id`` behind each, and how many each text has.

        The words of all texts are one column, of which Arrow makes a dictionary; only its words are looked up. White
        space carries no ids and a run of punctuation is a word of its own, so a blank before it changes nothing.
        """
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts.cast(pa.large_string()), **PUNCTUATION))
        flat = words.flatten().dictionary_encode()
        codes = self.codes(flat.dictionary.to_pylist())
        sizes = np.concatenate([[0], np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // self.width, [1]])
        values = np.append(np.frombuffer(b"".join(codes), dtype=self.kind), np.array(end_id, dtype=self.kind))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values))
        starts = words.offsets.to_numpy() - words.offsets[0].as_py()
        number = np.insert(flat.indices.to_numpy().astype(np.int64), starts[1:], len(codes))
        ids = lists.take(pa.array(number)).flatten().to_numpy()
        reached = np.append(0, np.cumsum(sizes[1:][number]))[starts + np.arange(len(starts))]
        return ids, np.diff(reached)


@lru_cache(maxsize=2)
def coder_of(path: str) -> WordCoder:
    return WordCoder(path)


def _shard(folder: str, number: int) -> str:
    return f"{folder}/ids-{number:08d}.bin"


def _sliced(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of about ``SLICE`` bytes together."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield texts[at:to]
        at = to


def _written(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = coder_of(path), TaskContext.get().partitionId()
        store, target = open_path(_shard(folder, number))
        partial, sink, offset, waiting, held = f"{target}.{uuid.uuid4().hex}", None, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, text = [], batch.column("text")
            for part in _sliced(text):
                ids, counts = coder.encode(part, end_id)
                waiting.append(ids.tobytes())
                lengths.append(counts)
                held += len(waiting[-1])
                if held >= PIECE:
                    sink = sink or store.open_output_stream(partial)
                    sink.write(b"".join(waiting))
                    waiting.clear()
                    held = 0
            lengths = np.concatenate(lengths)
            starts = offset + np.cumsum(lengths) - lengths
            offset += int(lengths.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([number] * batch.num_rows, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64())], names=["doc_id", "shard", "offset", "n_tokens"],
            )
        if offset:
            sink = sink or store.open_output_stream(partial)
            sink.write(b"".join(waiting))
            sink.close()
            store.move(partial, target)

    return run


def _mixed(keys: np.ndarray, seed) -> np.ndarray:
    x = keys.astype(np.uint64) + (np.atleast_1d(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 40) >> np.uint64(32)).astype("<u4")


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Displacement of every group: from 0 on a seed, below 0 the slot (as -1 - slot) of a group of one."""
    n = len(keys)
    groups = max(1, -(-n // GROUP))
    of = (_mixed(keys, 0) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=groups)
    ends = np.cumsum(sizes)
    moves, free = np.zeros(groups, dtype="<i4"), np.ones(n, dtype=bool)
    for size in range(int(sizes.max(initial=0)), 1, -1):
        # all groups of a size look for places together; of those that want the same one the first gets it
        open_groups, seed = np.flatnonzero(sizes == size), 1
        own = keys[order[(ends[open_groups] - size)[:, None] + np.arange(size)]]
        while len(open_groups):
            seeds = np.arange(seed, seed + SEEDS)
            slots = (_mixed(own[:, None, :], seeds[:, None]) % np.uint64(n)).astype(np.int64)
            ordered = np.sort(slots, axis=2)
            good = free[slots].all(axis=2) & (ordered[:, :, 1:] != ordered[:, :, :-1]).all(axis=2)
            some = np.flatnonzero(good.any(axis=1))
            first = good[some].argmax(axis=1)
            wanted = slots[some, first]
            taker = np.full(n, len(some))
            np.minimum.at(taker, wanted.ravel(), np.repeat(np.arange(len(some)), size))
            placed = (taker[wanted] == np.arange(len(some))[:, None]).all(axis=1)
            moves[open_groups[some[placed]]] = seed + first[placed]
            free[wanted[placed].ravel()] = False
            left = np.setdiff1d(np.arange(len(open_groups)), some[placed])
            open_groups, own = open_groups[left], own[left]
            seed += SEEDS if not placed.any() else 0
    single = np.flatnonzero(sizes == 1)
    places = np.flatnonzero(free)
    moves[single] = -1 - places[: len(single)]
    return moves


def slots_of(keys: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    move = moves[(_mixed(keys, 0) % np.uint64(len(moves))).astype(np.int64)].astype(np.int64)
    hashed = (_mixed(keys, np.maximum(move, 0)) % np.uint64(max(n, 1))).astype(np.int64)
    return np.where(move < 0, -1 - move, hashed)


def _index_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """The index of one bucket, as arrays by slot."""
    keys = rows["doc_id"].to_numpy().astype(np.int64).view(np.uint64)
    moves = perfect_hash(keys)
    order = np.argsort(slots_of(keys, moves, len(keys)))
    kept = {"shards": "<i4", "offsets": "<i8", "lengths": "<i8"}
    names = {"shards": "shard", "offsets": "offset", "lengths": "n_tokens"}
    return pd.DataFrame(
        {
            "bucket": [int(rows["bucket"].iloc[0])], "n": [len(keys)], "moves": [moves.tobytes()],
            "prints": [_prints(keys)[order].tobytes()],
            **{k: [rows[names[k]].to_numpy().astype(kind)[order].tobytes()] for k, kind in kept.items()},
        }
    )


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Write shards, ``manifest`` and ``index`` to ``folder``, a path that all executors share."""
    spark = docs.sparkSession
    store, base = open_path(folder)
    store.create_dir(base, recursive=True)
    ordered = texts(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    placed = ordered.mapInArrow(_written(folder, path, end_id), "doc_id long, shard int, offset long, n_tokens long")
    placed.write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    shards = placed.groupBy("shard").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("documents"))
    before = F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # one row per shard
    shards.withColumn("before", F.coalesce(before, F.lit(0))).write.parquet(f"{folder}/manifest")
    keys = placed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("shard", "offset", "n_tokens")).alias("at"))
    led_to = keys.select("at.shard", "at.offset")
    placed.join(led_to, ["shard", "offset"], "left_anti").write.parquet(f"{folder}/unkeyed")
    buckets = max(1, -(-placed.count() // BUCKET))
    keys = keys.select("doc_id", "at.*", _bucket(buckets))
    keys.groupBy("bucket").applyInPandas(_index_rows, INDEX).withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/index")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")


def _found(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({"doc_id": [], "shard": [], "offset": [], "n_tokens": []}, dtype="int64")
    if not len(keys) or not len(index):
        return empty
    row = index.iloc[0]
    wanted = keys["doc_id"].to_numpy().astype(np.int64).view(np.uint64)
    slots = slots_of(wanted, np.frombuffer(row["moves"], "<i4"), int(row["n"]))
    good = np.frombuffer(row["prints"], "<u4")[slots] == _prints(wanted)
    columns = {"shard": ("shards", "<i4"), "offset": ("offsets", "<i8"), "n_tokens": ("lengths", "<i8")}
    return pd.DataFrame(
        {"doc_id": keys["doc_id"].to_numpy()[good], **{c: np.frombuffer(row[s], k)[slots[good]] for c, (s, k) in columns.items()}}
    )


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """Shard, offset and length of each distinct key (doc_id) that the index has."""
    index = keys.sparkSession.read.parquet(f"{folder}/index")
    head = index.select("buckets").first()  # the same in every row
    wanted = keys.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    wanted = wanted.select("doc_id", _bucket(head["buckets"] if head else 1))
    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        _found, "doc_id long, shard int, offset long, n_tokens long"
    )


def unkeyed(spark: SparkSession, folder: str) -> DataFrame:
    """Shard, offset and length of the rows that no key leads to: without doc_id, or with that of an earlier row."""
    return spark.read.parquet(f"{folder}/unkeyed").select("doc_id", "shard", "offset", "n_tokens")


def read_ids(located: DataFrame, folder: str, path: str) -> DataFrame:
    """Per located row: doc_id, start (ids of all documents before it), n_tokens, ids (4 bytes each).

    Rows of a shard are read in the order of their offsets, so the file is gone through once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        width, store, file, opened = int(coder.kind[-1]), None, None, None
        for batch in batches:
            found = []
            for shard, offset, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "n_tokens"))):
                if shard != opened:
                    store, name = open_path(_shard(folder, shard))
                    file, opened = store.open_input_file(name), shard
                data = file.read_at(n * width, offset * width)
                found.append(np.frombuffer(data, dtype=coder.kind).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(found, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"],
            )

    manifest = located.sparkSession.read.parquet(f"{folder}/manifest").select("shard", "before")
    rows = located.join(manifest, "shard").withColumn("start", F.col("before") + F.col("offset"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "offset")
    return rows.select("doc_id", "shard", "offset", "n_tokens", "start").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary"
    )


def new_folder(spark: SparkSession) -> str:
    """A folder for shards below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
