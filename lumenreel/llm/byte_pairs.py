"""Byte-pair encoding and decoding of whole texts.

A piece is encoded with a priority queue of merge ranks over a doubly linked list of symbols: the queue's
best entry is merged if both its symbols still stand, else it is stale and skipped, so a piece of n symbols
takes O(n log n) whatever its length. Decoding concatenates the vocabulary's byte strings. Equal pieces
recur, so each worker keeps the ids of short pieces in two tables of bounded size, the older of which is
dropped when the younger is full.

Rows stay where they are read: no shuffle, and a lost task is simply run again.

Defined results: a null text counts as empty and gives no ids and an empty decoded text. Strings of added
special tokens inside a text become their ids. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

#: Bytes of each of a worker's two tables, what an entry takes besides its letters and ids, and the longest piece kept.
KEPT_BYTES = 20_000_000
ENTRY_BYTES = 240
KEPT_LENGTH = 48
#: Fixed pattern of the byte-level split that the vocabulary was made for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class BytePairs:
    """One vocabulary: ``encode`` gives a text's ids as little-endian 32-bit integers, ``decode`` its bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()
        ids = stored["model"]["vocab"]
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.strings = [b""] * (max([*ids.values(), *(t["id"] for t in stored["added_tokens"])]) + 1)
        for token, i in ids.items():
            self.strings[i] = to_bytes(token)
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(stored["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.added = {t["content"]: t["id"] for t in stored["added_tokens"]}
        for content, i in self.added.items():
            self.strings[i] = content.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.pieces = regex.compile(SPLIT)
        self.kept_bytes = 0
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, best rank first, leftmost first among equals."""
        n, merges = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for at in range(n - 1):
            if found := merges.get((symbols[at], symbols[at + 1])):
                queue.append((found[0], at, symbols[at], symbols[at + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, left, right, whole = heapq.heappop(queue)
            next_at = after[at]
            if symbols[at] != left or next_at >= n or symbols[next_at] != right:
                continue  # one of the two was merged meanwhile
            symbols[at], symbols[next_at] = whole, -1
            beyond = after[at] = after[next_at]
            if beyond < n:
                before[beyond] = at
                if found := merges.get((whole, symbols[beyond])):
                    heapq.heappush(queue, (found[0], at, whole, symbols[beyond], found[1]))
            ahead = before[at]
            if ahead >= 0 and (found := merges.get((symbols[ahead], whole))):
                heapq.heappush(queue, (found[0], ahead, symbols[ahead], whole, found[1]))
        return [s for s in symbols if s >= 0]

    def piece(self, piece: str) -> bytes:
        found = self.kept.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                ids = self.merged([self.of_byte[b] for b in piece.encode()])
                found = pack(f"<{len(ids)}I", *ids)
            if len(piece) <= KEPT_LENGTH:
                if self.kept_bytes >= KEPT_BYTES:
                    self.kept, self.older, self.kept_bytes = {}, self.kept, 0
                self.kept[piece] = found
                self.kept_bytes += ENTRY_BYTES + 2 * len(piece) + len(found)
        return found

    def plain(self, text: str) -> bytes:
        pieces = self.pieces.findall(text)
        found = list(map(self.kept.get, pieces))
        if None in found:
            found = [self.piece(p) if f is None else f for p, f in zip(pieces, found)]
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if self.special is None or self.special.search(text) is None:
            return self.plain(text)
        parts = self.special.split(text)
        return b"".join(
            np.array([self.added[p]], dtype="<u4").tobytes() if k % 2 else self.plain(p) for k, p in enumerate(parts)
        )

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return data.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def coder_of(path: str) -> BytePairs:
    """One vocabulary and its tables for all tasks of a worker."""
    return BytePairs(path)


def _over(path: str, columns: list[tuple[str, pa.DataType]], values):
    schema = pa.schema([("doc_id", pa.int64()), *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            rows = [values(coder, text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(columns))],
                schema=schema,
            )

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens and ``ids``, little-endian unsigned 32-bit integers in one binary value."""
    values = lambda coder, text: (len(ids := coder.encode(text)) // 4, ids)
    return texts(docs).mapInArrow(
        _over(path, [("n_tokens", pa.int64()), ("ids", pa.binary())], values), "doc_id long, n_tokens long, ids binary"
    )


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """Per row of :func:`encoded`: doc_id and the text of its ids; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            found = pa.array([coder.decode(x.as_py() or b"") for x in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of its ids and of the text decoded from them."""

    def values(coder: BytePairs, text: str):
        ids = coder.encode(text)
        return (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()
        )

    columns = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return texts(docs).mapInArrow(
        _over(path, columns, values), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
