"""Token counts of whole texts by a compiled finite-state transducer.

The vocabulary's piece encoding is compiled, state by state as texts reach them, to a deterministic
transducer. A state holds what can still matter of the past: for every recent position from which some
vocabulary piece may yet be completed, the piece started there, the token that ends there and the number of
tokens up to there. A transition reads a character and is annotated with the change of the token count. Which
token ends at a position follows from pairwise compatibility: exactly one token that is a whole by itself ends
there and stands unmerged beside the token before it.

A text is cut into chunks. Each chunk gets its state map: the map is constant beyond the first place where the
transducer always falls back to its start (before white space, around characters outside the vocabulary), so
it is kept as the short head up to there, the count of the middle and the state at the end. Maps compose
associatively and are combined pairwise in a tree, a prefix scan over the chunks.

Runs of white space are one unit: their pieces all have the same rank, merge after everything else and only
with each other, unless the last blank is taken by the word after it.

Defined results: a null text counts as empty and has 0 tokens. Strings that look like special tokens are
ordinary text. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

#: Characters of a chunk.
CHUNK = 16_384
#: Compiled states and counted words a worker keeps; beyond that it begins anew.
KEPT_STATES = 200_000
KEPT_WORDS = 500_000
KEPT_LENGTH = 48
BLANK = "▁"
START = 0


class Vocabulary:
    """Pieces of a sentencepiece BPE model and their scores, read from the file's own message format."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as messages

        model = messages.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = messages.ModelProto.SentencePiece.NORMAL
        self.score = {p.piece: p.score for p in model.pieces if p.type == normal}
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("only models without normalisation and with a leading blank are supported")
        if not trainer.byte_fallback or any(re.search(f"[^{BLANK}]{BLANK}|{BLANK}{BLANK}[^{BLANK}]", p) for p in self.score):
            raise ValueError("pieces that cross from a word into white space are not supported")
        self.letters = {c for p in self.score for c in p}

    def encode(self, text: str) -> list[str]:
        """Merge neighbours whose union is a piece, best score first, leftmost first among equals."""
        symbols, score = list(text), self.score
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def offer(at: int, to: int) -> None:
            if at >= 0 and to < n and (whole := symbols[at] + symbols[to]) in score:
                heapq.heappush(queue, (-score[whole], at, len(whole), symbols[at]))

        for at in range(n - 1):
            offer(at, at + 1)
        while queue:
            _, at, length, left = heapq.heappop(queue)
            to = after[at]
            if symbols[at] != left or to >= n or len(left) + len(symbols[to]) != length:
                continue
            symbols[at], symbols[to] = left + symbols[to], ""
            beyond = after[at] = after[to]
            if beyond < n:
                before[beyond] = at
            offer(at, beyond)
            offer(before[at], at)
        return [s for s in symbols if s]


class Transducer:
    """The compiled counter; states are numbers, :data:`START` is the start."""

    def __init__(self, path: str):
        self.words = Vocabulary(path)
        self.begins = {p[:k] for p in self.words.score for k in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.runs: dict[int, int] = {}
        self.counted: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [(("", "", 0),)]
        self.numbers = {self.states[0]: START}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def is_token(self, token: str) -> bool:
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = len(token) == 1 or (
                token in self.words.score and self.words.encode(token) == [token]
            )
        return found

    def stand(self, left: str, right: str) -> bool:
        """Both stay unmerged when they meet. An empty left side is the start, where nothing merges."""
        if not left:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= 4 * KEPT_STATES:
                self.pairs.clear()
            found = self.pairs[left, right] = self.words.encode(left + right) == [left, right]
        return found

    def compile(self, state: int, letter: str) -> tuple[int, int]:
        """The state after ``letter`` and the change of the token count."""
        if letter not in self.words.letters:
            return START, len(letter.encode())  # bytes that merge with nothing
        grown = [(piece + letter, left, count) for piece, left, count in self.states[state]]
        ended = next(
            (left_piece for left_piece in grown if self.is_token(left_piece[0]) and self.stand(left_piece[1], left_piece[0])),
            None,
        )
        if ended is None:
            raise ValueError(f"no token can end after {grown!r}")
        delta = ended[2] + 1
        left = [(piece, token, count - delta) for piece, token, count in grown if piece in self.begins]
        content = (*left, ("", ended[0], 0))
        number = self.numbers.get(content)
        if number is None:
            number = self.numbers[content] = len(self.states)
            self.states.append(content)
            self.moves.append({})
        return number, delta

    def run(self, state: int, word: str) -> tuple[int, int]:
        """End state and count of ``word`` from ``state``."""
        total, moves = 0, self.moves
        for letter in word:
            step = moves[state].get(letter)
            if step is None:
                step = moves[state][letter] = self.compile(state, letter)
            state, total = step[0], total + step[1]
        return state, total

    def blanks(self, n: int) -> int:
        found = self.runs.get(n)
        if found is None:
            found = len(self.words.encode(BLANK * n)) if n else 0
            if len(self.runs) < KEPT_WORDS:
                self.runs[n] = found
        return found

    def word(self, word: str) -> int:
        """Tokens of a whole word: blanks, then other characters."""
        found = self.counted.get(word)
        if found is not None:
            return found
        body = word.lstrip(BLANK)
        n = len(word) - len(body)
        if len(self.states) >= KEPT_STATES:
            self.reset()
        if n and body:
            # the last blank either belongs to the word's first token or to the run before it
            if n == 1 or self.takes_blank(body):
                found = self.blanks(n - 1) + self.run(START, BLANK + body)[1]
            else:
                found = self.blanks(n) + self.run(START, body)[1]
        else:
            found = self.run(START, body)[1] if body else self.blanks(n)
        if len(word) <= KEPT_LENGTH:
            if len(self.counted) >= KEPT_WORDS:
                self.counted.clear()
            self.counted[word] = found
        return found

    def takes_blank(self, body: str) -> bool:
        return self.words.encode(BLANK + body)[0] != BLANK


#: A word is its blanks and what follows them; a line break is never part of a piece.
WORDS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


class ChunkMap:
    """State map of a chunk: ``head`` still depends on what came before, ``tail`` on what comes after."""

    __slots__ = ("head", "count", "tail")

    def __init__(self, head: str, count: int, tail: str | None):
        self.head, self.count, self.tail = head, count, tail


def chunk_map(machine: Transducer, chunk: str) -> ChunkMap:
    words = WORDS.findall(chunk)
    if len(words) < 2:
        return ChunkMap(chunk, 0, None)
    kept = machine.counted
    middle = words[1:-1]
    found = list(map(kept.get, middle))
    if None in found:
        found = [machine.word(w) if f is None else f for w, f in zip(middle, found)]
    return ChunkMap(words[0], sum(found), words[-1])


def compose(machine: Transducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of a's text followed by b's."""
    if a.tail is None and b.tail is None:
        seam = chunk_map(machine, a.head + b.head)
        return seam
    if a.tail is None:
        seam = chunk_map(machine, a.head + b.head)
        if seam.tail is None:
            return ChunkMap(seam.head, b.count, b.tail)
        return ChunkMap(seam.head, seam.count + machine.word(seam.tail) + b.count, b.tail)
    seam = WORDS.findall(a.tail + b.head)
    if b.tail is None:
        return ChunkMap(a.head, a.count + sum(map(machine.word, seam[:-1])), seam[-1])
    return ChunkMap(a.head, a.count + sum(map(machine.word, seam)) + b.count, b.tail)


def count_tokens(machine: Transducer, text: str, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    text = BLANK + text.replace(" ", BLANK)
    maps = [chunk_map(machine, text[k : k + chunk]) for k in range(0, len(text), chunk)]
    while len(maps) > 1:
        maps = [compose(machine, *maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    whole = maps[0]
    return sum(map(machine.word, WORDS.findall(whole.head))) + whole.count + (machine.word(whole.tail) if whole.tail else 0)


@lru_cache(maxsize=2)
def machine_of(path: str) -> Transducer:
    """One transducer for all tasks of a worker."""
    return Transducer(path)


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path)
        for batch in batches:
            found = [(len(t.encode()), count_tokens(machine, t)) for t in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()),
                    pa.array([c for _, c in found], pa.int64()), pa.array([c > limit for _, c in found], pa.bool_()),
                ],
                schema=COUNTS,
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
