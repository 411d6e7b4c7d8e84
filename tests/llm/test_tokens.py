import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumenreel.llm import byte_pairs, token_counts, token_shards

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def random_texts(n):
    pick = random.Random(3)
    letters = [*"abcdefghijklmnop   éßü中▁'1290.,\n\t🙂", " the", "  ", "<|endoftext|>", "</s>", "'ll"]
    return ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(n)]


def test_byte_pairs_against_library():
    coder, library = byte_pairs.BytePairs(BYTES), Tokenizer.from_file(BYTES)
    for text in [*random_texts(1500), "", "a" * 20_000, " " * 5000, "ab " * 3000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids
        assert coder.decode(coder.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_round_trip(odd_docs, no_docs):
    library, want = Tokenizer.from_file(BYTES), Counter()
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[
            r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((r.text or "").encode()).hexdigest(),
        ] += 1
    assert Counter(map(tuple, byte_pairs.round_trip(odd_docs, BYTES).collect())) == want
    assert byte_pairs.round_trip(no_docs, BYTES).count() == 0
    back = byte_pairs.decoded(byte_pairs.encoded(odd_docs, BYTES), BYTES)
    assert Counter(map(tuple, back.collect())) == Counter((r.doc_id, r.text or "") for r in odd_docs.collect())


@pytest.mark.parametrize("chunk", [5, 64, token_counts.CHUNK])
def test_transducer_against_library(chunk):
    machine, library = token_counts.Transducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in [*random_texts(800), "", " ", " " * 300, "x" * 5000, "a\n" * 500, " ▁▁ の"]:
        assert token_counts.count_tokens(machine, text, chunk) == len(library.encode(text)), text


def test_transducer_begins_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_STATES", 50)
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 20)
    machine, library = token_counts.Transducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in random_texts(200):
        assert token_counts.count_tokens(machine, text) == len(library.encode(text))
    assert len(machine.counted) <= 20


def test_token_counts(odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for r in odd_docs.collect():
        n = len(library.encode(r.text or ""))
        want[r.doc_id, len((r.text or "").encode()), n, n > 4096] += 1
    assert Counter(map(tuple, token_counts.token_counts(odd_docs, PIECES).collect())) == want
    assert token_counts.token_counts(no_docs, PIECES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).permutation(10 * n + 1)[:n].astype(np.uint64) * np.uint64(977)
    moves = token_shards.perfect_hash(keys)
    assert sorted(token_shards.slots_of(keys, moves, n)) == list(range(n))


def test_shards(spark, odd_docs, no_docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    token_shards.write_shards(odd_docs, folder, WORDS, end_id=1)
    found = token_shards.read_ids(token_shards.lookup(odd_docs.select("doc_id"), folder), folder, WORDS)
    rest = token_shards.read_ids(token_shards.unkeyed(spark, folder), folder, WORDS).collect()
    library, at, want, others = Tokenizer.from_file(WORDS), 0, {}, []
    for r in sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        if r.doc_id is not None and r.doc_id not in want:
            want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        else:
            others.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found.collect()} == want
    assert Counter((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rest) == Counter(others) and len(others) == 4
    strange = spark.createDataFrame([(99,), (-99,), (None,), (4,)], "doc_id long")
    assert [r.doc_id for r in token_shards.lookup(strange, folder).collect()] == [4]
    empty = f"file://{tmp_path}/empty"
    token_shards.write_shards(no_docs, empty, WORDS, end_id=1)
    assert token_shards.lookup(odd_docs.select("doc_id"), empty).count() == 0
