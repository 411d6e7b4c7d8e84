"""Hard negatives, SimHash and spelling variants against plain versions."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash

from lumenreel.llm import hard_negatives, simhash, spelling

VECTORS = "vec_id long, embedding array<float>, label int, anchor long, place long, score long, n long"


def brute_negatives(rows):
    """rows: (vec_id, vector, label) without nulls, in the order in which ties of equal ids are settled."""
    width = max((len(v) for _, v, _ in rows), default=0)
    q = np.zeros((len(rows), width), dtype=object)
    for k, (_, vector, _) in enumerate(rows):
        for j, x in enumerate(vector):
            q[k, j] = int(np.floor(256 * float(np.float32(x))))
    labels = [(b + 1) % 10 if i is not None and i % 7 == 0 else b for i, _, b in rows]
    found = Counter()
    for a, (anchor, _, _) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scores = q @ q[a]
        order = sorted(range(len(rows)), key=lambda k: (-scores[k], rows[k][0] is None, rows[k][0] or 0, k))
        for p in [k for k in order if k != a and labels[k] == labels[a]][:5]:
            fit = [k for k in order if labels[k] != labels[a] and 30 * scores[p] <= 100 * scores[k] <= 90 * scores[p]]
            for rank, k in enumerate(fit[:10], 1):
                found[anchor, rows[p][0], rank, rows[k][0], scores[p], scores[k]] += 1
    return found


@pytest.mark.parametrize("wave_bytes", [300, 8 << 20])
def test_hard_negatives(spark, monkeypatch, wave_bytes):
    monkeypatch.setattr(hard_negatives, "WAVE_BYTES", wave_bytes)
    pick = np.random.default_rng(5)
    vectors = pick.normal(size=(700, 12)).astype(np.float32).round(2)
    vectors[300:500] = vectors[300]  # a very common vector
    rows = [(int(k), [float(x) for x in vectors[k]], int(k) % 3) for k in range(700)]
    rows += [(None, rows[3][1], 0), (600, rows[5][1], 1), (600, rows[5][1], 1), (701, [1.0], 0), (702, [], 1), (800, rows[9][1], 77)]
    taken = list(rows)
    rows += [(900, None, 1), (1000, [1.0, None], 1), (1100, [float("nan")], 1), (1200, [float("inf")] * 12, 1), (1300, [1.0] * 12, None)]
    table = spark.createDataFrame([(i, v, b, 1, 2, 3, 4) for i, v, b in rows], VECTORS)
    got = hard_negatives.hard_negatives(table.coalesce(1) if wave_bytes > 300 else table.repartition(5)).collect()
    assert Counter(map(tuple, got)) == brute_negatives(taken)


def test_hard_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(empty).count() == 0
    no_anchor = spark.createDataFrame([(1, [1.0], 1, 0, 0, 0, 0)], VECTORS)
    assert hard_negatives.hard_negatives(no_anchor).count() == 0
    huge = spark.createDataFrame([(k, [3e38 - k, -3e38], k % 2, 0, 0, 0, 0) for k in range(0, 1200, 100)], VECTORS)
    assert hard_negatives.hard_negatives(huge).count() == 0  # equal scores aren't inside a window


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    """Counter of (doc_id, fingerprint, smallest id of its class) of rows (doc_id, fingerprint)."""
    distinct = sorted({f for _, f in rows})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in rows)


def test_simhash(spark, odd_docs, no_docs, near_docs):
    for docs in (odd_docs, near_docs):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == brute_classes(rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_of_pieces(monkeypatch):
    text = " ".join(f"Word{k * k % 97}é" for k in range(3000)).encode()
    want = simhash.fingerprint(text)
    assert want == brute_fingerprint(text.decode())
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == want and simhash.fingerprint(b"w" * 50) == brute_fingerprint("w" * 50)


@pytest.mark.parametrize("size", [8, 1 << 14])
def test_bit_slices_find_all_links(spark, size):
    """Families of fingerprints some bits apart, and strangers; slices of any length give the same classes."""
    pick = random.Random(3)
    numbers = [pick.getrandbits(64) for _ in range(300)]
    for base in numbers[:12]:
        for _ in range(pick.choice([1, 5, 60])):
            for b in pick.sample(range(64), pick.randint(1, 5)):
                base ^= 1 << b
            numbers.append(base)
    numbers += [0, 7, 15, (1 << 64) - 1]
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in numbers], "fingerprint long")
    found = simhash.links(rows, size).collect()
    unsigned = lambda x: x % (1 << 64)
    root = {x: x for x in numbers}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        root[find(unsigned(r.a))] = find(unsigned(r.b))
    got = {}
    for x in numbers:
        got.setdefault(find(x), set()).add(f"{x:016x}")
    want = {}
    for k, f, c in brute_classes(list(enumerate(numbers))):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("n", [1, 1 << 25, 1 << 34])
def test_parts_are_shared_within_the_radius(n):
    pick = random.Random(n)
    masks = simhash.shared_parts(n)
    for _ in range(300):
        differ = sum(1 << b for b in pick.sample(range(64), 3))
        assert any(not differ & mask for mask in masks)


def brute_spelling(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    found, forms = {}, {}
    for w in n:
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 10 * n[w] else None
        found[w] = len(others)
    out = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, n[w], found[w], forms[w], n[forms[w]] if forms[w] else None, root))
    return out


def test_spelling(spark, odd_docs, no_docs, monkeypatch):
    pick = random.Random(11)
    base = ["".join(pick.choice("abéÿÀz") for _ in range(pick.randint(7, 9))) for _ in range(12)] + ["aaaaaaaa", "aaaaaaab", "àààààààà"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(pick.randint(0, 30)):
            w = list(pick.choice(base[: 1 + pick.randrange(len(base))]))
            if pick.random() < 0.2:
                at = pick.randrange(len(w))
                w[at : at + 1] = pick.choice([[], ["a"], [w[at], "b"], [w[at], w[at]]])
            words.append("".join(w).upper() if pick.random() < 0.1 else "".join(w))
        rows.append((k if k % 50 else None, pick.choice([" ", "1", "-", "ł", "🙂"]).join(words) or None))
    chain = ["chained"] * 2000 + ["chainee"] * 200 + ["chaineee"] * 20 + ["chaineeee"] * 2
    rows.append((9999, " ".join(chain)))
    docs = spark.createDataFrame([(t, i, 1, "w") for i, t in rows], "text string, doc_id long, n long, word string").repartition(3)
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    assert Counter(map(tuple, spelling.spelling_groups(docs).select(*columns).collect())) == Counter(brute_spelling(rows))
    odd = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, spelling.spelling_groups(odd_docs).select(*columns).collect())) == Counter(brute_spelling(odd))
    assert spelling.spelling_groups(no_docs).count() == 0


def test_words_of_pieces(monkeypatch):
    text = "Émigrés-abcdefghij " * 40 + "x" * 30 + "ÀÉÿÀÉÿÀ"
    want = spelling.words_of(3, text)
    monkeypatch.setattr(spelling, "PIECE", 5)
    assert spelling.words_of(3, text) == want and sum(want.values()) > 40
