import hashlib
import random
from collections import Counter, defaultdict

import pytest

from lumenreel.llm import components, exact_dedup, jaccard_join

from .brute import brute_components
from .conftest import words


def brute_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, kept = hashlib.sha256(text.encode()).hexdigest(), False
        for i in ids:
            now = i == keep and not kept
            kept = kept or now
            out[i, keep, len(ids), now, sha] += 1
    return out


@pytest.mark.parametrize("most", [1, 512])
def test_exact_groups(odd_docs, most):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = exact_dedup.exact_groups(odd_docs, most=most)
    assert Counter(tuple(r)[:5] for r in found.collect()) == brute_groups(rows)


def test_exact_groups_of_hot_text(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 1500)) text")
    found = exact_dedup.exact_groups(docs)
    assert Counter(tuple(r)[:5] for r in found.collect()) == brute_groups([tuple(r) for r in docs.collect()])
    hot = found.filter("group_size = 2000")
    assert {r.route for r in hot.collect()} == {"broadcast"}


def test_deduplicated(odd_docs, no_docs):
    kept = exact_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    want = Counter()
    for (doc_id, keep, _, now, sha), n in brute_groups([(r.doc_id, r.text) for r in odd_docs.collect()]).items():
        if now:
            want[doc_id, sha] += n
    got = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect())
    assert got == want
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.deduplicated(no_docs).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 60)]
    rows = [*chain, *star, (7, 7), (41, 40), (None, 3), (200, 201), (201, 200)]
    found = components.components(spark.createDataFrame(rows, "a long, b long"))
    got = {r.node: r.root for r in found.collect()}
    assert got == {**{k: 0 for k in range(42)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


def test_jaccard_join(near_docs, odd_docs, no_docs, monkeypatch):
    for docs in (near_docs, odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = brute_components(rows)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.joined(docs).collect())
        assert got == want
    # the same through hubs: every column counts as long
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(jaccard_join, "HUBS", 1)
    rows = [(r.doc_id, r.text) for r in near_docs.collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.joined(near_docs).collect())
    assert got == brute_components(rows)
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    monkeypatch.setattr(jaccard_join, "WIDE", 8)
    monkeypatch.setattr(jaccard_join, "EXPANDED", 50)
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.joined(near_docs).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in near_docs.collect()])
    assert jaccard_join.joined(no_docs).count() == 0


def test_one_of_each(near_docs):
    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in near_docs.collect()])}
    kept = jaccard_join.one_of_each(near_docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert kept.columns == near_docs.columns


def test_jaccard_join_of_combined_passages(spark):
    """Texts of two of a few passages share half their shingles, those of one group nearly enough of them."""
    pick, rows = random.Random(3), []
    passages = [words(9000 + k, 60) for k in range(9)]
    for k in range(320):
        if k % 2:
            text = [*passages[k % 9], *passages[pick.randrange(9)], *words(9100 + k, pick.randint(0, 3))]
        else:
            text = words(9099, 150)
            for _ in range(pick.randint(2, 6)):
                text[pick.randrange(150)] = "edit%d" % pick.randrange(10**6)
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.joined(docs).collect())
    assert got == brute_components(rows)
    assert 1 < len({c for _, _, c in got}) < len(rows)


def test_jaccard_join_hands_on_fewer_links_than_rows():
    """A tile of a group of near copies, all of them linked: one link less than sets."""
    import numpy as np
    import pandas as pd

    base = np.arange(100, dtype="<u8")
    rows = pd.DataFrame(
        {"node": range(300), "n": 101, "root": range(300), "second": False,
         "shared": [np.append(base, np.uint64(1000 + k)).astype("<u8").tobytes() for k in range(300)]}
    )
    assert len(jaccard_join._tile_links(rows)) == 299
