import math
import re
from collections import Counter, defaultdict

from lumenreel.llm import mixing


def uneven(spark, n=3000):
    return spark.range(n).selectExpr(
        "id doc_id", "concat_ws(' ', transform(sequence(1, int(1 + id % 17)), k -> concat('w', k))) text",
        "case when id % 3 = 0 then 'hot' when id % 50 = 1 then 'rare' when id % 7 = 2 then null else concat('s', id % 4) end source",
    )


def shares(docs):
    total = Counter()
    for r in docs.collect():
        total[r.source] += len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
    return total


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def test_temperature(spark):
    docs = uneven(spark)
    tokens = shares(docs)
    budget = sum(tokens.values())
    found = mixing.mixed(docs, target_entropy=0.97, max_repeats=10.0).collect()
    exponent = found[0].exponent
    powers = {s: t**exponent for s, t in tokens.items()}
    z = sum(powers.values())
    weights = {s: p / z for s, p in powers.items()}
    assert 0 < exponent < 1 and abs(entropy(weights.values()) - 0.97 * math.log(len(tokens))) < 1e-4
    taken, largest = Counter(), defaultdict(int)
    per_doc = defaultdict(list)
    for r in found:
        taken[r.source] += r.tokens
        largest[r.source] = max(largest[r.source], r.tokens)
        per_doc[r.doc_id].append(r.epoch)
    for s, w in weights.items():
        wanted = min(round(w * budget), 10 * tokens[s])
        assert wanted - largest[s] < taken[s] <= wanted, s
    assert all(sorted(e) == list(range(len(e))) for e in per_doc.values())
    # every document of a source is taken as often as any other, or once more
    for s in tokens:
        times = {len(per_doc.get(r.doc_id, [])) for r in docs.collect() if r.source == s}
        assert max(times) - min(times) <= 1
    assert all(0 <= r.place <= 1 for r in found)


def test_repetition_limit(spark):
    docs = uneven(spark)
    tokens = shares(docs)
    found = mixing.mixed(docs, target_entropy=1.0, max_repeats=1.5).collect()
    taken = Counter()
    for r in found:
        taken[r.source] += r.tokens
    assert all(taken[s] <= 1.5 * t for s, t in tokens.items()) and found[0].exponent > 0
    # more than there is: each source as often as allowed
    most = Counter()
    for r in mixing.mixed(docs, budget=10 * sum(tokens.values()), max_repeats=2.0).collect():
        most[r.source] += r.tokens
    assert most == Counter({s: 2 * t for s, t in tokens.items()})


def test_mixed_documents(spark, odd_docs, no_docs):
    for docs in (uneven(spark), odd_docs):
        rows = mixing.mixed_documents(docs, target_entropy=0.97, max_repeats=3.0)
        assert rows.columns == docs.columns
        want = mixing.mixed(docs, target_entropy=0.97, max_repeats=3.0)
        assert Counter((r.doc_id, r.source) for r in rows.collect()) == Counter((r.doc_id, r.source) for r in want.collect())
    assert mixing.mixed(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_hot_source_has_many_blocks(spark):
    rows = uneven(spark, 9000).filter("source = 'hot'")
    found = mixing.mixed(rows, budget=5000, target_entropy=0.9, max_repeats=2.0).collect()
    assert len({r.block for r in found}) >= 1 and 5000 - 17 < sum(r.tokens for r in found) <= 5000
