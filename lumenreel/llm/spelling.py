"""Spelling variants by permuterm rotations.

A word with a terminator behind it is turned round so that each of its characters is last once. The rotations are
sorted; what comes before the last, edited character is a prefix that all words share which differ there only. A word
without that character has the whole prefix as one of its own rotations, so it falls into the same place of the order:

    near$  with its second character last:  ar$n|e      hear$, first one last:  ear$|h
    nar$   as it is, turned round:          ar$n|       ear$, as it is:         ear$|

So one scan over the sorted rotations meets all pairs with one replaced, inserted or deleted code point. A group has
one word per character of the alphabet at most (90, and the shorter word), however frequent it is. The scan hands on
how many neighbours a member has in the group and the best of them, not the pairs. A pair with a replacement meets in
one group; a shorter word meets a longer one once for each character of a run of equal ones, of which the first counts.

Occurrences are counted by task, in a table of bounded size, then over all tasks. Forms lead to words of ten times
the count, so chains of them are short; roots are found by joins that double the steps.

Defined results: a null text has no words; a null doc_id is an empty text before the colon. Repeated rows count as
often as they are there. Ties of the count go to the smallest word in code-point order. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Shortest word, fewest occurrences, how much more frequent a form is than its variant.
LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10
#: One occurrence in so many loses a character.
DAMAGED = 31
#: Words that a task counts before it hands them on; code points of a text that are read at a time.
TABLE, PIECE = 1 << 18, 1 << 20

# in Latin-1 every code point of a word is a byte, and bytes.lower() changes A-Z alone
_RUN = re.compile(rb"[a-z\xC0-\xFF]{%d,}" % LEAST_CHARS)
_LETTER = re.compile("[A-Za-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that don't cut a run."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _LETTER.match(text, end):
            end += 1
        yield text[at:end]
        at = end


def words_of(doc_id: int | None, text: str) -> Counter:
    """The words of a text (Latin-1) with their numbers of occurrences, some with a character deleted."""
    runs: Counter = Counter()
    for piece in _pieces(text):
        runs.update(_RUN.findall(piece.encode("latin-1", "replace").lower()))
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, n in runs.items():
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_CHARS:
                continue
        found[run] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def handed_on() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )
        counts.clear()
        return rows

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            counts.update(words_of(doc_id.as_py(), text.as_py()))
            if len(counts) >= TABLE:
                yield handed_on()
    if counts:
        yield handed_on()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n, its occurrences, of all words that are long and frequent enough."""
    rows = docs.filter("text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    counts = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """Every word's rotations as a ``prefix``, with the character ``edited`` after it (null: none, the word as it is).

    ``indel`` says whether deleting the character is to count: only the first of a run of equal ones does.
    """
    word, at = F.col("word"), F.col("at")
    turned = F.concat(F.substr(word, at + 1), F.lit("$"), F.substr(word, F.lit(1), at - 1))
    edited = F.substr(word, at, F.lit(1))
    # places 1 to length: that character is the edited one; the whole word is turned round by 0 to length
    ways = F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(word) + 1), lambda k: F.array(F.struct(k.alias("at"), F.lit(True).alias("whole")), F.struct(k.alias("at"), F.lit(False).alias("whole")))
    ))
    rows = words.select("word", "n", F.explode(ways).alias("way")).select("word", "n", "way.*")
    rows = rows.filter(F.col("whole") | (at <= F.length(word)))
    return rows.select(
        "word", "n",
        F.when(F.col("whole"), F.concat(F.substr(word, at), F.lit("$"), F.substr(word, F.lit(1), at - 1))).otherwise(turned).alias("prefix"),
        F.when(~F.col("whole"), edited).alias("edited"),
        (~F.col("whole") & ((at == 1) | (edited != F.substr(word, at - 1, F.lit(1))))).alias("indel"),
    )


def _better(n: Column, word: Column) -> Column:
    """Smaller is better: more occurrences, then the smaller word."""
    return F.struct((-n).alias("minus"), word.alias("word"))


def neighbours(words: DataFrame) -> DataFrame:
    """Per word that has any: n_near and the best of its near words (minus its n, word)."""
    rows = rotations(words).withColumn("rank", _better(F.col("n"), F.col("word")))
    whole = F.col("edited").isNull()
    group = W.partitionBy("prefix")
    order = W.partitionBy("prefix", whole).orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # of the words with a character after the prefix: how many, the best two, and those that the shorter word meets
    seen = rows.select(
        "word", "rank", "indel", whole.alias("whole"),
        F.count(F.when(~whole, 1)).over(group).alias("longer"),
        F.first("rank").over(order).alias("best"), F.nth_value("rank", 2).over(order).alias("second"),
        F.count(F.when(F.col("indel"), 1)).over(group).alias("indels"),
        F.min(F.when(F.col("indel"), F.col("rank"))).over(group).alias("best_indel"),
        F.min(F.when(whole, F.col("rank"))).over(group).alias("shorter"),
    ).filter("longer + if(shorter is null, 0, 1) > 1")
    other = F.when(F.col("rank") == F.col("best"), F.col("second")).otherwise(F.col("best"))
    below = F.when(F.col("indel"), F.col("shorter"))
    found = seen.select(
        "word",
        F.when(F.col("whole"), F.col("indels")).otherwise(F.col("longer") - 1 + F.when(below.isNotNull(), 1).otherwise(0)).alias("near"),
        F.when(F.col("whole"), F.col("best_indel")).otherwise(F.least(other, below)).alias("best"),
    )
    return found.filter("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word with a form."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not at.filter("open").isEmpty():
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(
            at.join(step, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")
            ),
            instead_of=at,
        )
    return at.select("word", "root")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = written(vocabulary(docs))
    near = neighbours(words)
    is_form = -F.col("best.minus") >= TIMES * F.col("n")
    rows = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"),
    ))
    return rows.join(roots(rows.filter("form is not null")), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
