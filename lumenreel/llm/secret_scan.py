"""Secret scans over an incremental ledger of blobs.

Every version of every text is addressed by its content (SHA-256). The ledger holds one row per blob and rule
version that was ever scanned, with the spans found. A run reduces its texts to distinct blobs, drops those for
which the ledger has every rule in its present version, scans each remaining blob for the missing rules only,
and joins the spans back to all rows (paths, versions) that hold the blob. Copies are combined before the
shuffle, so a blob that fills a third of the table is one row per task there.

Spans come from built-in expressions: the matches of a pattern and the gaps between them (the text split at the
pattern) alternate, so their lengths add up to the positions.

Defined results: a null text counts as empty; it has no spans. Positions count code points, ends are exclusive.
Repeated rows give repeated rows. An empty table gives no rows and adds nothing to the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

LEDGER = "sha string, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, without overlap; matches whose ``group`` is shorter than ``least`` are dropped."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    Rule("assign", 1, f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, "[0-9a-f]+", 0, 24),
)
#: The same spans with fewer matches to drop: only runs that are long enough begin a match.
_FAST = {"AKIA[A-Z0-9]+": "AKIA[A-Z0-9]{%d,}", "[0-9a-f]+": "[0-9a-f]{%d,}"}


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of one rule in a text, in order."""
    pattern = rule.pattern
    if fast := _FAST.get(pattern):
        pattern = fast % (rule.least - (4 if pattern.startswith("AKIA") else 0))
    whole, group = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, rule.group))
    gaps = F.split(text, pattern, -1)
    # (end so far, spans): a gap, then a match, for every match
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("found"))
    start = start.withField("found", F.array().cast("array<struct<start:int,end:int>>"))
    steps = F.arrays_zip(whole.alias("whole"), group.alias("part"), gaps.alias("gap"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.coalesce(F.length(x["gap"]), F.lit(0))
        end = begin + F.coalesce(F.length(x["whole"]), F.lit(0))
        long_enough = F.coalesce(F.length(x["part"]), F.lit(-1)) >= rule.least
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(long_enough, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"),
        )

    found = F.aggregate(steps, start, step, lambda state: state["found"])
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Spans per row of ``docs`` and the ledger's new rows.

    The first result has doc_id, sha and ``found`` (an array of rule, version, start and end, by start and then
    in the order of the rules). The second has the ledger's columns; append it to the ledger of the next run.
    """
    spark = docs.sparkSession
    if ledger is None:
        ledger = spark.createDataFrame([], LEDGER)
    current = [F.lit(f"{r.name}@{r.version}") for r in rules]
    label = F.concat_ws("@", "rule", F.col("version").cast("string"))
    known = ledger.filter(label.isin(*[f"{r.name}@{r.version}" for r in rules]))
    seen = known.groupBy("sha").agg(F.collect_set(label).alias("seen"))  # at most one entry per rule
    rows = texts(docs).withColumn("sha", F.sha2("text", 256))
    blobs = rows.groupBy("sha").agg(F.first("text").alias("text")).join(seen, "sha", "left")
    missing = [~F.coalesce(F.array_contains("seen", c), F.lit(False)) for c in current]
    blobs = blobs.filter(F.col("seen").isNull() | (F.size("seen") < len(rules)))
    scanned = blobs.select(
        "sha",
        F.filter(
            F.array(*(
                F.struct(
                    F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
                    F.when(todo, spans_of(F.col("text"), r)).alias("spans"),
                )
                for r, todo in zip(rules, missing)
            )),
            lambda x: x["spans"].isNotNull(),
        ).alias("new"),
    )
    fresh = written(scanned.select("sha", F.explode("new").alias("new")).select("sha", "new.*"))
    place = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))))
    spans = fresh.unionByName(known.select(*fresh.columns)).filter(F.size("spans") > 0)
    spans = spans.select("sha", "rule", "version", F.explode("spans").alias("span"), place[F.col("rule")].alias("place"))
    spans = spans.groupBy("sha").agg(
        F.sort_array(F.collect_list(F.struct("span.start", "place", "span.end", "rule", "version"))).alias("found")
    )
    spans = spans.withColumn(
        "found", F.transform("found", lambda x: F.struct(x["rule"], x["version"], x["start"], x["end"]))
    )
    return rows.select("doc_id", "sha").join(spans, "sha", "left"), fresh


def digest_columns(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per rule, the digest of all spans and the spans as text."""
    some = F.coalesce("found", F.array().cast("array<struct<rule:string,version:int,start:int,end:int>>"))
    text = F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")
    count = lambda name: F.size(F.filter(some, lambda x: x["rule"] == name)).cast("long")
    counts = [count(r.name).alias(f"n_{r.name}") for r in rules]
    return found.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))
