"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_pairs, exact_dedup, fingerprints, hard_negatives, jaccard_join, mixing, secret_scan, simhash, spelling,
    token_counts, token_shards, tool_links, toxicity,
)
from .common import table


#: Tools of the calls that are derived from conversations.
TOOLS = {
    "search": {
        "type": "object", "required": ["query"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 40}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}},
    },
    "count": {
        "type": "object", "required": ["query", "limit"],
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 3}},
    },
}


def op1_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn is a call that needs the calls two and four turns before; every user turn is a result."""
    turns = table(spark, sf_dir, "conversations")
    call_id = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    size = F.length("text")
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", call_id(0).alias("call_id"), "turn",
        F.when(size % 3 == 0, "search").when(size % 3 == 1, "count").otherwise("draw").alias("name"),
        F.to_json(F.struct("text", (size % 60 - 2).alias("limit")).cast("struct<query:string,limit:int>")).alias("arguments"),
        F.when(F.col("turn") >= 4, F.array(call_id(2), call_id(4))).when(F.col("turn") >= 2, F.array(call_id(2))).alias("needs"),
    )
    results = turns.filter("role = 'user'").select("conv_id", call_id(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return tool_links.linked(calls, results, TOOLS)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("route")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(table(spark, sf_dir, "documents"))
    return secret_scan.digest_columns(found)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), learnable=~toxicity.held_out(F.col("doc_id")))
    return toxicity.scored(docs, model)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, limit=4096)


def op6_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), target_entropy=0.95, max_repeats=2.0)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    folder = token_shards.new_folder(spark)
    token_shards.write_shards(docs, folder, path, end_id=1)
    located = token_shards.lookup(docs.select("doc_id"), folder).unionByName(token_shards.unkeyed(spark, folder))
    found = token_shards.read_ids(located, folder, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_tool_links, op2_exact_dedup, op3_secret_scan, op4_toxicity, op5_token_counts, op6_byte_pairs, op7_mixing,
    op8_token_shards, op9_fingerprints, op10_jaccard_join, op11_hard_negatives, op12_simhash, op13_spelling,
)}

_ASSIGN = secret_scan.RULES[0].pattern.replace("'", "''")


def _gaps(kind: str, place: int, pattern: str, kept: str) -> str:
    """Spans of one pattern: matches and gaps alternate, so running lengths give positions."""
    return f"""
        SELECT doc_id, '{kind}' AS kind, {place} AS place, begins, begins + length(whole) AS ends FROM (
            SELECT doc_id, whole, part,
                   sum(length(gap)) OVER upto + coalesce(sum(length(whole)) OVER before, 0) AS begins
            FROM (
                SELECT doc_id, unnest(wholes) AS whole, unnest(parts) AS part, unnest(gaps) AS gap,
                       generate_subscripts(wholes, 1) AS nth
                FROM (
                    SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS wholes,
                           regexp_extract_all(text, '{pattern}', {kept}) AS parts,
                           regexp_split_to_array(text, '{pattern}')[1:len(wholes)] AS gaps
                    FROM documents WHERE regexp_matches(text, '{pattern}')
                )
            )
            WINDOW upto AS (PARTITION BY doc_id ORDER BY nth),
                   before AS (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        )"""


def _crc32(data: str) -> str:
    """CRC-32 of a list of bytes, four bits at a time."""
    rest = []
    for number in range(16):
        for _ in range(4):
            number = number >> 1 ^ (0xEDB88320 if number & 1 else 0)
        rest.append(number)
    half = lambda x: f"xor(list_extract({rest}, ({x} & 15) + 1)::BIGINT, {x} >> 4)"
    return f"xor(list_reduce({data}, lambda c, b: {half(half('xor(c, b)'))}, 4294967295::BIGINT), 4294967295::BIGINT)"


#: UTF-8 of a string whose characters are below U+0800.
_BYTES = """flatten(list_transform(string_split({0}, ''), lambda x: CASE
    WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::BIGINT[] END))"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op1_tool_links": """
        WITH RECURSIVE calls AS (
            SELECT conv_id, turn, 'c' || turn AS call_id, text, length(text) % 60 - 2 AS lim,
                   CASE length(text) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'count' ELSE 'draw' END AS name
            FROM conversations WHERE role = 'assistant'
        ),
        needs AS (SELECT conv_id, turn, turn - 2 AS need FROM calls WHERE turn >= 2
                  UNION ALL SELECT conv_id, turn, turn - 4 FROM calls WHERE turn >= 4),
        edges AS (SELECT n.conv_id, n.turn, n.need FROM needs n JOIN calls c ON n.conv_id = c.conv_id AND n.need = c.turn),
        paths AS (
            SELECT conv_id, turn, 0 AS level FROM calls
            UNION SELECT e.conv_id, e.turn, p.level + 1 FROM edges e JOIN paths p ON e.conv_id = p.conv_id AND e.need = p.turn
        ),
        lost AS (
            SELECT conv_id, turn, count(*) AS lost FROM needs n
            WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = n.conv_id AND c.turn = n.need) GROUP BY ALL
        ),
        results AS (SELECT conv_id, turn, turn - 1 AS call_turn, text FROM conversations WHERE role = 'user'),
        linked AS (
            SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, 'c' || r.call_turn) AS call_id, c.name,
                   (SELECT max(level) FROM paths p WHERE p.conv_id = c.conv_id AND p.turn = c.turn) AS level,
                   c.turn, r.turn AS result_turn, c.text, c.lim, r.text AS content, c.call_id IS NOT NULL AS called,
                   coalesce(l.lost, 0) AS lost
            FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.call_turn
            LEFT JOIN lost l ON l.conv_id = c.conv_id AND l.turn = c.turn
        )
        SELECT conv_id, call_id, name, level, turn, result_turn,
               concat_ws(',', CASE WHEN NOT called THEN 'orphan_result' END, CASE WHEN lost > 0 THEN 'unknown_need' END,
                         CASE WHEN name = 'draw' THEN 'unknown_tool' END,
                         CASE WHEN (name = 'search' AND lim < 1) OR (name = 'count' AND lim < 3) THEN 'minimum:.limit' END,
                         CASE WHEN name = 'search' AND lim > 50 THEN 'maximum:.limit' END,
                         CASE WHEN name = 'search' AND length(text) < 40 THEN 'minLength:.query' END) AS errors,
               CASE WHEN called THEN '{"arguments":{"limit":' || lim || ',"query":' || to_json(text) || '},"id":"' || call_id
                         || '","name":"' || name || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}'
                    ELSE '{"id":"' || call_id || '","result":' || to_json(content) || '}' END AS message
        FROM linked
    """,
    "op3_secret_scan": f"""
        WITH spans AS (
            {_gaps("assign", 0, _ASSIGN, "2")} WHERE length(part) >= 6
            UNION ALL {_gaps("access", 1, "AKIA[A-Z0-9]+", "0")} WHERE length(part) >= 20
            UNION ALL {_gaps("hex", 2, "[0-9a-f]+", "0")} WHERE length(part) >= 24
        ),
        found AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg(kind || ':' || begins || ':' || ends, ',' ORDER BY begins, place) AS spans
            FROM spans GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN found USING (doc_id)
    """,
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_hard_negatives": """
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score
            FROM whole a JOIN whole r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
        ),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
    "op13_spelling": f"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') || ':' AS doc, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
            WHERE length(run) >= 7 GROUP BY ALL
        ),
        hashed AS (SELECT run, n, {_crc32(_BYTES.format("doc || run"))} AS h FROM runs),
        words AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT)
                        ELSE run END AS word, sum(n)::BIGINT AS n
            FROM hashed GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2
        ),
        holes AS (
            SELECT word, n, place, substr(word, 1, place - 1) AS head, substr(word, place + 1) AS tail
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)
        ),
        shorter AS (SELECT DISTINCT h.word AS long_word, h.n AS long_n, w.word, w.n FROM holes h JOIN words w ON h.head || h.tail = w.word),
        near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n
            FROM holes a JOIN holes b ON a.place = b.place AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
            UNION ALL SELECT long_word, long_n, word, n FROM shorter
            UNION ALL SELECT word, n, long_word, long_n FROM shorter
        ),
        best AS (
            SELECT word, count(*) OVER (PARTITION BY word) AS n_near,
                   CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
            FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
        ),
        steps AS (
            SELECT word, word AS root FROM words
            UNION SELECT s.word, b.form FROM steps s JOIN best b ON s.root = b.word WHERE b.form IS NOT NULL
        ),
        ends AS (SELECT s.word, s.root FROM steps s LEFT JOIN best b ON s.root = b.word WHERE b.form IS NULL)
        SELECT word, n, coalesce(n_near, 0) AS n_near, form, form_n, root FROM words LEFT JOIN best USING (word) JOIN ends USING (word)
    """,
}
