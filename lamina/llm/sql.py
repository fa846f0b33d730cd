"""DuckDB SQL for the queries that SQL can express.

op1 follows reply chains whose length the data decide together with hashes of normalised passages;
op4 needs XXH64, op5 a learned list, op6 zstandard, op7 a tokenizer: these have none and are held
against plain versions in the tests.
"""

from __future__ import annotations

from .mixing import MAX_REPEATS
from .sharding import round_keys, scrambled

WORDS = r"[^\x20\x09-\x0D]+"
ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def crc32() -> str:
    """CRC-32 of the text's bytes, a nibble at a time."""
    entries = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        entries.append(i)
    case = "CASE xor(a, b) & 15 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(entries)) + " END"
    # low nibble of each byte before the high one
    nibbles = "list_transform(range(2 * octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(encode(text)), (i + 1 - 2 * (i % 2) + 1)::INTEGER, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {nibbles}), lambda a, b: xor(a >> 4, {case}::BIGINT)), 4294967295)"


def sharding(shards: int = 16, seed: int = 7, rounds: int = 6) -> str:
    def network(source: str) -> str:
        sql = f"SELECT row_id, p // b AS l, p % b AS r, a, b, n FROM {source}"
        for i, (m, c) in enumerate(round_keys(seed, rounds)):
            if i % 2 == 0:
                sql = f"SELECT row_id, (l + {scrambled('r', m, c)}) % a AS l, r, a, b, n FROM ({sql})"
            else:
                sql = f"SELECT row_id, l, (r + {scrambled('l', m, c)}) % b AS r, a, b, n FROM ({sql})"
        return f"SELECT row_id, l * b + r AS p, a, b, n FROM ({sql})"

    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, {crc32()} AS text_crc32 FROM documents),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_id FROM d),
grid AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM d)),
start AS (SELECT row_id, row_id AS p, a, b, n FROM numbered, grid),
walk AS ({network('start')} UNION ALL ({network('(SELECT * FROM walk WHERE p >= n)')}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INTEGER AS shard, p // {shards} AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN walk USING (row_id) WHERE p < n"""


WORD_REPEATS = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
t AS (SELECT k, id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i:i + 49], ' ') END AS s FROM (SELECT k, id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT k, i, word, s IS NOT NULL AND min(id) OVER (PARTITION BY s) < id AS hit FROM t),
c AS (SELECT k, i, word, max(hit::INTEGER) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT k, count(*) AS n, sum(gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (k)"""

BYTE_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT k, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 800 <= length(h) THEN md5(substr(h, 2 * i + 1, 800)) END AS s FROM (SELECT k, h, unnest(range(length(h) // 2))::INTEGER AS i FROM d)),
f AS (SELECT k, i, byte, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS hit FROM t),
c AS (SELECT k, i, byte, max(hit::INTEGER) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY k ORDER BY i), 0) = 0 AS opens FROM c),
g AS (SELECT k, sum(gone) AS removed, sum(opens::INTEGER) AS spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY k)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (k)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WINNOWING = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '{ITEM_WORDS}') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{ITEM_WORDS}') AS w FROM benchmark) WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
p AS (SELECT k, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM x))),
h AS MATERIALIZED (SELECT k, i, m, item_id FROM p JOIN x USING (m, s)),
q AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS j FROM h) GROUP BY k),
o AS (SELECT k, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT k, item_id::VARCHAR AS name FROM h WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN q USING (k) LEFT JOIN o USING (k)"""

FAIR_MIX = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size, md5(concat_ws(':', 'mix', doc_id::VARCHAR, md5(coalesce(text, '')))) AS h FROM documents),
q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS LAST, h, doc_id NULLS FIRST) AS k, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS sent FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight, source_size * {MAX_REPEATS} AS cap, source_size * {MAX_REPEATS} / (rank % 3 + 1)::DOUBLE AS full_at FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM l WHERE level <= full_at ORDER BY full_at, rank LIMIT 1), full_at) * weight) AS target FROM l),
c AS (SELECT k, size, (sent + source_size * e)::DOUBLE / target AS finish FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source, (SELECT unnest(range({MAX_REPEATS})) AS e) WHERE target > 0),
r AS (SELECT k, size, sum(size) OVER (ORDER BY finish, k ROWS UNBOUNDED PRECEDING) AS line FROM c),
n AS (SELECT k, sum(size) AS taken FROM r WHERE line <= (SELECT sum(size) FROM d) GROUP BY k)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source LEFT JOIN n USING (k)"""

ORACLES: dict[str, str] = {
    "op2_feistel_sharding": sharding(),
    "op3_recompression": WORD_REPEATS,
    "op8_previous_factors": BYTE_REPEATS,
    "op9_winnowing": WINNOWING,
    "op10_fair_mix": FAIR_MIX,
}
