"""Registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import (
    bpe,
    chunk_dedup,
    decontamination,
    exact_dedup,
    html_text,
    near_dedup,
    paragraph_hash,
    periodic_runs,
    sharding,
    suffix_dedup,
    token_files,
    toxicity,
    turn_repair,
)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_to_files(_documents(spark, folder))


def op2_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, folder))


def op3_repeated_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.remove_repeats(_documents(spark, folder))


def op4_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, folder))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op6_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_components(_documents(spark, folder), percent=85)


def op7_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{folder}/pages.parquet"))


def op8_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(_documents(spark, folder))


def op10_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_copies(_documents(spark, folder))


def op11_paragraph_hash(spark: SparkSession, folder: str) -> DataFrame:
    return paragraph_hash.compare_edited(_documents(spark, folder))


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.repair_damaged(spark.read.parquet(f"{folder}/conversations.parquet"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.summarise_seeded(_documents(spark, folder))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_repeated_strings": op2_repeated_strings,
    "op3_repeated_chunks": op3_repeated_chunks,
    "op4_feistel_shards": op4_feistel_shards,
    "op5_toxicity": op5_toxicity,
    "op6_near_copies": op6_near_copies,
    "op7_page_text": op7_page_text,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_exact_copies": op10_exact_copies,
    "op11_paragraph_hash": op11_paragraph_hash,
    "op12_turn_repair": op12_turn_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

EXACT_COPIES_SQL = r"""
    WITH texts AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    ), marked AS (
        SELECT doc_id, text_sha256,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size
        FROM texts
    )
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM marked
"""

REPEATED_STRINGS_SQL = """
    WITH texts AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, CAST(len(digits) / 2 AS BIGINT) AS n_bytes FROM documents
    ), strings AS (
        SELECT doc_id, place, md5(substr(digits, 2 * place + 1, 200)) AS string
        FROM (SELECT doc_id, digits, unnest(range(0, n_bytes - 99)) AS place FROM texts)
    ), repeated AS (
        SELECT doc_id, place FROM strings QUALIFY row_number() OVER (PARTITION BY string ORDER BY doc_id, place) > 1
    ), fresh AS (
        SELECT doc_id, place, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 100 THEN 0 ELSE 1 END AS opens
        FROM repeated
    ), numbered AS (
        SELECT doc_id, place, sum(opens) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM fresh
    ), spans AS (
        SELECT doc_id, min(place) AS low, max(place) + 100 AS high FROM numbered GROUP BY doc_id, run
    ), pieces AS (
        SELECT doc_id, low, high, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS since FROM spans
    ), cut AS (
        SELECT p.doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last_high,
               string_agg(substr(digits, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) AS kept
        FROM pieces p JOIN texts t ON p.doc_id = t.doc_id GROUP BY p.doc_id
    )
    SELECT t.doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, '') || substr(digits, 2 * coalesce(last_high, 0) + 1))) AS kept_sha256
    FROM texts t LEFT JOIN cut c ON t.doc_id = c.doc_id
"""

NEAR_COPIES_SQL = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
        FROM words
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), shared AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
        FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (
        SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
        WHERE 100 * k >= 85 * (a.n + b.n - k)
    ), both_ways AS (
        SELECT x, y FROM links UNION ALL SELECT y, x FROM links
    ), reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x
    ), least AS (
        SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
    )
    SELECT l.doc_id, coalesce(n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept
    FROM least l LEFT JOIN sizes s ON l.doc_id = s.doc_id
"""

_KEYS = ", ".join(map(str, sharding.round_keys(sharding.SEED)))
FEISTEL_SQL = f"""
    WITH RECURSIVE steps(i, c, k) AS (
        SELECT CAST(unnest(range(256)) AS BIGINT), CAST(unnest(range(256)) AS BIGINT), 0
        UNION ALL
        SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
    ), crc_table AS (
        SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
    ), sized AS (
        SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS digits FROM documents
    ), checked AS (
        SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, size - 8),
               lambda i: CAST('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT))),
               lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
        FROM sized, crc_table
    ), numbered AS (
        SELECT *, row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS row_number, count(*) OVER () AS n FROM checked
    ), walk(row_number, n, bits, x, round) AS (
        SELECT row_number, n, CAST(ceil(len(bin(greatest(n - 1, 1))) / 2) AS UBIGINT), CAST(row_number AS UBIGINT), 0 FROM numbered
        UNION ALL
        SELECT row_number, n, bits, ((x & mask) << bits) | xor(x >> bits, xor(v, v >> 32) & mask), 1 + r
        FROM (
            SELECT *, CAST(CAST(xor(u, u >> 32) AS UHUGEINT) * {0xD6E8FEB86659FD93}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS v
            FROM (
                SELECT *, round % 4 AS r, ((1::UBIGINT << bits) - 1)::UBIGINT AS mask,
                       CAST((CAST(x & ((1::UBIGINT << bits) - 1)::UBIGINT AS UHUGEINT) + CAST([{_KEYS}][1 + round % 4] AS UHUGEINT))
                            * {0x9E3779B97F4A7C15}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS u
                FROM walk WHERE NOT (round = 4 AND x < n)
            )
        )
    ), placed AS (
        SELECT row_number, CAST(x AS BIGINT) AS place FROM walk WHERE round = 4 AND x < n
    )
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % {sharding.SHARDS} AS INTEGER) AS shard,
           place // {sharding.SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number
    FROM numbered JOIN placed USING (row_number)
"""

_PACKED = ", ".join(f"sum((half_{half} >> {bit}) & {paragraph_hash.PAIR})" for half in range(2) for bit in range(paragraph_hash.BITS))
PARAGRAPH_HASH_SQL = f"""
    WITH texts AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS key
        FROM documents
    ), paired AS (
        SELECT *, CAST(length(text) AS BIGINT) AS n_chars,
               coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, key), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, key)) AS next_text,
               coalesce(lead(key) OVER (ORDER BY doc_id NULLS FIRST, key), first_value(key) OVER (ORDER BY doc_id NULLS FIRST, key)) AS next_key
        FROM texts
    ), edited AS (
        SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM paired
    ), lines AS (
        SELECT key, 0 AS side, unnest(string_split(text, chr(10))) AS line FROM edited
        UNION ALL
        SELECT key, 1 AS side, unnest(string_split(edited, chr(10))) AS line FROM edited
    ), digest_sums AS (
        SELECT key, side, lane, CAST(sum(CAST('0x' || substr(CASE WHEN lane < 8 THEN sha256('0:' || line) ELSE sha256('1:' || line) END,
               1 + 8 * (lane % 8), 8) AS BIGINT)) % 4294967296 AS BIGINT) AS total
        FROM lines CROSS JOIN range(16) r(lane) GROUP BY ALL
    ), digests AS (
        SELECT key, side, list(total ORDER BY lane) AS digests FROM digest_sums GROUP BY ALL
    ), words AS (
        SELECT key, side, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]{{1,16}}') AS w FROM lines
    ), triples AS (
        SELECT key, side, len(w) > 0 AS is_real, md5(array_to_string(w[place:place + 2], ' ')) AS triple
        FROM (SELECT key, side, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS place FROM words)
    ), halves AS (
        SELECT key, side, is_real, CASE WHEN is_real THEN CAST('0x' || substr(triple, 1, 15) AS BIGINT) ELSE 0 END AS half_0,
               CASE WHEN is_real THEN CAST('0x' || substr(triple, 16, 15) AS BIGINT) ELSE 0 END AS half_1
        FROM triples
    ), packed AS (
        SELECT key, side, CAST(count(*) FILTER (WHERE is_real) AS BIGINT) AS n, CAST([{_PACKED}] AS BIGINT[]) AS bits FROM halves GROUP BY ALL
    ), signs AS (
        SELECT key, side, list_transform(list_concat(list_transform(bits, lambda x: x & {(1 << paragraph_hash.BITS) - 1}), list_transform(bits, lambda x: x >> {paragraph_hash.BITS})),
               lambda x: ((2 * x - n) % 16777216 + 16777216) % 16777216) AS signs
        FROM packed
    ), prints AS (
        SELECT d.key, d.side, digests, signs,
               list_sum(list_transform(signs, lambda x: (x - CASE WHEN x >= 8388608 THEN 16777216 ELSE 0 END) ** 2)) AS squares,
               to_base64(unhex(array_to_string(list_transform(digests, lambda x: printf('%08x', x)), '') ||
               array_to_string(list_transform(signs, lambda x: printf('%06x', x)), ''))) AS fingerprint
        FROM digests d JOIN signs s ON d.key = s.key AND d.side = s.side
    ), compared AS (
        SELECT a.key AS key, b.key AS other, b.side AS side, b.fingerprint AS fingerprint,
               CASE WHEN a.digests = b.digests THEN 1.0 WHEN a.squares + b.squares = 0 THEN 0.0
               ELSE greatest(0.0, 1.0 - list_sum(list_transform(list_zip(a.signs, b.signs), lambda p:
                    (((p[1] - p[2] + 25165824) % 16777216) - 8388608) ** 2)) / (a.squares + b.squares)) END AS near
        FROM prints a JOIN edited e ON a.key = e.key AND a.side = 0
        JOIN prints b ON (b.side = 1 AND b.key = e.key) OR (b.side = 0 AND b.key = e.next_key)
    )
    SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, p.fingerprint AS fingerprint, x.fingerprint AS edited_fingerprint,
           CAST(x.near AS DOUBLE) AS near_edited, CAST(y.near AS DOUBLE) AS near_next
    FROM edited e JOIN prints p ON p.key = e.key AND p.side = 0
    JOIN compared x ON x.key = e.key AND x.side = 1 JOIN compared y ON y.key = e.key AND y.side = 0
"""

ORACLES = {
    "op2_repeated_strings": REPEATED_STRINGS_SQL,
    "op4_feistel_shards": FEISTEL_SQL,
    "op6_near_copies": NEAR_COPIES_SQL,
    "op10_exact_copies": EXACT_COPIES_SQL,
    "op11_paragraph_hash": PARAGRAPH_HASH_SQL,
}
