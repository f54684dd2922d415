"""Registered queries over the text tables, with the same question in SQL.

The corpus is ``documents`` with the labels that exist: quality is the category,
language, source and toxicity are tags, and one source counts as unknown.
"""

from __future__ import annotations

import itertools
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import text as tx
from fathom.operators import corpus, corpus_profile, corpus_reduce, corpus_store
from fathom.plans import table_queries
from fathom.plans.storage import scratch_path
from fathom.plans.table_queries import Query, rounded, table
from fathom.sources import corpora, sinks, tables

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CORPUS = "documents"
MOMENT = datetime(2026, 1, 1)
KEYWORDS = ["license", "THE", "Straße", "email", "no such word", "que"]


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        run = table_queries.query(name, sql)(function)
        QUERIES[name] = table_queries.QUERIES.pop(name)
        if sql is not None:
            ORACLES[name] = table_queries.ORACLES.pop(name)
        return run

    return register


def categories_of(spark: SparkSession, folder: str) -> DataFrame:
    quality = table(spark, folder, "labels").select("quality").distinct()
    named = quality.select(
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("id"),
        F.concat(F.lit("Quality rating "), F.col("quality").cast("string")).alias("name"),
    )
    return corpora.conform(named, corpora.CATEGORY_SCHEMA)


def records_of(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    joined = table(spark, folder, "documents").join(labels, "doc_id", "left")
    tags = F.array("lang", "source", F.when(F.col("toxic") == 1, F.lit("toxic")))
    return corpora.corpus_records(
        joined.select(
            F.col("doc_id").cast("string").alias("id"),
            F.lit(CORPUS).alias("corpus_id"),
            F.col("text").alias("content"),
            F.concat(F.lit("q"), F.col("quality").cast("string")).alias("primary_category_id"),
            F.array_compact(tags).alias("tags"),
            F.nullif("source", F.lit("src0")).alias("source"),
            F.col("lang").alias("speaker"),
            F.lit(MOMENT).cast("timestamp_ntz").alias("created_at"),
            F.lit(MOMENT).cast("timestamp_ntz").alias("updated_at"),
        )
    )


def chats_of(spark: SparkSession, folder: str) -> DataFrame:
    chats = table(spark, folder, "conversations")
    return corpora.corpus_records(
        chats.select(
            F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"),
            F.lit("chats").alias("corpus_id"),
            F.col("text").alias("content"),
            F.concat(F.lit("role_"), "role").alias("primary_category_id"),
            F.lit(MOMENT).cast("timestamp_ntz").alias("created_at"),
        )
    )


BASE = """corpus AS (
    SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS content,
        'q' || CAST(l.quality AS VARCHAR) AS category_id, NULLIF(d.source, 'src0') AS source, d.lang AS speaker,
        CASE WHEN l.toxic = 1 THEN [d.lang, d.source, 'toxic'] ELSE [d.lang, d.source] END AS tags
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    categories AS (SELECT DISTINCT 'q' || CAST(quality AS VARCHAR) AS id,
        'Quality rating ' || CAST(quality AS VARCHAR) AS name FROM labels)"""
STRIP = "trim({0}, '" + tx.WHITESPACE + "')"
FOLD = "replace(replace(lower(replace({0}, 'İ', 'i̇')), 'ß', 'ss'), 'ſ', 's')"


def strip_sql(name: str) -> str:
    return STRIP.format(name)


def fold_sql(name: str) -> str:
    return FOLD.format(name)


# Splitting texts into records.


def _split_sql(parts: str, drops_last: bool) -> tuple[str, str]:
    last = "CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END" if drops_last else "0"
    pieces = f"""WITH cut AS (SELECT doc_id, {parts} AS parts FROM (SELECT doc_id,
            regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents)),
        pieces AS (SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos FROM cut),
        kept AS (SELECT doc_id, pos, {strip_sql('piece')} AS content FROM pieces WHERE {strip_sql('piece')} <> '')"""
    rows = f"""{pieces}, numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM kept)
        SELECT 'text_' || sha256('doc-' || doc_id || chr(0) || i || chr(0) || content)[1:16] AS id,
            md5(content) AS digest FROM numbered"""
    skipped = f"""{pieces} SELECT CAST((SELECT SUM(len(parts) - {last}) FROM cut)
        - (SELECT COUNT(*) FROM kept) AS BIGINT) AS skipped_segments"""
    return rows, skipped


SPLITS = {
    "non_empty_line": ("string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')", True, ""),
    "paragraph": ("string_split_regex(text, '(?:\\r?\\n\\s*){2,}')", False, ""),
    "sentence": ("string_split(regexp_replace(text, '([。！？!?.])\\s*', '\\1' || chr(1), 'g'), chr(1))", True, ""),
    "custom_delimiter": ("string_split(text, ', ')", False, ", "),
    "whole_input": ("[text]", False, ""),
}


def _register_split(mode: str, parts: str, drops_last: bool, delimiter: str) -> None:
    rows_sql, skipped_sql = _split_sql(parts, drops_last)

    def imported(spark: SparkSession, folder: str) -> corpora.Corpus:
        texts = table(spark, folder, "documents").select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("scope"),
            F.col("text").alias("content"),
        )
        return corpora.records_from_texts(texts, "split", mode=mode, delimiter=delimiter)

    @query(f"split_{mode}", rows_sql)
    def rows(spark, folder):
        return imported(spark, folder).records.select("id", F.md5("content").alias("digest"))

    @query(f"split_{mode}_skipped", skipped_sql)
    def skipped(spark, folder):
        return imported(spark, folder).skipped


for _mode, (_parts, _drops, _delimiter) in SPLITS.items():
    _register_split(_mode, _parts, _drops, _delimiter)


@query(
    "text_file_lines",
    f"""WITH lines AS (SELECT unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM documents)
    SELECT md5({strip_sql('line')}) AS digest, COUNT(*) AS n FROM lines WHERE {strip_sql('line')} <> '' GROUP BY 1""",
)
def _(spark, folder):
    path = scratch_path(spark, "text")
    table(spark, folder, "documents").select("text").write.text(path)
    read = corpora.read_text_corpus(spark, path, "files")
    return read.records.groupBy(F.md5("content").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def file_segments_sql(mode: str, end: str) -> str:
    cut = SPLITS[mode][0].replace("text", "content")
    return f"""WITH ended AS (SELECT text || {end} AS content FROM documents),
    pieces AS (SELECT unnest({cut}) AS piece FROM ended)
    SELECT md5({strip_sql('piece')}) AS digest, COUNT(*) AS n FROM pieces WHERE {strip_sql('piece')} <> '' GROUP BY 1"""


def file_segments(spark, folder, mode, end, delimiter=""):
    """Segments of all documents, written as text files and read split by split."""
    path = scratch_path(spark, f"text-{mode}")
    table(spark, folder, "documents").select(F.concat("text", F.lit(end)).alias("value")).write.text(path)
    read = corpora.read_text_corpus(spark, path, "files", mode=mode, delimiter=delimiter)
    return read.records.groupBy(F.md5("content").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


# What is written after each document keeps its last segment apart from the next one's.
@query("text_file_paragraphs", file_segments_sql("paragraph", "chr(10) || chr(10)"))
def _(spark, folder):
    return file_segments(spark, folder, "paragraph", "\n\n")


@query("text_file_sentences", file_segments_sql("sentence", "chr(10) || '.'"))
def _(spark, folder):
    return file_segments(spark, folder, "sentence", "\n.")


@query("text_file_delimited", file_segments_sql("custom_delimiter", "'" + SPLITS["custom_delimiter"][2] + "'"))
def _(spark, folder):
    delimiter = SPLITS["custom_delimiter"][2]
    return file_segments(spark, folder, "custom_delimiter", delimiter, delimiter)


@query(
    "json_lines",
    """SELECT 'c-' || conv_id || '-' || turn AS id, md5(text) AS digest,
        'cat_' || sha256(role)[1:16] AS category, 'chat,' || role AS tags, role AS speaker,
        '{"turn":' || turn || '}' AS custom_fields_json, TIMESTAMP '2026-01-02 03:04:05' AS record_time
    FROM conversations""",
)
def _(spark, folder):
    path = scratch_path(spark, "json")
    chats = table(spark, folder, "conversations").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"),
        F.concat(F.lit(" "), "text", F.lit("\n")).alias("content"),
        F.col("role").alias("primary_category"),
        F.concat("role", F.lit(", "), "role", F.lit(",,")).alias("tags"),
        F.col("role").alias("speaker"),
        F.lit("2026-01-02T03:04:05").alias("time"),
        "turn",
    )
    chats.write.json(path)
    read = corpora.read_jsonl_corpus(spark, path, "chats", default_tags=["chat"])
    return read.records.select(
        "id",
        F.md5("content").alias("digest"),
        F.col("primary_category_id").alias("category"),
        F.array_join("tags", ",").alias("tags"),
        "speaker",
        "custom_fields_json",
        "record_time",
    )


@query("json_lines_skipped", "SELECT COUNT(*) FILTER (role = 'system') AS skipped_lines, COUNT(*) FILTER (role = 'user') AS skipped_segments FROM conversations")
def _(spark, folder):
    path = scratch_path(spark, "json")
    role, content = F.col("role"), F.when(F.col("role") != "user", F.col("text")).otherwise(F.lit(" "))
    line = F.when(role == "system", F.lit("[1, 2]")).otherwise(F.to_json(F.struct(content.alias("content"))))
    table(spark, folder, "conversations").select(line).write.text(path)
    return corpora.read_jsonl_corpus(spark, path, "chats").skipped


@query(
    "category_dictionary",
    "SELECT DISTINCT 'cat_' || sha256(p_type)[1:16] AS id, p_type AS name FROM part",
)
def _(spark, folder):
    names = table(spark, folder, "part").select(F.concat(F.lit(" "), "p_type").alias("name"))
    return corpora.categories_for_names(names).select("id", "name")


@query(
    "tag_parsing",
    """SELECT c_custkey, c_mktsegment || ',' || lower(c_mktsegment) || ',x' AS tags FROM customer""",
)
def _(spark, folder):
    segment = F.col("c_mktsegment")
    text = F.concat(segment, F.lit(" ,, "), F.lower(segment), F.lit("，x,"), segment)
    parsed = tx.split_tags(text, ",，")
    return table(spark, folder, "customer").select("c_custkey", F.array_join(parsed, ",").alias("tags"))


@query(
    "timestamp_parsing",
    "SELECT event_id, ts AS parsed, CAST(NULL AS TIMESTAMP) AS failed FROM events",
)
def _(spark, folder):
    iso = F.concat(F.lit(" "), F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")))
    from fathom.functions.casts import text_to_timestamp

    return table(spark, folder, "events").select(
        "event_id",
        text_to_timestamp(tx.strip(iso)).alias("parsed"),
        text_to_timestamp(F.col("event_type")).alias("failed"),
    )


# Corpus profile.


@query(
    "record_quality",
    f"""WITH {BASE}, measured AS (SELECT *, length({strip_sql('content')}) AS n FROM corpus)
    SELECT COUNT(*) AS record_count, COUNT(*) FILTER (n = 0) AS empty_record_count,
        COUNT(*) FILTER (n BETWEEN 1 AND 5) AS short_record_count,
        COUNT(*) FILTER (n >= 500) AS long_record_count,
        COUNT(*) FILTER (category_id IS NULL) AS uncategorized_count,
        COUNT(*) FILTER (source IS NULL) AS missing_source_count,
        ROUND(COUNT(*) FILTER (source IS NULL) / COUNT(*), 6) AS missing_source_ratio FROM measured""",
)
def _(spark, folder):
    return rounded(corpus_profile.record_quality(records_of(spark, folder)), "missing_source_ratio")


@query(
    "length_summary",
    f"""WITH {BASE}, measured AS (SELECT length({strip_sql('content')}) AS n FROM corpus),
    ranked AS (SELECT n, ROW_NUMBER() OVER (ORDER BY n) - 1 AS pos, COUNT(*) OVER () AS total FROM measured)
    SELECT MIN(n) AS min_length, MAX(n) AS max_length, ROUND(AVG(n), 6) AS mean_length,
        ROUND(MEDIAN(n), 6) AS median_length,
        MAX(n) FILTER (pos = CAST(ROUND_EVEN((total - 1) * 0.9, 0) AS BIGINT)) AS p90_length FROM ranked""",
)
def _(spark, folder):
    rows = rounded(corpus_profile.length_summary(records_of(spark, folder)), "mean_length", "median_length")
    names = ("min_length", "max_length", "p90_length")
    return rows.withColumns({name: F.col(name).cast("long") for name in names})


GROUPS = """copies AS (SELECT content, sha256(content)[1:16] AS content_hash, COUNT(*) AS count,
    COUNT(DISTINCT COALESCE(category_id, '__uncategorized__')) AS category_count
    FROM corpus GROUP BY content HAVING COUNT(*) > 1)"""


@query("copy_groups", f"WITH {BASE}, {GROUPS} SELECT content_hash, count, category_count FROM copies")
def _(spark, folder):
    groups = corpus_profile.copy_groups(records_of(spark, folder))
    return groups.select(
        F.substring("digest", 1, 16).alias("content_hash"), "count", "category_count"
    )


@query(
    "copy_counts",
    f"""WITH {BASE}, {GROUPS} SELECT CAST(SUM(count - 1) AS BIGINT) AS exact_duplicate_record_count,
        COUNT(*) AS duplicate_group_count, COUNT(*) FILTER (category_count > 1) AS category_conflict_count FROM copies""",
)
def _(spark, folder):
    return corpus_profile.copy_counts(corpus_profile.copy_groups(records_of(spark, folder)))


def _listed_sql(where: str) -> str:
    return f"""WITH {BASE}, {GROUPS}, top AS (SELECT * FROM copies WHERE {where} ORDER BY count DESC, content_hash LIMIT 20),
    members AS (SELECT t.content_hash, t.count, c.id, COALESCE(c.category_id, '__uncategorized__') AS category_id,
        COALESCE(k.name, c.category_id, 'Uncategorised') AS name,
        ROW_NUMBER() OVER (PARTITION BY t.content_hash ORDER BY c.id) AS place
        FROM top t JOIN corpus c ON c.content = t.content LEFT JOIN categories k ON k.id = c.category_id)
    SELECT content_hash, count, string_agg(id, ',' ORDER BY place) FILTER (place <= 20) AS record_ids,
        array_to_string(list_sort(list_distinct(list(category_id))), ',') AS category_ids,
        array_to_string(list_transform(list_sort(list_distinct(list({{'i': category_id, 'n': name}}))), lambda x: x.n), ',') AS category_names
    FROM members GROUP BY content_hash, count"""


def _listed(spark: SparkSession, folder: str, conflicts_only: bool) -> DataFrame:
    records = records_of(spark, folder)
    rows = corpus_profile.listed_copies(
        records,
        categories_of(spark, folder),
        corpus_profile.copy_groups(records),
        conflicts_only=conflicts_only,
    )
    joined = {name: F.array_join(name, ",") for name in ("record_ids", "category_ids", "category_names")}
    return rows.withColumns(joined)


@query("listed_copies", _listed_sql("TRUE"))
def _(spark, folder):
    return _listed(spark, folder, False)


@query("label_conflicts", _listed_sql("category_count > 1"))
def _(spark, folder):
    return _listed(spark, folder, True)


@query(
    "category_record_counts",
    f"""WITH {BASE} SELECT category_id, COALESCE(k.name, category_id, 'Uncategorised') AS name, COUNT(*) AS count
    FROM corpus c LEFT JOIN categories k ON k.id = c.category_id GROUP BY 1, 2""",
)
def _(spark, folder):
    return corpus_profile.category_counts(records_of(spark, folder), categories_of(spark, folder))


@query("tag_counts", f"WITH {BASE} SELECT tag, COUNT(*) AS count FROM (SELECT unnest(tags) AS tag FROM corpus) GROUP BY tag")
def _(spark, folder):
    return corpus_profile.tag_counts(records_of(spark, folder))


@query("source_counts", f"WITH {BASE} SELECT source, COUNT(*) AS count FROM corpus WHERE source IS NOT NULL GROUP BY source")
def _(spark, folder):
    return corpus_profile.source_counts(records_of(spark, folder))


def _values(words: list[str]) -> str:
    return ", ".join("('" + word.replace("'", "''") + "')" for word in words)


MATCHES = f"""words(keyword) AS (VALUES {_values(KEYWORDS)}),
    folded AS (SELECT category_id, {fold_sql('content')} AS content FROM corpus),
    matches AS (SELECT keyword, category_id FROM folded JOIN words ON contains(content, {fold_sql('keyword')}))"""


@query(
    "keyword_record_counts",
    f"""WITH {BASE}, {MATCHES} SELECT w.keyword, COUNT(m.keyword) AS record_count
    FROM words w LEFT JOIN matches m ON m.keyword = w.keyword GROUP BY w.keyword""",
)
def _(spark, folder):
    return corpus_profile.keyword_record_counts(records_of(spark, folder), KEYWORDS)


# Five thousand keywords: pairs of letters with a vowel, and their doubles.
MANY_WORDS_SQL = """SELECT a.c || b.c || c.c || d.c AS keyword FROM (SELECT unnest(string_split('a b c d e i o n t s', ' ')) AS c) a,
    (SELECT unnest(string_split('a e i o u r n t l m', ' ')) AS c) b, (SELECT unnest(string_split('a b c d e i o n t s', ' ')) AS c) c,
    (SELECT unnest(string_split('n t e r s', ' ')) AS c) d"""
MANY_WORDS = ["".join(p) for p in itertools.product("abcdeionts", "aeiournltm", "abcdeionts", "nters")]


@query(
    "many_keyword_counts",
    f"""WITH {BASE}, words AS ({MANY_WORDS_SQL}),
    folded AS (SELECT {fold_sql('content')} AS content FROM corpus),
    grams AS (SELECT DISTINCT content, unnest(list_transform(range(1, length(content) - 2), lambda i: substr(content, i, 4))) AS keyword
        FROM (SELECT DISTINCT content FROM folded)),
    seen AS (SELECT g.keyword, COUNT(*) AS n FROM grams g JOIN folded f ON f.content = g.content GROUP BY g.keyword)
    SELECT w.keyword, COALESCE(n, 0) AS record_count FROM words w LEFT JOIN seen s ON s.keyword = w.keyword""",
)
def _(spark, folder):
    return corpus_profile.keyword_record_counts(records_of(spark, folder), MANY_WORDS)


@query(
    "keyword_category_counts",
    f"""WITH {BASE}, {MATCHES} SELECT category_id, COALESCE(k.name, category_id, 'Uncategorised') AS name, keyword,
        COUNT(*) AS record_count FROM matches m LEFT JOIN categories k ON k.id = m.category_id GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    return corpus_profile.keyword_category_counts(
        records_of(spark, folder), categories_of(spark, folder), KEYWORDS
    )


RUNS = f"""runs AS (SELECT id, unnest(regexp_extract_all({fold_sql('content')}, '[\\x{{4e00}}-\\x{{9fff}}]+|[a-z0-9_]+')) AS run FROM corpus),
    tokens AS (SELECT id, run AS token FROM runs WHERE length(run) >= 2
        AND NOT (length(run) > 4 AND regexp_matches(run, '^[\\x{{4e00}}-\\x{{9fff}}]'))
        UNION ALL SELECT id, substr(run, pos, 2) FROM (SELECT id, run, unnest(generate_series(1, length(run) - 1)) AS pos
            FROM runs WHERE length(run) > 4 AND regexp_matches(run, '^[\\x{{4e00}}-\\x{{9fff}}]')))"""


@query(
    "tokens_per_record",
    f"WITH {BASE}, {RUNS} SELECT id, COUNT(*) AS tokens, COUNT(DISTINCT token) AS kinds FROM tokens GROUP BY id",
)
def _(spark, folder):
    # Generated, so that the condition below is not moved under it and finds the tokens again.
    listed = records_of(spark, folder).select("id", F.explode(F.array(tx.tokens(F.col("content")))).alias("tokens"))
    rows = listed.select(
        "id",
        F.size("tokens").cast("long").alias("tokens"),
        F.size(F.array_distinct("tokens")).cast("long").alias("kinds"),
    )
    return rows.where(F.col("tokens") > 0)


@query(
    "frequent_tokens",
    f"WITH {BASE}, {RUNS} SELECT token, COUNT(*) AS count FROM tokens GROUP BY token ORDER BY count DESC, token LIMIT 20",
)
def _(spark, folder):
    return corpus_profile.frequent_tokens(records_of(spark, folder))


@query("token_counts", f"WITH {BASE}, {RUNS} SELECT token, COUNT(*) AS count FROM tokens GROUP BY token")
def _(spark, folder):
    return corpus_profile.token_counts(records_of(spark, folder))


PAIRS = """flat AS (SELECT DISTINCT id, tag FROM (SELECT id, unnest(tags) AS tag FROM corpus)),
    pairs AS (SELECT a.tag AS left_tag, b.tag AS right_tag, COUNT(*) AS count
        FROM flat a JOIN flat b ON a.id = b.id AND a.tag < b.tag GROUP BY 1, 2)"""


@query("tag_cooccurrence", f"WITH {BASE}, {PAIRS} SELECT * FROM pairs")
def _(spark, folder):
    return corpus_profile.tag_cooccurrence(records_of(spark, folder))


NAMES = "(SELECT p_type AS name FROM part UNION SELECT lower(replace(p_type, ' ', '_-')) FROM part)"


@query(
    "similar_labels",
    f"""WITH plain AS (SELECT name, lower(regexp_replace(name, '[ _-]', '', 'g')) AS same FROM {NAMES})
    SELECT a.name AS left_name, b.name AS right_name, CAST(1 AS DOUBLE) AS similarity, 'normalized_equal' AS reason
    FROM plain a JOIN plain b ON a.same = b.same AND a.name < b.name ORDER BY 1, 2 LIMIT 10""",
)
def _(spark, folder):
    """Names that are equal without case and separators lead the list; tests hold the others by brute force."""
    types = table(spark, folder, "part").select(F.col("p_type").alias("name"))
    other = types.select(F.lower(F.replace("name", F.lit(" "), F.lit("_-"))).alias("name"))
    found = corpus_profile.similar_labels(corpora.categories_for_names(types.unionByName(other)))
    return found.select("left_name", "right_name", "similarity", "reason")


# Matching letters of two labels: the longest common block, earliest in both, then the same
# on what stands before and after it, until no block is left.
BLOCKS = """names AS (SELECT DISTINCT p_name AS name, lower(regexp_replace(p_name, '[ _-]', '', 'g')) AS plain FROM part),
    parts AS (
        SELECT a.name AS left_name, b.name AS right_name, 0 AS segment, a.plain AS one, b.plain AS two, 0 AS letters
        FROM names a JOIN names b ON a.name < b.name
        UNION ALL
        SELECT left_name, right_name, 2 * segment + side, CASE side WHEN 0 THEN NULL WHEN 1 THEN left(one, i - 1) ELSE substr(one, i + n) END,
            CASE side WHEN 0 THEN NULL WHEN 1 THEN left(two, j - 1) ELSE substr(two, j + n) END, CASE side WHEN 0 THEN n ELSE 0 END
        FROM (SELECT left_name, right_name, segment, one, two, i, n, instr(two, substr(one, i, n)) AS j
            FROM (SELECT *, unnest(range(1, length(one) + 1)) AS i FROM parts WHERE one IS NOT NULL) p,
                LATERAL (SELECT unnest(range(1, length(one) - i + 2)) AS n) s
            WHERE instr(two, substr(one, i, n)) > 0
            QUALIFY ROW_NUMBER() OVER (PARTITION BY left_name, right_name, segment ORDER BY n DESC, i, j) = 1) block,
            (SELECT unnest([0, 1, 2]) AS side) sides)"""


@query(
    "similar_part_names",
    f"""WITH RECURSIVE {BLOCKS}, measured AS (
        SELECT p.left_name, p.right_name, ANY_VALUE(a.plain) AS a, ANY_VALUE(b.plain) AS b,
            2.0 * SUM(p.letters) / ANY_VALUE(length(a.plain) + length(b.plain)) AS similarity
        FROM parts p JOIN names a ON a.name = p.left_name JOIN names b ON b.name = p.right_name GROUP BY 1, 2)
    SELECT left_name, right_name, round(CAST(similarity AS DOUBLE), 3) AS similarity,
        CASE WHEN a = b THEN 'normalized_equal' ELSE 'high_similarity' END AS reason
    FROM measured WHERE similarity >= {corpus_profile.SIMILARITY} ORDER BY 3 DESC, 1, 2""",
)
def _(spark, folder):
    """All pairs of part names that are nearly the same, without a limit."""
    names = corpora.categories_for_names(table(spark, folder, "part").select(F.col("p_name").alias("name")))
    found = corpus_profile.similar_labels(names, limit=None)
    return found.select("left_name", "right_name", "similarity", "reason")


@query(
    "corpus_field_profiles",
    f"""WITH {BASE} SELECT 'content' AS "column", COUNT(*) FILTER ({strip_sql('content')} = '') AS null_count,
        COUNT(DISTINCT content) AS distinct_count FROM corpus
    UNION ALL SELECT 'primary_category', COUNT(*) FILTER (category_id IS NULL), COUNT(DISTINCT category_id) FROM corpus
    UNION ALL SELECT 'tags', COUNT(*) FILTER (len(tags) = 0), (SELECT COUNT(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM corpus)) FROM corpus
    UNION ALL SELECT 'source', COUNT(*) FILTER (source IS NULL), COUNT(DISTINCT source) FROM corpus""",
)
def _(spark, folder):
    fields = corpus_profile.field_profiles(records_of(spark, folder))
    return fields.select("column", "null_count", "distinct_count")


@query(
    "corpus_warnings",
    f"""WITH {BASE}, {GROUPS}, measured AS (SELECT *, length({strip_sql('content')}) AS n FROM corpus)
    SELECT array_to_string(list_filter([
        (SELECT CASE WHEN COUNT(*) FILTER (n = 0) > 0 THEN 'empty_text_records_present' END FROM measured),
        (SELECT CASE WHEN COUNT(*) > 0 THEN 'exact_duplicate_text_present' END FROM copies),
        (SELECT CASE WHEN COUNT(*) FILTER (n BETWEEN 1 AND 5 OR n >= 500) > 0 THEN 'extreme_text_lengths_present' END FROM measured),
        (SELECT CASE WHEN COUNT(*) > COUNT(category_id) THEN 'uncategorized_records_present' END FROM measured),
        (SELECT CASE WHEN COUNT(*) > COUNT(source) THEN 'missing_sources_present' END FROM measured),
        (SELECT CASE WHEN COUNT(*) FILTER (category_count > 1) > 0 THEN 'category_conflicts_present' END FROM copies),
        'near_duplicate_category_names_present'], lambda x: x IS NOT NULL), ',') AS warnings""",
)
def _(spark, folder):
    quality = corpus_profile.corpus_quality(records_of(spark, folder), categories_of(spark, folder))
    return quality.select(F.array_join("warnings", ",").alias("warnings"))


@query(
    "corpus_findings",
    f"""WITH {BASE}, {GROUPS}, measured AS (SELECT *, length({strip_sql('content')}) AS n FROM corpus), {PAIRS}, {RUNS}
    SELECT method FROM (
        SELECT 'primary_category_null_count' AS method, COUNT(*) - COUNT(category_id) AS hits FROM measured
        UNION ALL SELECT 'source_empty_count', COUNT(*) - COUNT(source) FROM measured
        UNION ALL SELECT 'sha256_exact_content_grouping', COUNT(*) FROM copies
        UNION ALL SELECT 'duplicate_content_category_comparison', COUNT(*) FILTER (category_count > 1) FROM copies
        UNION ALL SELECT 'character_length_distribution', COUNT(*) FILTER (n BETWEEN 1 AND 5 OR n >= 500) FROM measured
        UNION ALL SELECT 'normalized_name_similarity', 1
        UNION ALL SELECT 'casefold_substring_keyword_count', 1
        UNION ALL SELECT 'surface_token_frequency', MAX(c) - 1 FROM (SELECT COUNT(*) AS c FROM tokens GROUP BY token)
        UNION ALL SELECT 'tag_pair_co_occurrence_count', MAX(count) - 1 FROM pairs) WHERE hits > 0""",
)
def _(spark, folder):
    found = corpus_profile.profile_corpus(
        records_of(spark, folder), categories_of(spark, folder), keywords=KEYWORDS
    )
    return found.findings.select("method")


# Corpus reductions.


LABELS = """labelled AS (SELECT c.*, COALESCE(k.name, c.category_id, 'Uncategorised') AS label,
    COALESCE(NULLIF(TRIM(c.source), ''), 'No source') AS source_label
    FROM corpus c LEFT JOIN categories k ON k.id = c.category_id)"""


@query(
    "text_category_chart",
    f"""WITH {BASE}, {LABELS}, g AS (SELECT label, COUNT(*) AS n FROM labelled GROUP BY label),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, label) AS rank FROM g)
    SELECT CASE WHEN rank <= 2 THEN label ELSE 'Other' END AS x, CAST(SUM(n) AS BIGINT) AS source_count FROM r GROUP BY 1""",
)
def _(spark, folder):
    rows = corpus_reduce.category_chart(records_of(spark, folder), categories_of(spark, folder), limit=2)
    return rows.rows


@query(
    "text_category_chart_dangling",
    f"""WITH {BASE} SELECT COALESCE(CASE WHEN category_id = 'q1' THEN 'Quality rating 1' END, category_id, 'Uncategorised') AS x,
        COUNT(*) AS source_count FROM corpus GROUP BY 1""",
)
def _(spark, folder):
    known = categories_of(spark, folder).where("id = 'q1'")
    return corpus_reduce.category_chart(records_of(spark, folder), known).rows


@query(
    "text_classification_chart",
    f"""WITH {BASE} SELECT 'Categorised' AS x, COUNT(category_id) AS source_count FROM corpus
    UNION ALL SELECT 'Uncategorised', COUNT(*) - COUNT(category_id) FROM corpus""",
)
def _(spark, folder):
    return corpus_reduce.classification_chart(records_of(spark, folder)).rows


@query(
    "text_source_category_chart",
    f"""WITH {BASE}, {LABELS},
    s AS (SELECT source_label, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, source_label) AS rank FROM labelled GROUP BY 1),
    c AS (SELECT label, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, label) AS rank FROM labelled GROUP BY 1)
    SELECT CASE WHEN s.rank <= 6 THEN l.source_label ELSE 'Other' END AS x,
        CASE WHEN c.rank <= 2 THEN l.label ELSE 'Other' END AS y, COUNT(*) AS source_count
    FROM labelled l JOIN s ON s.source_label = l.source_label JOIN c ON c.label = l.label GROUP BY 1, 2""",
)
def _(spark, folder):
    rows = corpus_reduce.source_category_chart(
        records_of(spark, folder), categories_of(spark, folder), x_limit=6, y_limit=2
    )
    return rows.rows


LOWERED = f"""words(keyword, pos) AS (VALUES {", ".join(f"('{w}', {i})" for i, w in enumerate(KEYWORDS))}),
    hits AS (SELECT keyword, label FROM labelled JOIN words
        ON contains(lower(replace(content, 'İ', 'i̇')), lower(keyword)))"""


@query(
    "text_keyword_chart",
    f"""WITH {BASE}, {LABELS}, {LOWERED} SELECT w.keyword AS x, COUNT(h.keyword) AS source_count
    FROM words w LEFT JOIN hits h ON h.keyword = w.keyword WHERE w.pos < 5 GROUP BY w.keyword""",
)
def _(spark, folder):
    return corpus_reduce.keyword_chart(records_of(spark, folder), KEYWORDS, limit=5).rows


@query(
    "text_category_keyword_chart",
    f"""WITH {BASE}, {LABELS}, {LOWERED}, g AS (SELECT keyword, label, COUNT(*) AS n FROM hits GROUP BY 1, 2),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY keyword ORDER BY n DESC, label) AS rank FROM g)
    SELECT keyword AS x, CASE WHEN rank <= 1 THEN label ELSE 'Other' END AS y, CAST(SUM(n) AS BIGINT) AS source_count
    FROM r GROUP BY 1, 2""",
)
def _(spark, folder):
    rows = corpus_reduce.category_keyword_chart(
        records_of(spark, folder), categories_of(spark, folder), KEYWORDS, category_limit=1
    )
    return rows.rows


@query(
    "text_tag_matrix",
    f"""WITH {BASE}, {PAIRS}, top AS (SELECT tag, COUNT(*) AS n FROM flat GROUP BY tag ORDER BY n DESC, tag LIMIT 8)
    SELECT tag AS x, tag AS y, n AS source_count FROM top
    UNION ALL SELECT left_tag, right_tag, count FROM pairs WHERE left_tag IN (SELECT tag FROM top) AND right_tag IN (SELECT tag FROM top)
    UNION ALL SELECT right_tag, left_tag, count FROM pairs WHERE left_tag IN (SELECT tag FROM top) AND right_tag IN (SELECT tag FROM top)""",
)
def _(spark, folder):
    return corpus_reduce.tag_matrix(records_of(spark, folder), tag_limit=8).rows


@query(
    "text_chart_metadata",
    f"""WITH {BASE}, {PAIRS} SELECT (SELECT COUNT(*) FROM corpus) AS original_rows, CAST(5 AS BIGINT) AS rendered_rows,
        'text_keyword_counts' AS method, TRUE AS approximate
    UNION ALL SELECT (SELECT COUNT(*) FROM corpus), CAST(3 AS BIGINT), 'text_category_counts_top_n', FALSE
    UNION ALL SELECT (SELECT COUNT(*) FROM corpus), COUNT(*) * 2 + (SELECT COUNT(DISTINCT tag) FROM flat), 'text_tag_cooccurrence_counts', FALSE FROM pairs""",
)
def _(spark, folder):
    records, categories = records_of(spark, folder), categories_of(spark, folder)
    described = [
        corpus_reduce.keyword_chart(records, KEYWORDS, limit=5).metadata,
        corpus_reduce.category_chart(records, categories).metadata,
        corpus_reduce.tag_matrix(records).metadata,
    ]
    shown = [meta.select("original_rows", "rendered_rows", "method", "approximate") for meta in described]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


# Corpus tables, search and governance.


SHOWN = ("id", "primary_category_id", "tags", "source")


def _shown(records: DataFrame) -> DataFrame:
    return records.select(
        "id",
        F.md5("content").alias("digest"),
        "primary_category_id",
        F.array_join("tags", ",").alias("tags"),
        "source",
    )


SHOWN_SQL = "id, md5(content) AS digest, category_id AS primary_category_id, array_to_string(tags, ',') AS tags, source"


@query("record_view", f"WITH {BASE} SELECT {SHOWN_SQL} FROM corpus")
def _(spark, folder):
    both = records_of(spark, folder).unionByName(chats_of(spark, folder))
    return _shown(corpus.record_view(both, CORPUS))


SEARCH = "contains(lower(content || ' ' || COALESCE(source, '') || ' ' || speaker), 'license') AND category_id = 'q1'"


@query("record_search", f"WITH {BASE} SELECT {SHOWN_SQL} FROM corpus WHERE {SEARCH}")
def _(spark, folder):
    found = corpus.search_records(
        records_of(spark, folder), CORPUS, search_text=" LICENSE ", category_id="q1"
    )
    return _shown(found)


@query(
    "record_search_page",
    f"WITH {BASE} SELECT {SHOWN_SQL} FROM corpus WHERE category_id IS NULL AND (contains(lower(content), 'src1') OR contains(source, 'src1')) ORDER BY id LIMIT 25 OFFSET 10",
)
def _(spark, folder):
    page = corpus.record_page(
        records_of(spark, folder), CORPUS, limit=25, offset=10, search_text="src1", uncategorized_only=True
    )
    return _shown(page)


@query(
    "record_counts",
    "SELECT 'documents' AS corpus_id, COUNT(*) AS record_count FROM documents UNION ALL SELECT 'chats', COUNT(*) FROM conversations",
)
def _(spark, folder):
    return corpus.record_counts(records_of(spark, folder).unionByName(chats_of(spark, folder)))


@query("category_usage", f"WITH {BASE} SELECT category_id AS primary_category_id, COUNT(*) AS record_count FROM corpus WHERE category_id IS NOT NULL GROUP BY 1")
def _(spark, folder):
    return corpus.category_usage(records_of(spark, folder), CORPUS)


@query("category_list", f"WITH {BASE} SELECT id, name FROM categories")
def _(spark, folder):
    return corpus.category_list(categories_of(spark, folder)).select("id", "name")


@query(
    "ensure_categories",
    f"""WITH {BASE} SELECT id, name FROM categories
    UNION ALL SELECT DISTINCT 'cat_' || sha256(role)[1:16], role FROM conversations""",
)
def _(spark, folder):
    roles = table(spark, folder, "conversations").select(F.col("role").alias("name"))
    again = table(spark, folder, "labels").select(
        F.concat(F.lit(" QUALITY RATING "), F.col("quality").cast("string")).alias("name")
    )
    both = corpus.ensure_categories(categories_of(spark, folder), roles.unionByName(again))
    return both.select("id", "name")


@query(
    "upsert_categories",
    "SELECT DISTINCT 'new' || quality AS id, 'Quality rating ' || quality AS name, 'replaced' AS description FROM labels",
)
def _(spark, folder):
    old = categories_of(spark, folder)
    new = old.withColumns(
        {"id": F.replace("id", F.lit("q"), F.lit("new")), "description": F.lit("replaced")}
    )
    return corpus.upsert_categories(old, new).select("id", "name", "description")


@query(
    "replace_corpus",
    f"""WITH {BASE} SELECT 'chats' AS corpus_id, 'c-' || conv_id || '-' || turn AS id FROM conversations
    UNION ALL SELECT 'documents', 'new-' || id FROM corpus WHERE category_id IS NOT NULL""",
)
def _(spark, folder):
    records, categories = records_of(spark, folder), categories_of(spark, folder)
    stored = records.unionByName(chats_of(spark, folder))
    fresh = records.where(F.col("primary_category_id").isNotNull()).withColumn(
        "id", F.concat(F.lit("new-"), "id")
    )
    merged, _ = corpus.replace_corpus(stored, categories, CORPUS, fresh, categories)
    return merged.select("corpus_id", "id")


@query(
    "replace_corpus_on_disk",
    "SELECT 'chats' AS corpus_id, COUNT(*) AS n FROM conversations UNION ALL SELECT 'documents', COUNT(*) FROM labels WHERE quality IS NOT NULL",
)
def _(spark, folder):
    path = scratch_path(spark, "corpus")
    records = records_of(spark, folder)
    corpus.write_corpus(records.unionByName(chats_of(spark, folder)), path)
    corpus.write_corpus(records.where(F.col("primary_category_id").isNotNull()), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "replace_corpus_version",
    f"""WITH {BASE}, moved AS (SELECT 'c-' || conv_id || '-' || turn AS id FROM conversations WHERE role = 'user')
    SELECT 'chats' AS corpus_id, 'c-' || conv_id || '-' || turn AS id FROM conversations WHERE role <> 'user'
    UNION ALL SELECT 'taken', id FROM moved""",
)
def _(spark, folder):
    # Records move from one corpus to another, and a whole corpus goes.
    path = scratch_path(spark, "store")
    records, categories, chats = records_of(spark, folder), categories_of(spark, folder), chats_of(spark, folder)
    corpus_store.commit_corpora(spark, path, 0, {CORPUS: records, "chats": chats}, categories)
    corpus_store.replace_corpus(spark, path, "taken", chats.where("primary_category_id = 'role_user'"), categories)
    corpus_store.replace_corpus(spark, path, CORPUS, records.limit(0), categories)
    return corpus_store.open_corpora(spark, path).records.select("corpus_id", "id")


@query(
    "edit_records",
    f"""WITH {BASE} SELECT id, md5(content) AS digest,
        CASE WHEN list_contains(tags, 'toxic') THEN 'cat_' || sha256('Toxic')[1:16] ELSE category_id END AS primary_category_id,
        CASE WHEN list_contains(tags, 'toxic') THEN 'review,Toxic' ELSE array_to_string(tags, ',') END AS tags,
        CASE WHEN list_contains(tags, 'toxic') THEN NULL ELSE source END AS source FROM corpus""",
)
def _(spark, folder):
    records = records_of(spark, folder)
    edits = records.where(F.array_contains("tags", "toxic")).select(
        "id",
        F.lit(" Toxic ").alias("category_name"),
        F.lit("review，Toxic, review,").alias("tags_text"),
        F.lit(" ").alias("source"),
    )
    edited, _ = corpus.edit_records(
        records, categories_of(spark, folder), CORPUS, edits, changed_at=MOMENT
    )
    return _shown(edited)


def _governed(done: corpus.Governed) -> DataFrame:
    return _shown(done.records)


@query("merge_categories", f"WITH {BASE} SELECT id, md5(content) AS digest, CASE WHEN category_id = 'q1' THEN 'q0' ELSE category_id END AS primary_category_id, array_to_string(tags, ',') AS tags, source FROM corpus")
def _(spark, folder):
    return _governed(
        corpus.merge_categories(
            records_of(spark, folder), categories_of(spark, folder), CORPUS, "q1", "q0", changed_at=MOMENT
        )
    )


@query("delete_category", f"WITH {BASE} SELECT id, md5(content) AS digest, NULLIF(category_id, 'q1') AS primary_category_id, array_to_string(tags, ',') AS tags, source FROM corpus")
def _(spark, folder):
    return _governed(
        corpus.delete_category(
            records_of(spark, folder), categories_of(spark, folder), CORPUS, "q1", changed_at=MOMENT
        )
    )


@query("rename_category", f"WITH {BASE} SELECT id, CASE WHEN id = 'q1' THEN 'Good' ELSE name END AS name, CASE WHEN id = 'q1' THEN 'useful' ELSE '' END AS description FROM categories")
def _(spark, folder):
    done = corpus.rename_category(
        records_of(spark, folder),
        categories_of(spark, folder),
        CORPUS,
        "q1",
        new_name=" Good ",
        new_description="useful",
        changed_at=MOMENT,
    )
    return done.categories.select("id", "name", "description")


@query(
    "usage_guard",
    "SELECT 'user' AS role, COUNT(*) FILTER (role = 'user') AS outside_count FROM conversations",
)
def _(spark, folder):
    both = records_of(spark, folder).unionByName(chats_of(spark, folder))
    count = corpus.usage_outside(both, CORPUS, "role_user")
    return spark.createDataFrame([("user", count)], "role string, outside_count long")


@query(
    "audit_log",
    f"""WITH {BASE} SELECT 1 AS place, 'delete_to_uncategorized' AS action, 'q0' AS source_category_id,
        'Quality rating 0' AS source_category_name, NULL AS target_category_name, COUNT(category_id) AS affected_record_count FROM corpus
    UNION ALL SELECT 2, 'merge', 'q1', 'Good', 'Quality rating 0', COUNT(*) FILTER (category_id = 'q1') FROM corpus
    UNION ALL SELECT 3, 'rename', 'q1', 'Quality rating 1', 'Good', COUNT(*) FILTER (category_id = 'q1') FROM corpus""",
)
def _(spark, folder):
    first = corpus.rename_category(
        records_of(spark, folder), categories_of(spark, folder), CORPUS, "q1", new_name="Good", changed_at=MOMENT
    )
    second = corpus.merge_categories(
        first.records, first.categories, CORPUS, "q1", "q0", changed_at=datetime(2026, 1, 2)
    )
    third = corpus.delete_category(
        second.records, second.categories, CORPUS, "q0", changed_at=datetime(2026, 1, 3)
    )
    log = corpus.audit_log(
        first.audit.unionByName(second.audit).unionByName(third.audit), CORPUS
    )
    place = F.array_position(
        F.array(*map(F.lit, ("delete_to_uncategorized", "merge", "rename"))), F.col("action")
    )
    return log.select(
        place.cast("int").alias("place"),
        "action",
        "source_category_id",
        "source_category_name",
        "target_category_name",
        "affected_record_count",
    )


# Corpus sinks, read back.


@query(
    "corpus_csv_export",
    f"""WITH {BASE} SELECT c.id, md5(content) AS digest, k.name AS primary_category,
        array_to_string(tags, ', ') AS tags, source, '2026-01-01T00:00:00.000' AS created_at
    FROM corpus c LEFT JOIN categories k ON k.id = c.category_id""",
)
def _(spark, folder):
    path = scratch_path(spark, "export")
    records, categories = records_of(spark, folder), categories_of(spark, folder)
    sinks.export_corpus(records, categories, path, "csv")
    columns = sinks.corpus_csv_rows(records, categories).columns
    texts = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    back = tables.read_delimited(spark, path, schema=texts, multi_line=True)
    return back.select(
        "id", F.md5("content").alias("digest"), "primary_category", "tags", "source", "created_at"
    )


@query(
    "corpus_jsonl_export",
    f"""WITH {BASE} SELECT c.id, md5(content) AS digest, COALESCE(k.name, '') AS primary_category,
        array_to_string(tags, ',') AS tags, source, '2026-01-01T00:00:00' AS created_at, '{{}}' AS custom_fields
    FROM corpus c LEFT JOIN categories k ON k.id = c.category_id""",
)
def _(spark, folder):
    path = scratch_path(spark, "export")
    sinks.export_corpus(records_of(spark, folder), categories_of(spark, folder), path, "jsonl")
    schema = (
        "id string, content string, primary_category string, tags array<string>, source string, "
        "created_at string, custom_fields string"
    )
    back = spark.read.schema(schema).json(path)
    return back.select(
        "id",
        F.md5("content").alias("digest"),
        "primary_category",
        F.array_join("tags", ",").alias("tags"),
        "source",
        "created_at",
        "custom_fields",
    )
