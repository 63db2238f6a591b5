"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import chat, decontaminate, exact_dedup, packing, quality, secrets, sharding, simhash, substrings, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return sharding.assign(_read(spark, sf_dir, "documents"), shards=24)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base patterns and confirmed structures."""
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside occurrences of benchmark phrases."""
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


_OP6_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH items AS (SELECT item_id, {_OP6_WORDS} AS words FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(list_slice(words, i, i + least(len(words), 10) - 1), ' ') AS window
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, {_OP6_WORDS} AS words FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs CROSS JOIN sizes),
found AS MATERIALIZED (SELECT doc, i, w.n, item_id FROM (SELECT doc, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS window FROM places) p JOIN windows w ON w.n = p.n AND w.window = p.window),
hits AS (SELECT doc, count(DISTINCT pos) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc),
named AS (SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc, item_id::VARCHAR AS item FROM found) GROUP BY doc)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc) LEFT JOIN named USING (doc)
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    return quality.scored(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")).select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"), window=2048, end_id=1)


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without strings of 50 bytes that start in earlier ones."""
    return substrings.remove_repeats(_read(spark, sf_dir, "documents")).drop("spans")


#: Fixed rules of op5.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page: a rule's, else its host's in the link graph."""
    return url_filter.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def _op5_sql() -> str:
    last = url_filter.steps_of(url_filter.TOLERANCE, 85)
    cases = sorted(URL_RULES, key=lambda r: -len(r[1]))
    fit = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')".format(r.partition("/")[0], "/" + r.partition("/")[2])
    case = lambda i: "CASE " + " ".join(f"WHEN {fit(r[1])} THEN '{r[i]}'" for r in cases) + " END"
    steps = "".join(
        f""", s{i + 1} AS MATERIALIZED (
  SELECT walk, host, sum(score)::BIGINT AS score FROM (
    SELECT walk, dst AS host, (score::HUGEINT * (n * 85) // (total::HUGEINT * 100))::BIGINT AS score FROM s{i} JOIN shares USING (walk, host)
    UNION ALL SELECT walk, host, (seed::HUGEINT * 15 // 100)::BIGINT FROM seeds) GROUP BY ALL)"""
        for i in range(last)
    )
    return rf"""
WITH p AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
), ruled AS (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS ruled FROM p),
links AS (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''>\s]+)', 1)) AS link FROM p WHERE host <> ''),
ends AS (SELECT host AS src, translate(regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS a FROM links),
edges AS (SELECT src, CASE WHEN a = '' THEN src ELSE a END AS dst, count(*) AS n FROM ends GROUP BY ALL),
both_ways AS (SELECT 'trust' AS walk, src AS host, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
shares AS MATERIALIZED (SELECT walk, host, dst, n, sum(n) OVER (PARTITION BY walk, host) AS total FROM both_ways),
counted AS (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS walk, host, count(*) AS n FROM ruled WHERE ruled IS NOT NULL GROUP BY ALL),
seeds AS MATERIALIZED (SELECT walk, host, (n::HUGEINT * {url_filter.FINE_MASS} // sum(n) OVER (PARTITION BY walk))::BIGINT AS seed FROM counted),
s0 AS (SELECT walk, host, seed AS score FROM seeds){steps},
bad AS (SELECT host FROM s{last} GROUP BY host HAVING coalesce(sum(score) FILTER (walk = 'distrust'), 0) > coalesce(sum(score) FILTER (walk = 'trust'), 0))
SELECT page_id, ruled.host, path, rule, coalesce(ruled, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN bad ON ruled.host = bad.host
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents; the largest doc_id of each stays."""
    judged, _ = exact_dedup.deduplicate(_read(spark, sf_dir, "documents"), keep="max")
    return judged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


#: The conversation that op10 adds to the table.
PROBE = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -7, formatted and read back."""
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.digest(chat.format_conversations(rows.unionByName(probe)))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:INST|ANS|SYS|TURN|TEXT)\])', '\1\\\2\3', 'g') AS safe,
         regexp_replace(role, '([<\[])(\\*)(/?s>|/?(?:INST|ANS|SYS|TURN|TEXT)\])', '\1\\\2\3', 'g') AS safe_role FROM t
), f AS (
  SELECT *, length(safe) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 13 ELSE 23 + length(safe_role) END AS chars FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars,
       bool_or(safe <> text OR safe_role <> role) AS escaped,
       true AS identical
FROM f GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_secret_scan": op3_secret_scan,
    "op4_repeated_substrings": op4_repeated_substrings,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_chat_format": op10_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": _op5_sql(),
    "op6_decontamination": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_chat_format": OP10_SQL,
}
