"""The queries of this subpackage, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm.chat_format import chat_digests
from hyperweave.llm.common import documents
from hyperweave.llm.language_id import identify
from hyperweave.llm.license_scan import SHINGLE, TEMPLATES, license_scan
from hyperweave.llm.media_columns import media_columns
from hyperweave.llm.minhash_dedup import near_duplicates
from hyperweave.llm.quality_rules import RULES, STOP_WORDS, quality
from hyperweave.llm.sentencepiece_codec import encode_documents
from hyperweave.llm.source_mixing import mixture
from hyperweave.llm.suffix_dedup import removed_digests
from hyperweave.llm.toxicity import toxicity


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digests(documents(spark, sf_dir), length=50)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The conversation that shows that control strings inside texts survive.
CONTROL = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat_digests(rows.unionByName(extra))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), tokenizer_path())


def mix_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of op4 comes to in each source."""
    return op4_source_mixing(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), F.sum("taken").alias("taken"), F.max((F.col("taken") > 3 * F.col("size")).cast("int")).alias("over"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6 doesn't depend on the compression of the media."""
    return op6_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10 the text alone says: decoding gives it back, and empty texts have the begin and end ids."""
    return op10_sentencepiece(spark, sf_dir).select("doc_id", "decoded_sha256", (F.col("n_tokens") == 2).alias("no_tokens"))


OP4_SQL = r"""
WITH sized AS (
  SELECT source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents
), found AS (
  SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sized GROUP BY source
), cut AS (
  SELECT a.*, (SELECT sum(b.source_size) FROM found b)
      - 3 * coalesce((SELECT sum(b.source_size) FROM found b WHERE b.source_size / b.weight < a.source_size / a.weight), 0) AS words,
    (SELECT sum(b.weight) FROM found b WHERE b.source_size / b.weight >= a.source_size / a.weight) AS over
  FROM found a
), level AS (
  SELECT arg_max(words / over, words) FILTER (WHERE 3 * source_size * over > words * weight) AS share FROM cut
)
SELECT source, docs, source_size, round(CASE WHEN 3 * source_size <= share * weight THEN 3.0 * source_size ELSE share * weight END, 3) AS target,
  least(round(CASE WHEN 3 * source_size <= share * weight THEN 3.0 * source_size ELSE share * weight END), 3 * source_size)::BIGINT AS taken, 0 AS over
FROM cut, level
"""

OP6_SQL = r"""
SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, padded AS payload_bytes,
  sha256(unhex(rpad(hex(encode(coalesce(text, ''))), (2 * padded)::INT, '0'))) AS payload_sha256, 64::BIGINT AS width, padded // 64 AS height
FROM (SELECT *, greatest(64, 64 * ceil(octet_length(encode(coalesce(text, ''))) / 64))::BIGINT AS padded FROM documents)
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), places AS (
  SELECT doc_id, i, hash(s) AS a, hash(s || '.') AS b
  FROM (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, unnest(range((len(h) // 2 - 49)::BIGINT)) AS i, h FROM d WHERE len(h) >= 100))
), firsts AS (
  SELECT a, b, min(doc_id) AS first FROM places GROUP BY a, b HAVING min(doc_id) <> max(doc_id)
), hits AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM places JOIN firsts USING (a, b) WHERE first < doc_id
), runs AS (
  SELECT doc_id, i, sum((coalesce(gap, 51) > 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run
), ends AS (
  SELECT doc_id, a, b, lag(b, 1, 0::BIGINT) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), gone AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id
), head AS (
  SELECT ends.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS h FROM ends JOIN d USING (doc_id) GROUP BY ends.doc_id
)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN d.h ELSE head.h || substr(d.h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN head ON head.doc_id = d.doc_id
"""

OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS loss_sha256,
  sum(12 + length(role) + (length(role) - length(translate(role, '\<[' || chr(10), ''))) + 1 + length(text) + (length(text) - length(translate(text, '\<[', ''))) + 11)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

TOKENS_SQL = "SELECT doc_id, sha256(encode(coalesce(text, ''))) AS decoded_sha256, coalesce(text, '') = '' AS no_tokens FROM documents"

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s
  FROM w
), classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1
), items AS (
  SELECT rep, len(s) AS n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.rep AS u, b.rep AS v FROM items a JOIN items b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(u, v) AS (
  SELECT rep, rep FROM classes UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), comp AS (
  SELECT u, min(v) AS c FROM reach GROUP BY u
)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(comp.c, sets.doc_id) AS component_id, sets.doc_id = coalesce(comp.c, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = list_sort(sets.s) LEFT JOIN comp ON comp.u = classes.rep
"""

def _rules_sql() -> dict[str, str]:
    out = {}
    for r in RULES:
        bounds = [f"100 * {r.count} >= {r.low} * {r.of}"] * (r.low is not None) + [f"100 * {r.count} <= {r.high} * {r.of}"] * (r.high is not None)
        out[r.name] = " AND ".join(bounds)
    return out


def _quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


OP1_SQL = rf"""
WITH w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), grams AS (
  SELECT doc_id, unnest(range(len(words) - 7)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda k: array_to_string(words[k:k + 7], ' '))) AS g
  FROM w WHERE len(words) >= 9
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(lead_i - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM twice) GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    (length(t) - length(translate(t, '!?', '')))::BIGINT AS n_marks,
    len(list_filter(words, lambda x: lower(x) IN ({_quoted(sorted(set(STOP_WORDS)))})))::BIGINT AS n_stop_words,
    len(lines)::BIGINT AS n_lines
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
), judged AS (
  SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_stop_words, n_lines,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counts
), named AS (
  SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN NOT ({sql}) THEN '{name}' END" for name, sql in _rules_sql().items())}], lambda x: x IS NOT NULL), ',') AS broken FROM judged
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, n_marks, n_stop_words, n_lines, broken FROM named
"""

OP3_SQL = rf"""
WITH templates(license, notice, t) AS (VALUES {", ".join(f"({_quoted([k])}, {i}, {_quoted([t])})" for k, v in TEMPLATES.items() for i, t in enumerate(v))}),
texts AS (
  SELECT 'd' AS kind, doc_id, '' AS license, 0 AS notice, lower(coalesce(text, '')) AS t FROM documents
  UNION ALL SELECT 't', 0, license, notice, lower(t) FROM templates
), words AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '') AS w FROM texts
), sets AS (
  SELECT kind, doc_id, license, notice, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS s
  FROM words
), wanted AS (
  SELECT license, notice, len(s) AS total, unnest(s) AS x FROM sets WHERE kind = 't'
), had AS (
  SELECT doc_id, unnest(s) AS x FROM sets WHERE kind = 'd'
)
SELECT doc_id, license, notice, count(*)::BIGINT AS matched, total::BIGINT AS total, count(*) / total::DOUBLE AS containment
FROM had JOIN wanted USING (x) GROUP BY doc_id, license, notice, total HAVING 100 * count(*) >= 80 * total
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_source_mixing": op4_source_mixing,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_media_columns": op6_media_columns,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_chat_format": op9_chat_format,
    "op10_sentencepiece": op10_sentencepiece,
    "mix_by_source": mix_by_source,
    "media_payloads": media_payloads,
    "token_counts": token_counts,
}
ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op3_license_scan": OP3_SQL,
    "op5_minhash_dedup": OP5_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op9_chat_format": OP9_SQL,
    "mix_by_source": OP4_SQL,
    "media_payloads": OP6_SQL,
    "token_counts": TOKENS_SQL,
}
