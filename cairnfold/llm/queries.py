"""The queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, quality_classifier, quality_rules, sentencepiece_codec, toxicity
from .exact_dedup import exact_dedup
from .minhash import near_duplicates
from .packing import pack_documents
from .suffix_dedup import cut_repeats
from .warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the machine keeps a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end=0, memory=1_000_000)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_rules.measured(_table(spark, sf_dir, "documents"))
    return quality_rules.judged(stats, quality_rules.fit(stats, _table(spark, sf_dir, "labels")))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_quality_rules measures before its forest judges: SQL can say this part."""
    return quality_rules.measure(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(_table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learned from ids outside the held-out fold only (crc32 of the id as text, modulo 5, is 0 in it)."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = quality_classifier.train(docs, labels.where(fold != 0))
    out = quality_classifier.classify(docs, model, threshold=0.3)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_license_scan,
        op2_pack,
        op3_toxicity,
        op4_quality_rules,
        text_statistics,
        op5_exact_dedup,
        op6_minhash,
        op7_suffix_dedup,
        op8_sentencepiece,
        op9_warc,
        op10_quality,
    )
    return {f.__name__: f for f in every}


_STATISTICS = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM n) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM n)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g) WHERE times > 1) GROUP BY doc_id
), s AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM n LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
"""

_OP5 = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
), g AS (
  SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY k) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""

_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingle FROM w
), n AS (
  SELECT w.doc_id, count(s.shingle) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


_OP7 = r"""
WITH n AS (
  SELECT doc_id, h, length(h) // 2 AS n_bytes FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
), pieces AS (
  SELECT doc_id, n_bytes, b, substr(h, 2 * b + 1, 398) AS piece FROM (SELECT doc_id, n_bytes, h, unnest(range(0, n_bytes, 100)) AS b FROM n)
), p AS (
  SELECT doc_id, b + o AS pos, substr(piece, 2 * o + 1, 2) AS byte,
         CASE WHEN b + o + 100 <= n_bytes THEN md5_number(substr(piece, 2 * o + 1, 200)) END AS w
  FROM (SELECT doc_id, n_bytes, b, piece, unnest(range(0, least(100, n_bytes - b))) AS o FROM pieces)
), g AS (
  SELECT doc_id, pos, byte, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1 AS late FROM p
), c AS (
  SELECT doc_id, pos, byte, coalesce(max(CASE WHEN late THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) > pos - 100, false) AS gone FROM g
), s AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM c
), r AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
         coalesce(string_agg(byte, '' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM s GROUP BY doc_id
)
SELECT n.doc_id, n.n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans, sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256
FROM n LEFT JOIN r ON r.doc_id = n.doc_id
"""

_OP9 = r"""
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) || '00' AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response
  FROM pages
), b AS (
  SELECT *, list_transform(range(1, 43), lambda i: strpos('0123456789abcdef', substr(hex, i, 1)) - 1) AS nibble FROM d
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((nibble[1 + (5 * i) // 4] * 256 + nibble[2 + (5 * i) // 4] * 16 + nibble[3 + (5 * i) // 4]) >> (7 - (5 * i) % 4)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to, true AS intact
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"text_statistics": _STATISTICS, "op5_exact_dedup": _OP5, "op6_minhash": _OP6, "op7_suffix_dedup": _OP7, "op9_warc": _OP9}
