"""The registered queries of this subpackage and their SQL.

Each query applies its operator with production parameters to whole tables and
derives the columns its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    html_text,
    jaccard_join,
    language_id,
    piece_counts,
    pu_quality,
    quality_rules,
    toxicity,
)
from lexiloom.llm.learning import fold
from lexiloom.storage import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w3
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM s)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w3) AS c FROM win) WHERE c > 1
), repw AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid
), b AS (
  SELECT s.rid, doc_id, source, text, ls,
         len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM s LEFT JOIN repw USING (rid)
), l AS (
  SELECT rid, source, text, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT rid, source, text, unnest(ls) AS x FROM b)
), above AS (
  SELECT source, line FROM l GROUP BY source, line
  HAVING count(DISTINCT text) > 20
), removed AS (
  SELECT rid, sum(words)::BIGINT AS removed_words
  FROM l JOIN above ON l.line = above.line AND l.source IS NOT DISTINCT FROM above.source GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n_words - coalesce(removed_words, 0) >= 0.3 * n_words AS kept,
       coalesce(removed_words, 0)::BIGINT AS removed_words
FROM b LEFT JOIN removed USING (rid)
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str, path: str = "") -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_piece_counts(spark: SparkSession, sf_dir: str, path: str = "") -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return piece_counts.count_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match_documents(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(13, len(ws)) AS size, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT size FROM bw
), dw AS (
  SELECT rid, size, i, array_to_string(ws[i : i + size - 1], ' ') AS w
  FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)
), hits AS (
  SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.w = bw.w AND dw.size = bw.size
), hw AS (
  SELECT rid, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS k FROM hits) GROUP BY rid
), it AS (
  SELECT rid, count(DISTINCT item) + max(CASE WHEN item IS NULL THEN 1 ELSE 0 END) AS n_items,
         array_to_string(list_sort(list_distinct(list(item))), ',') AS items
  FROM hits GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN it ON it.rid = d.rid
"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chat_format.rotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    spans = F.transform("mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return shown.select("conv_id", "speaker", "part", F.col("n_turns").cast("long").alias("n_turns"), "text", F.array_join(spans, ",").alias("mask"))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, 0)::BIGINT AS turn, replace(coalesce(role, ''), '<|', '< |') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM t
), p AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role NOT IN ('', 'system')
), r AS (
  SELECT n.conv_id, speaker, (rn - 1) // 1000 AS part, rn, role = speaker AS own, text AS body,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
                                WHEN role <> '' THEN 'user name=' || role ELSE 'user' END || chr(10) AS head
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 11) OVER (
              PARTITION BY conv_id, speaker, part ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM r
)
SELECT conv_id, speaker, part::BIGINT AS part, count(*)::BIGINT AS n_turns,
       string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY rn) AS text,
       coalesce(string_agg(CASE WHEN own THEN (begins + length(head)) || '-' || (begins + length(head) + length(body) + 10) END, ',' ORDER BY rn), '') AS mask
FROM o GROUP BY conv_id, speaker, part
"""


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pu_quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold("doc_id", pu_quality.FOLDS) == 0, F.lit(False))
    return pu_quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", toxicity.HOLD_OUT_FOLDS) == 0, F.lit(False))
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).withColumn("held_out", held_out)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    held_out = F.coalesce(fold("doc_id", language_id.FOLDS) == language_id.HELD_OUT, F.lit(False))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard_join.near_duplicates(docs)
    return found.select("doc_id", "class_id", "copy_id", "n_copies", "n_links", "n_class_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_text": op2_html_text,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_piece_counts": op4_piece_counts,
    "op5_decontaminate": op5_decontaminate,
    "op6_chat_format": op6_chat_format,
    "op7_pu_quality": op7_pu_quality,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_chat_format": OP6_SQL,
}
