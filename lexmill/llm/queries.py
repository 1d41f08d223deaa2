"""The problems' queries; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import p01_visual, p02_overlap, p03_copies, p04_leak, p05_sentences, p06_splits, p07_quality, p08_packing, p09_mixing, p10_language


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p01_visual.found(_table(spark, sf, "data_row"), _table(spark, sf, "clean_document"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p02_overlap.found(_table(spark, sf, "data_row"))


def p2_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return p02_overlap.report(_table(spark, sf, "data_row"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p03_copies.found(_table(spark, sf, "data_row"), _table(spark, sf, "clean_document"))


def p3_counted(spark: SparkSession, sf: str) -> DataFrame:
    return p03_copies.counted(_table(spark, sf, "data_row"), _table(spark, sf, "clean_document"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p04_leak.found(_table(spark, sf, "clean_document"), _table(spark, sf, "dataset_case"))


def p4_proximity(spark: SparkSession, sf: str) -> DataFrame:
    return p04_leak.near(_table(spark, sf, "clean_document"), _table(spark, sf, "dataset_case"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p05_sentences.found(_table(spark, sf, "boundary_document"), _table(spark, sf, "boundary_sample"), _table(spark, sf, "clean_document"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p06_splits.found(*(_table(spark, sf, t) for t in ("data_row", "correction_pair", "split_share")))


def p6_splits(spark: SparkSession, sf: str) -> DataFrame:
    return p06_splits.assigned(*(_table(spark, sf, t) for t in ("data_row", "correction_pair", "split_share")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p07_quality.found(*(_table(spark, sf, t) for t in ("clean_document", "prose_label", "function_word")))


def p7_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return p07_quality.statistics(*(_table(spark, sf, t) for t in ("clean_document", "function_word")))


def p7_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return p07_quality.by_source(*(_table(spark, sf, t) for t in ("clean_document", "prose_label", "function_word")))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return p08_packing.packed(_table(spark, sf, "documents"), _table(spark, sf, "pack_capacity"))


def p8_usage(spark: SparkSession, sf: str) -> DataFrame:
    return p08_packing.usage(_table(spark, sf, "documents"), _table(spark, sf, "pack_capacity"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return p09_mixing.mixed(_table(spark, sf, "documents"), _table(spark, sf, "source_weight"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return p09_mixing.shares(_table(spark, sf, "documents"), _table(spark, sf, "source_weight"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_language.found(_table(spark, sf, "documents"), _table(spark, sf, "function_word"))


def p10_stretches(spark: SparkSession, sf: str) -> DataFrame:
    return p10_language.stretches(_table(spark, sf, "documents"), _table(spark, sf, "function_word"))


_QUERIES = (p1_found, p2_found, p2_by_source, p3_found, p3_counted, p4_found, p4_proximity, p5_found, p6_found, p6_splits, p7_found, p7_statistics, p7_by_source, p8_packed, p8_usage, p9_mix, p9_shares, p10_found, p10_stretches)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


_RELATED = """
WITH RECURSIVE g AS (SELECT DISTINCT document_id AS d, trim(regexp_replace(lower(group_id), '[\\s\\p{Z}]+', ' ', 'g')) AS k FROM correction_pair WHERE document_id IS NOT NULL AND group_id IS NOT NULL),
e AS (SELECT 'd:' || d AS a, 'g:' || k AS b FROM g WHERE k NOT IN ('', 'n/a', '-', 'unknown', 'yoxdur')),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, seen) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, reach.seen FROM reach JOIN u ON reach.node = u.a),
r AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT substr(root, 3) AS lead_document_id, substr(node, 3) AS document_id FROM r WHERE node LIKE 'd:%' AND node <> root"""

_STATISTICS = r"""
WITH f AS (SELECT DISTINCT lower(trim(word)) AS w FROM function_word WHERE word IS NOT NULL), fs AS (SELECT list(w) AS common FROM f),
b AS (SELECT document_id, source, coalesce(text, '') AS t FROM clean_document),
x AS (SELECT document_id, source, t, regexp_extract_all(lower(translate(t, 'Iİ', 'ıi')), '[\p{L}\p{N}]+') AS w, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^ \t\r]')) AS l, common FROM b, fs)
SELECT document_id, source, len(w)::BIGINT AS n_words, round(length(array_to_string(w, ''))::DOUBLE / nullif(len(w), 0), 6) AS mean_word_len,
  round(length(regexp_replace(t, '[\p{L}\p{N} \t\r\n]', '', 'g'))::DOUBLE / nullif(length(t), 0), 6) AS symbol_ratio,
  round(len(list_filter(l, lambda s: regexp_matches(s, '[.!?…。！？।؟][»”"'')\]]*[ \t\r]*\z')))::DOUBLE / nullif(len(l), 0), 6) AS closed_lines,
  round(len(list_filter(w, lambda y: list_contains(common, y)))::DOUBLE / nullif(len(w), 0), 6) AS common_words,
  round(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 6) AS distinct_words FROM x"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": _RELATED, "p7_statistics": _STATISTICS}
