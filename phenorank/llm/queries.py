"""Queries of the operators for language-model data, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phenorank.llm import grouping, leakage, lookalike, mapping, overlap, packing, residue
from phenorank.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.found(spark, table(spark, sf_dir, "phenotype_mention"), table(spark, sf_dir, "hpo_catalog_vi"))


def p1_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention with the one spelling of its text."""
    words = lookalike.vocabulary(table(spark, sf_dir, "hpo_catalog_vi"), "vi")
    return lookalike.spelled(table(spark, sf_dir, "phenotype_mention").select("mention_id", "mention_text"), "mention_text", words)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found(spark, table(spark, sf_dir, "calibration_case"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(table(spark, sf_dir, "calibration_case"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.found(spark, table(spark, sf_dir, "calibration_case"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.split_groups(table(spark, sf_dir, "calibration_case"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.found(spark, table(spark, sf_dir, "phenotype_mention"), table(spark, sf_dir, "hpo_catalog_vi"), table(spark, sf_dir, "hpo_candidate"))


def p6_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unlinked mentions that name no entry."""
    return mapping.misses(table(spark, sf_dir, "phenotype_mention"), table(spark, sf_dir, "hpo_catalog_vi"), table(spark, sf_dir, "hpo_candidate"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p7_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers the documents take, and how little room is left."""
    return packing.filling(spark, table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of documents that hold them."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found(spark, table(spark, sf_dir, "documents"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that aren't template residue."""
    return residue.without_residue(table(spark, sf_dir, "documents"))


_CASES = """
WITH flat AS (
  SELECT case_id,
    CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('validation', 'val') THEN 'validation'
         WHEN lower(trim(split)) = 'test' THEN 'test' END AS split,
    reference_standard.source AS source,
    [regexp_replace(upper(x), '[^A-Z0-9]', '', 'g') FOR x IN gold_disease_ids] AS gold,
    [regexp_replace(upper(o.hpo_id), '[^A-Z0-9]', '', 'g') || '|' ||
      CASE upper(trim(o.status)) WHEN 'CÓ' THEN 'PRESENT' WHEN 'NGHI NGỜ' THEN 'SUSPECTED' WHEN 'KHÔNG' THEN 'ABSENT' ELSE upper(trim(o.status)) END FOR o IN observations] AS features
  FROM calibration_case
),
cases AS (
  SELECT case_id, split, min(source) AS source, list_sort(list_distinct(flatten(list(gold)))) AS gold, list_sort(list_distinct(flatten(list(features)))) AS features
  FROM flat WHERE case_id IS NOT NULL AND split IS NOT NULL GROUP BY case_id, split
),
leaks AS (
  SELECT t.case_id AS train_id, e.case_id AS eval_id, e.split, e.source
  FROM cases t JOIN cases e ON t.gold = e.gold AND t.split = 'train' AND e.split <> 'train'
  WHERE 4 * len(list_intersect(t.features, e.features)) >= 3 * (len(t.features) + len(e.features) - len(list_intersect(t.features, e.features)))
)
"""

P4_SQL = _CASES + "SELECT DISTINCT least(train_id, eval_id) AS case_id_a, greatest(train_id, eval_id) AS case_id_b FROM leaks"

P4_REPORT_SQL = (
    _CASES
    + """
SELECT c.split, c.source, count(DISTINCT c.case_id) AS cases, count(DISTINCT l.eval_id) AS leaked_cases
FROM cases c LEFT JOIN leaks l ON l.eval_id = c.case_id AND l.split = c.split WHERE c.split <> 'train' GROUP BY c.split, c.source
"""
)

P5_SQL = f"""
WITH RECURSIVE ties AS (
  SELECT DISTINCT case_id, kind || lower(trim(v)) AS shared FROM (
    SELECT case_id, 'p' AS kind, patient_id AS v FROM calibration_case
    UNION ALL SELECT case_id, 'f', family_id FROM calibration_case
    UNION ALL SELECT case_id, 'g', group_id FROM calibration_case)
  WHERE v IS NOT NULL AND lower(trim(v)) NOT IN ({", ".join("'" + v.replace("'", "''") + "'" for v in grouping.NOT_GIVEN)})
),
low AS (SELECT case_id, shared, min(case_id) OVER (PARTITION BY shared) AS least FROM ties),
edges AS (SELECT DISTINCT case_id AS a, least AS b FROM low UNION SELECT DISTINCT least, case_id FROM low),
reach(a, b) AS (
  SELECT a, b FROM edges
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
),
sets AS (SELECT a AS case_id, min(b) AS set_id, count(DISTINCT b) AS n FROM reach GROUP BY a)
SELECT case_id, set_id FROM sets WHERE n > 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_spelled": p1_spelled,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p6_found": p6_found,
    "p6_misses": p6_misses,
    "p7_packed": p7_packed,
    "p7_filling": p7_filling,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
}

SQL: dict[str, str] = {"p4_found": P4_SQL, "p4_report": P4_REPORT_SQL, "p5_found": P5_SQL}
