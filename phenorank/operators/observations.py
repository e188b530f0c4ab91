"""Case observations: validation, sanitation and evidence weights. Bad rows are reported, never fatal for the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenorank.functions.scalars import clip, finite, normalize_status, normalize_subject, normalize_term_id

STRENGTH = {"PRESENT": 2, "SUSPECTED": 1}


def exploded(cases: DataFrame) -> DataFrame:
    """One row per case and observation: ``(case_id, ord, term, status, subject, reviewer_status, confidences...)``.

    Repeated case rows count once: of several rows of a case the first by received_at speaks for it.
    """
    once = cases.where("case_id is not null").groupBy("case_id").agg(F.min_by("observations", F.struct("received_at", F.to_json("observations"))).alias("observations"))
    rows = once.select("case_id", F.posexplode("observations").alias("ord", "o"))
    return rows.select(
        "case_id",
        "ord",
        normalize_term_id(F.col("o.hpo_id")).alias("term"),
        normalize_status(F.col("o.status")).alias("status"),
        normalize_subject(F.col("o.subject")).alias("subject"),
        F.upper(F.trim("o.reviewer_status")).alias("reviewer_status"),
        F.col("o.extraction_confidence").alias("extraction_confidence"),
        F.col("o.linking_confidence").alias("linking_confidence"),
        F.col("o.assertion_certainty").alias("assertion_certainty"),
        F.col("o.gestational_age_weeks").alias("gestational_age_weeks"),
    )


def problems(observations: DataFrame) -> DataFrame:
    """``(case_id, ord, problem)``: every broken rule of every observation."""

    def share(name: str) -> Column:
        bad = F.col(name).isNotNull() & (finite(F.col(name)).isNull() | ~F.col(name).between(0, 1))
        return F.when(bad, F.lit(f"{name} outside 0 to 1"))

    week = F.col("gestational_age_weeks")
    found = F.array(
        F.when(F.col("term").isNull(), F.lit("no term id")),
        F.when(F.col("status").isNull(), F.lit("unknown status")),
        share("extraction_confidence"),
        share("linking_confidence"),
        share("assertion_certainty"),
        F.when(week.isNotNull() & (finite(week).isNull() | ~week.between(0, 45)), F.lit("gestational age outside 0 to 45")),
    )
    return observations.select("case_id", "ord", F.explode(F.array_compact(found)).alias("problem"))


def weight(status: Column, reviewer: Column, extraction: Column, linking: Column) -> Column:
    """Evidence weight: none for rejected or unassessed, full for confirmed, else by the confidences given.

    SUSPECTED counts half without a confidence, else three quarters of it within [0.10, 0.75].
    """
    confirmed = F.coalesce(reviewer == "CLINICIAN_CONFIRMED", F.lit(False))
    product = F.when(confirmed, F.lit(1.0)).otherwise(F.coalesce(extraction, F.lit(1.0)) * F.coalesce(linking, F.lit(1.0)))
    no_confidence = extraction.isNull() & linking.isNull()
    return (
        F.when(F.coalesce(reviewer == "REJECTED", F.lit(False)) | (status == "NOT_ASSESSED") | status.isNull(), F.lit(0.0))
        .when(status.isin("PRESENT", "ABSENT"), clip(product, 0.0, 1.0))
        .otherwise(F.when(no_confidence & ~confirmed, F.lit(0.5)).otherwise(clip(0.75 * product, 0.10, 0.75)))
    )


def merged(observations: DataFrame) -> DataFrame:
    """One row per case and term, with ``conflict`` where it is both found and absent.

    NOT_ASSESSED yields to any other status and PRESENT to none but ABSENT; confidences are the largest given, the
    gestational age the first given, mentions are counted.
    """
    rank = F.expr("case status when 'PRESENT' then 3 when 'SUSPECTED' then 2 when 'ABSENT' then 2 when 'NOT_ASSESSED' then 1 else 0 end")
    rows = observations.where("term is not null and status is not null").withColumn("__rank", rank)
    return rows.groupBy("case_id", "term").agg(
        F.min("ord").alias("ord"),
        F.max_by("status", F.struct("__rank", -F.col("ord"))).alias("status"),
        (F.max(F.when(F.col("status").isin("PRESENT", "SUSPECTED"), 1).otherwise(0)) + F.max(F.when(F.col("status") == "ABSENT", 1).otherwise(0)) == 2).alias("conflict"),
        F.max("extraction_confidence").alias("extraction_confidence"),
        F.max("linking_confidence").alias("linking_confidence"),
        F.max("reviewer_status").alias("reviewer_status"),
        F.min_by("gestational_age_weeks", F.when(F.col("gestational_age_weeks").isNotNull(), F.col("ord"))).alias("gestational_age_weeks"),
        F.count("*").alias("mention_count"),
    )


def contradictions(merged_rows: DataFrame, closed_terms: DataFrame) -> DataFrame:
    """``(case_id, absent_term, present_term)``: an absent term at or above one that was found."""
    absent = merged_rows.where("status = 'ABSENT'").select("case_id", F.col("term").alias("absent_term"))
    found = merged_rows.where("status in ('PRESENT', 'SUSPECTED')").select("case_id", F.col("term").alias("present_term"))
    above = found.join(closed_terms.where("dist > 0").select(F.col("term").alias("present_term"), F.col("anc").alias("absent_term")), "present_term")
    deep = absent.join(above, ["case_id", "absent_term"]).select("case_id", "absent_term", "present_term")
    same = merged_rows.where("conflict").select("case_id", F.col("term").alias("absent_term"), F.col("term").alias("present_term"))
    return deep.unionByName(same).distinct()


def redundant(merged_rows: DataFrame, closed_terms: DataFrame) -> DataFrame:
    """``(case_id, term)`` to drop: a found term above a found one of at least its strength, an absent one below an absent one."""
    up = closed_terms.where("dist > 0")
    strength = F.expr("case status when 'PRESENT' then 2 when 'SUSPECTED' then 1 end")
    found = merged_rows.where("status in ('PRESENT', 'SUSPECTED')").select("case_id", "term", strength.alias("s"))
    low = found.select("case_id", F.col("term").alias("lower"), F.col("s").alias("s_low")).join(up.select(F.col("term").alias("lower"), F.col("anc").alias("term")), "lower")
    general = found.join(low, ["case_id", "term"]).where("s_low >= s").select("case_id", "term")
    absent = merged_rows.where("status = 'ABSENT'").select("case_id", "term")
    below = absent.join(up.select("term", F.col("anc").alias("upper")), "term").join(absent.select("case_id", F.col("term").alias("upper")), ["case_id", "upper"]).select("case_id", "term")
    return general.unionByName(below).distinct()


def sanitized(observations: DataFrame, closed_terms: DataFrame, root: str | None = None) -> DataFrame:
    """``(case_id, ord, term, status, w)`` that go into scoring: known, merged, free of the root and of redundant terms.

    Cases with a contradiction are left out as a whole; see :func:`abstentions` for why a case has no row.
    """
    known = closed_terms.where("dist = 0").select("term")
    m = merged(observations.join(known, "term", "left_semi"))
    m = m.where(F.col("term") != root) if root else m
    m = m.join(contradictions(m, closed_terms).select("case_id").distinct(), "case_id", "left_anti")
    kept = m.join(redundant(m, closed_terms), ["case_id", "term"], "left_anti")
    w = weight(F.col("status"), F.col("reviewer_status"), F.col("extraction_confidence"), F.col("linking_confidence"))
    return kept.select("case_id", "ord", "term", "status", w.alias("w"))


def abstentions(observations: DataFrame, closed_terms: DataFrame, stats: DataFrame, root: str | None = None, least_ic: float = 0.05) -> DataFrame:
    """``(case_id, reason)``: why a case can't be ranked, the first reason that holds; null where it can."""
    known = closed_terms.where("dist = 0").select("term", F.lit(True).alias("known"))
    rows = observations.join(known, "term", "left").join(stats.select("term", "ic"), "term", "left")
    clash = contradictions(merged(observations.where("term is not null")), closed_terms).select("case_id", F.lit(True).alias("clash")).distinct()
    is_root = (F.col("term") == root) if root else F.lit(False)
    valid = F.coalesce(F.col("known"), F.lit(False)) & ~is_root & F.col("status").isNotNull()
    found = valid & F.col("status").isin("PRESENT", "SUSPECTED")
    per = rows.groupBy("case_id").agg(
        F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("unknown"),
        F.sum(F.when(valid, 1).otherwise(0)).alias("valid"),
        F.max(F.when(is_root, 1).otherwise(0)).alias("root"),
        F.sum(F.when(valid & (F.col("status") != "NOT_ASSESSED"), 1).otherwise(0)).alias("assessed"),
        F.sum(F.when(found, 1).otherwise(0)).alias("found"),
        F.max(F.when(found, F.col("ic"))).alias("best_ic"),
    )
    reason = (
        F.when(F.col("unknown") > 0, "UNKNOWN_TERM_ID")
        .when(F.col("clash"), "UNRESOLVED_CONTRADICTION")
        .when((F.col("valid") == 0) & (F.col("root") == 1), "ONLY_ROOT_PHENOTYPE")
        .when(F.col("valid") == 0, "NO_VALID_OBSERVATION")
        .when(F.col("assessed") == 0, "ALL_NOT_ASSESSED")
        .when(F.col("found") == 0, "NO_POSITIVE_OBSERVATION")
        .when(F.col("best_ic") < least_ic, "ONLY_VERY_GENERAL_TERMS")
    )
    return per.join(clash, "case_id", "left").select("case_id", reason.alias("reason"))
