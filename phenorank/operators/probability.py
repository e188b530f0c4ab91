"""Bounded likelihood ratios, group caps, posteriors with an explicit unknown class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenorank.functions.scalars import EPSILON, clip, log_odds, sigmoid

TERM_CAP, GROUP_CAP, FLOOR = 5.0, 8.0, 1e-6
UNKNOWN = "OTHER_OR_UNKNOWN"


def bounded_llr(p: Column, q: Column, absent: Column) -> Column:
    """ln p/q of a finding, ln (1-p)/(1-q) of its absence, both clipped first and the ratio capped."""
    a, b = clip(p, EPSILON, 1 - EPSILON), clip(q, EPSILON, 1 - EPSILON)
    return clip(F.when(absent, F.log1p(-a) - F.log1p(-b)).otherwise(F.log(a) - F.log(b)), -TERM_CAP, TERM_CAP)


def group_capped(terms: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, llr, capped_groups)`` of ``terms(keys, group_id, contribution)``: each group's sum capped, the null group's not."""
    per = terms.groupBy(*keys, "group_id").agg(F.sum("contribution").alias("total"))
    capped = F.when(F.col("group_id").isNull(), F.col("total")).otherwise(clip(F.col("total"), -GROUP_CAP, GROUP_CAP))
    return per.groupBy(*keys).agg(F.sum(capped).alias("llr"), F.sum((capped != F.col("total")).cast("int")).alias("capped_groups"))


def binary_posterior(prior: Column, llr: Column) -> Column:
    """Null without a prior."""
    return F.when(prior.isNotNull() & llr.isNotNull(), clip(sigmoid(log_odds(prior) + llr), FLOOR, 1 - FLOOR))


def single_cause(candidates: DataFrame, key: str = "case_id") -> DataFrame:
    """Softmax over the candidates of a case with a prior, and an unknown class.

    ``candidates(key, profile_id, prior, llr)``; the unknown class has what priors leave, within [0.05, 0.95], and a
    ratio of one. Returns posterior per candidate and the unknown class, and whether that reaches a half.
    """
    with_prior = candidates.where("prior is not null").select(key, "profile_id", "prior", "llr")
    rest = with_prior.groupBy(key).agg(clip(1 - F.sum("prior"), 0.05, 0.95).alias("prior"))
    unknown = rest.select(key, F.lit(UNKNOWN).alias("profile_id"), "prior", F.lit(0.0).alias("llr"))
    rows = with_prior.unionByName(unknown).withColumn("x", F.log("prior") + F.col("llr"))
    w = Window.partitionBy(key)
    rows = rows.withColumn("top", F.max("x").over(w)).withColumn("e", F.exp(F.col("x") - F.col("top"))).withColumn("posterior", F.col("e") / F.sum("e").over(w))
    rows = rows.withColumn("unknown_dominates", F.max(F.when(F.col("profile_id") == UNKNOWN, F.col("posterior"))).over(w) >= 0.5)
    return rows.select(key, "profile_id", "prior", "llr", "posterior", "unknown_dominates")


def prior_for(candidates: DataFrame, priors: DataFrame) -> DataFrame:
    """``candidates`` with ``prior``: of the cohort, else of the sex, else in general, else null.

    ``priors(profile_id, cohort_id, sex, p)`` with at most one row per profile and level; candidates have cohort_id and sex.
    """
    by_cohort = priors.where("cohort_id is not null").groupBy("profile_id", "cohort_id").agg(F.max("p").alias("p_cohort"))
    by_sex = priors.where("cohort_id is null and sex is not null").groupBy("profile_id", "sex").agg(F.max("p").alias("p_sex"))
    general = priors.where("cohort_id is null and sex is null").groupBy("profile_id").agg(F.max("p").alias("p_all"))
    j = candidates.join(by_cohort, ["profile_id", "cohort_id"], "left").join(by_sex, ["profile_id", "sex"], "left").join(general, "profile_id", "left")
    return j.withColumn("prior", F.coalesce("p_cohort", "p_sex", "p_all")).drop("p_cohort", "p_sex", "p_all")
