"""Calibration data: negatives, leakage checks, logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenorank.session import discard, written


def sampled_negatives(profiles: DataFrame, gold: DataFrame, most: int = 100, seed: int = 17) -> DataFrame:
    """``(case_id, profile_id, label, weight)``: a case's gold profiles and up to ``most`` others, drawn by hash.

    Profiles are numbered in the order of their hashes. A case draws numbers, ``4 * most`` times, from the hash of seed,
    case and draw; what it draws first counts, repeats and gold profiles don't. Each negative weighs as many profiles
    as it stands for. No pair of case and profile is made but those drawn; cases are those with a gold profile.
    """
    g = gold.select("case_id", "profile_id").distinct()
    first = F.substring(F.sha2("profile_id", 256), 1, 2)  # 256 buckets, each numbered by itself
    numbered = profiles.select("profile_id").distinct().withColumn("__b", first).withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy("profile_id")))
    per = numbered.groupBy("__b").agg(F.count("*").alias("n"))
    before = per.select("__b", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = numbered.join(F.broadcast(before), "__b").select("profile_id", (F.col("__before") + F.col("__n") - 1).alias("at"))
    total = profiles.select("profile_id").distinct().count()
    if not total:
        return g.select("case_id", "profile_id", F.lit(1).alias("label"), F.lit(1.0).alias("weight"))
    draws = g.select("case_id").distinct().select("case_id", F.explode(F.sequence(F.lit(0), F.lit(4 * most - 1))).alias("draw"))
    drawn = draws.withColumn("at", F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "case_id", F.col("draw").cast("string")), 256), 1, 8), 16, 10).cast("bigint") % total)
    drawn = drawn.groupBy("case_id", "at").agg(F.min("draw").alias("draw")).join(numbered, "at").join(g, ["case_id", "profile_id"], "left_anti")
    w = Window.partitionBy("case_id")
    kept = drawn.withColumn("__n", F.row_number().over(w.orderBy("draw"))).where(F.col("__n") <= most).withColumn("__k", F.count("*").over(w))
    others = g.join(numbered, "profile_id", "left_semi").groupBy("case_id").agg(F.count("*").alias("__known"))
    negatives = kept.join(others, "case_id", "left").select("case_id", "profile_id", F.lit(0).alias("label"), ((F.lit(total) - F.coalesce("__known", F.lit(0))) / F.col("__k")).alias("weight"))
    return g.select("case_id", "profile_id", F.lit(1).alias("label"), F.lit(1.0).alias("weight")).unionByName(negatives)


def crossing(cases: DataFrame, column: str, split: str = "split") -> DataFrame:
    """``(value, splits)``: values of a column that occur in more than one split."""
    return cases.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def label_problems(cases: DataFrame) -> DataFrame:
    """``(case_id, problem)``: every broken rule of every calibration case; repeated rows of a case count once."""
    found = F.array(
        F.when(F.coalesce(F.size("observations"), F.lit(0)) <= 0, F.lit("no observation")),
        F.when(F.coalesce(F.size("gold_disease_ids"), F.lit(0)) <= 0, F.lit("no gold disease")),
        F.when(F.col("reference_standard.source").isNull(), F.lit("no reference source")),
        F.when(F.coalesce(F.lower(F.trim("review_status")), F.lit("")) != "approved", F.lit("not approved")),
        F.when(F.coalesce("synthetic", F.lit(False)), F.lit("synthetic")),
        F.when(~F.coalesce(F.lower(F.trim("split")), F.lit("")).isin("train", "validation", "test"), F.lit("split spelled otherwise")),
    )
    return cases.where("case_id is not null").select("case_id", F.explode(F.array_compact(found)).alias("problem")).distinct()


def fit_logistic(rows: DataFrame, features: list[str], label: str = "label", weight: str | None = None, iterations: int = 12, l2: float = 1e-3) -> dict:
    """Weighted logistic regression by Newton steps on z-scored features.

    Each step sums gradient and Hessian (features squared numbers) over all rows in Spark; nothing else is collected.
    Returns mean, scale, coefficients and intercept. Fewer than two classes give zero coefficients and the base rate.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    k = len(features)
    base, path = written(rows.where(" and ".join(f"`{f}` is not null and not isnan(`{f}`)" for f in features)).select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double").alias("__y"), w.cast("double").alias("__w")), "training")
    s = base.agg(F.sum("__w"), F.sum(F.col("__w") * F.col("__y")), *[F.sum(F.col("__w") * F.col(f)) for f in features], *[F.sum(F.col("__w") * F.col(f) * F.col(f)) for f in features]).collect()[0]
    total, hits = s[0] or 0.0, s[1] or 0.0
    if total == 0 or hits in (0.0, total):
        return {"mean": [0.0] * k, "scale": [1.0] * k, "coefficients": [0.0] * k, "intercept": 0.0 if total == 0 else (35.0 if hits else -35.0)}
    mean = np.array([s[2 + i] / total for i in range(k)])
    scale = np.sqrt(np.maximum(np.array([s[2 + k + i] / total for i in range(k)]) - mean**2, 0))
    scale[scale < 1e-12] = 1.0
    beta = np.zeros(k + 1)
    for _ in range(iterations):
        z = [(F.col(f) - float(mean[i])) / float(scale[i]) for i, f in enumerate(features)] + [F.lit(1.0)]
        x = F.least(F.greatest(sum((z[i] * float(beta[i]) for i in range(k)), F.lit(float(beta[k]))), F.lit(-35.0)), F.lit(35.0))
        p = 1 / (1 + F.exp(-x))
        rows_p = base.withColumn("__p", p)
        r, h = (F.col("__p") - F.col("__y")) * F.col("__w"), F.col("__p") * (1 - F.col("__p")) * F.col("__w")
        sums = rows_p.agg(*[F.sum(r * z[i]) for i in range(k + 1)], *[F.sum(h * z[i] * z[j]) for i in range(k + 1) for j in range(i, k + 1)]).collect()[0]
        gradient = np.array(sums[: k + 1]) / total
        hessian = np.zeros((k + 1, k + 1))
        at = k + 1
        for i in range(k + 1):
            for j in range(i, k + 1):
                hessian[i, j] = hessian[j, i] = sums[at] / total
                at += 1
        gradient[:k] += l2 * beta[:k]
        hessian += np.diag([l2] * k + [1e-12])
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    discard(rows.sparkSession, path)
    return {"mean": mean.tolist(), "scale": scale.tolist(), "coefficients": beta[:k].tolist(), "intercept": float(beta[k])}


def predicted(rows: DataFrame, model: dict, features: list[str], out: str = "probability") -> DataFrame:
    """``rows`` with the model's probability, as a plain column expression."""
    x = F.lit(float(model["intercept"]))
    for f, m, s, c in zip(features, model["mean"], model["scale"], model["coefficients"], strict=True):
        x = x + (F.col(f) - float(m)) / float(s) * float(c)
    x = F.least(F.greatest(x, F.lit(-35.0)), F.lit(35.0))
    return rows.withColumn(out, 1 / (1 + F.exp(-x)))
