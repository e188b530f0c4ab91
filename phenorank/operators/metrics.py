"""Evaluation: ranking, calibration and mention metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_hit(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """``(case_id, hit_rank)``: the rank of a case's first right prediction among its distinct ones; null for none.

    ``predictions(case_id, profile_id, rank)``, ``truth(case_id, profile_id)``; every case with a truth has a row.
    """
    once = predictions.groupBy("case_id", "profile_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("case_id").orderBy("rank", "profile_id")
    once = once.withColumn("rank", F.row_number().over(w))
    hits = truth.distinct().join(once, ["case_id", "profile_id"]).groupBy("case_id").agg(F.min("rank").alias("hit_rank"))
    return truth.select("case_id").distinct().join(hits, "case_id", "left")


def hit_rank(places: DataFrame, truth: DataFrame) -> DataFrame:
    """``(case_id, hit_rank)`` as of :func:`first_hit`, from the places of the true profiles alone among all that were ranked."""
    hits = places.groupBy("case_id").agg(F.min("rank").alias("hit_rank"))
    return truth.select("case_id").distinct().join(hits, "case_id", "left")


def ranking_metrics(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: number of cases, accuracy within the first k, mean reciprocal rank."""
    shares = [F.avg(F.coalesce(F.col("hit_rank") <= k, F.lit(False)).cast("double")).alias(f"top_{k}") for k in ks]
    return hits.agg(F.count("*").alias("cases"), *shares, F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))).alias("mrr"))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """``(bin, n, mean_score, rate)`` of ``scored(score, label)`` for every bin, also empty ones."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    per = scored.withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("rate"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(per, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "rate")


def brier_ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row: Brier score, expected calibration error, log loss (scores clipped at 1e-12)."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    p = F.least(F.greatest(F.col("score"), F.lit(1e-12)), F.lit(1 - 1e-12))
    y = F.col("label").cast("double")
    per = scored.withColumn("bin", b).groupBy("bin").agg(
        F.count("*").alias("n"),
        F.avg("score").alias("s"),
        F.avg(y).alias("r"),
        F.sum(F.pow(F.col("score") - y, 2)).alias("sq"),
        F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("ll"),
    )
    return per.agg(
        F.sum("n").alias("n"),
        (F.sum("sq") / F.sum("n")).alias("brier"),
        (F.sum(F.col("n") * F.abs(F.col("s") - F.col("r"))) / F.sum("n")).alias("ece"),
        (F.sum("ll") / F.sum("n")).alias("log_loss"),
    )


def _score_counts(scored: DataFrame) -> DataFrame:
    """``(score, pos, neg)`` per distinct score, scores at six decimals."""
    y = F.col("label").cast("int")
    return scored.groupBy((F.col("score") + 0.0).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def running_totals(counts: DataFrame, key: str, columns: list[str], buckets: int = 200) -> DataFrame:
    """``counts`` with ``before_<column>``: sums over all smaller keys, in two levels so that no task sees all rows.

    ``key`` is a double in [0, 1]; it is cut into buckets, the bucket totals are prefix-summed, and rows within a
    bucket on top of that.
    """
    b = counts.withColumn("__b", F.least(F.floor(F.col(key) * buckets), F.lit(buckets - 1)).cast("int"))
    totals = b.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__b", *[F.coalesce(F.sum(f"__t_{c}").over(upto), F.lit(0)).alias(f"__o_{c}") for c in columns])
    inside = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = b.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{c}") for c in columns]).join(F.broadcast(totals), "__b")
    return rows.select(*counts.columns, *[(F.col(f"__o_{c}") + F.col(f"__i_{c}")).alias(f"before_{c}") for c in columns])


def auc(scored: DataFrame) -> DataFrame:
    """One row ``(auc)``: Mann-Whitney with ties counted half; null where one class is missing."""
    rows = running_totals(_score_counts(scored), "score", ["neg"])
    out = rows.agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """One row ``(threshold, balanced_accuracy)`` over the scores and 0.5: best balanced accuracy, nearest to 0.5, smallest.

    A score at the threshold counts as positive.
    """
    half = scored.sparkSession.range(1).select(F.lit(0.5).alias("score"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    counts = _score_counts(scored).unionByName(half).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = running_totals(counts, "score", ["pos", "neg"])
    total = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    rows = rows.join(F.broadcast(total), F.lit(True))
    part: Column = (F.coalesce((F.col("all_pos") - F.col("before_pos")) / F.nullif("all_pos", F.lit(0)), F.lit(0.0)) + F.coalesce(F.col("before_neg") / F.nullif("all_neg", F.lit(0)), F.lit(0.0))) / 2
    best = rows.select("score", F.round(part, 10).alias("b")).agg(F.max(F.struct("b", (-F.abs(F.col("score") - 0.5)).alias("near"), (-F.col("score")).alias("low"))).alias("m"))
    return best.select((-F.col("m.low")).alias("threshold"), F.col("m.b").alias("balanced_accuracy"))


def multiset_prf(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``(tp, fp, fn, precision, recall, f1)`` over the multisets of ``keys``."""
    g = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    p = predicted.groupBy(*keys).agg(F.count("*").alias("p"))
    both = g.join(p, keys, "full").select(F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    s = both.agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))
    tp, fp, fn = (F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "fn"))
    zero = F.lit(0.0)
    return s.select(
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), zero).alias("precision"),
        F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), zero).alias("recall"),
        F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), zero).alias("f1"),
    )


def span_scores(samples: DataFrame, gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """One row: exact spans of ``predicted(key, start, end)`` against ``gold``, over the sets of each of ``samples(key, failed)``.

    samples, invalid_outputs, tp, fp, fn, precision, recall, f1, the share of samples whose sets are equal, and gold spans
    that weren't found but hold at least two predicted spans. The gold spans of a failed sample are all missed, its
    predictions don't count.
    """
    known = samples.select(key, F.coalesce("failed", F.lit(False)).alias("failed")).groupBy(key).agg(F.max("failed").alias("failed"))
    g = gold.select(key, "start", "end").distinct().join(known, key).select("*", F.lit(1).alias("g"))
    p = predicted.select(key, "start", "end").distinct().join(known.where("not failed").select(key), key, "left_semi").select("*", F.lit(1).alias("p"))
    both = g.join(p, [key, "start", "end"], "full").select(key, "start", "end", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"), "failed")
    per = both.groupBy(key).agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    missed = both.where("g = 1 and p = 0 and not failed").select(key, F.struct("start", "end").alias("id"), "start", "end")
    inside = overlaps(missed, p.select(key, F.struct("start", "end").alias("id"), "start", "end"), key).where("right_id.start >= left_id.start and right_id.end <= left_id.end")
    broken = inside.groupBy(key, "left_id").agg(F.count("*").alias("n")).where("n >= 2").agg(F.count("*").alias("fragmented"))
    rows = known.join(per, key, "left").na.fill(0, ["tp", "fp", "fn"])
    exact = (~F.col("failed") & (F.col("fp") + F.col("fn") == 0)).cast("double")
    one = rows.agg(
        F.count("*").alias("samples"), F.count_if("failed").alias("invalid_outputs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.coalesce(F.avg(exact), F.lit(0.0)).alias("exact_rate")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = one.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.lit(1).alias("__k"))
    return out.join(F.broadcast(broken.withColumn("__k", F.lit(1))), "__k").drop("__k")


def label_f1(pairs: DataFrame) -> DataFrame:
    """``(label, tp, fp, fn, f1)`` per label of ``pairs(gold, predicted)``; null on a side counts as no label."""
    g = pairs.where("gold is not null").groupBy(F.col("gold").alias("label")).agg(F.sum(F.when(F.col("predicted") == F.col("gold"), 1).otherwise(0)).alias("tp"), F.count("*").alias("g"))
    p = pairs.where("predicted is not null").groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("p"))
    rows = g.join(p, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "g", "p")])
    return rows.select("label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), F.coalesce(2 * F.col("tp") / F.nullif(F.col("g") + F.col("p"), F.lit(0)), F.lit(0.0)).alias("f1"))


def overlaps(left: DataFrame, right: DataFrame, key: str, bin_size: int = 64) -> DataFrame:
    """``(key, left_id, right_id)``: half-open spans of the same key that overlap, each pair once.

    ``left`` and ``right`` hold (key, id, start, end). Spans are spread over bins of the text, so a long text with many
    spans isn't compared all against all; a pair is kept in the first bin both reach. Empty spans overlap nothing.
    """

    def spread(df: DataFrame, name: str) -> DataFrame:
        ok = df.where("end > start").select(key, F.col("id").alias(f"{name}_id"), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"))
        return ok.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{name}_start") / bin_size), F.floor((F.col(f"{name}_end") - 1) / bin_size))))

    a, b = spread(left, "left"), spread(right, "right")
    first = F.floor(F.greatest("left_start", "right_start") / bin_size)
    return a.join(b, [key, "bin"]).where("left_start < right_end and right_start < left_end").where(F.col("bin") == first).select(key, "left_id", "right_id")
