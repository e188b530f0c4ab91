"""Review sheets, hand-off and selection state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenorank.functions.scalars import normalize_status, normalize_subject, normalize_term_id


def latest(mentions: DataFrame) -> DataFrame:
    """One row per mention: the one received last, ties by all columns' text."""
    w = Window.partitionBy("mention_id").orderBy(F.col("received_at").desc_nulls_last(), F.to_json(F.struct(*[F.col(c) for c in mentions.columns])))
    return mentions.where("mention_id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def review_sheet(mentions: DataFrame) -> DataFrame:
    """``(report_id, mention_id, item, mention_text, hpo_id, status, subject, action)``: the rows a reviewer gets, in text order."""
    w = Window.partitionBy("report_id").orderBy(F.col("span_start").asc_nulls_last(), "mention_id")
    return latest(mentions).select(
        "report_id",
        "mention_id",
        F.row_number().over(w).alias("item"),
        "mention_text",
        normalize_term_id(F.col("hpo_id")).alias("hpo_id"),
        normalize_status(F.col("assertion")).alias("status"),
        normalize_subject(F.col("subject")).alias("subject"),
        F.when(F.coalesce("needs_review", F.lit(True)), "review").otherwise("accept").alias("action"),
    )


def applied(sheet: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)``: the sheet after ``decisions(mention_id, seen_hpo_id, action, new_hpo_id)``.

    A decision counts where it was made on the id still in the sheet: accept, edit (takes new_hpo_id) or reject (drops
    the row). Decisions on unknown rows or on another id are refused, with the reason.
    """
    d = decisions.dropDuplicates(["mention_id"])
    j = sheet.join(d.select("mention_id", "seen_hpo_id", F.col("action").alias("decision"), "new_hpo_id"), "mention_id", "left")
    fits = F.col("decision").isNull() | F.col("seen_hpo_id").eqNullSafe(F.col("hpo_id"))
    done = j.where(fits & (F.coalesce("decision", F.lit("accept")) != "reject"))
    accepted = done.select(*[c if c != "hpo_id" else F.when(F.col("decision") == "edit", normalize_term_id(F.col("new_hpo_id"))).otherwise(F.col("hpo_id")).alias("hpo_id") for c in sheet.columns])
    stale = j.where(~fits).select("mention_id", F.lit("sheet changed since").alias("reason"))
    unknown = d.join(sheet.select("mention_id"), "mention_id", "left_anti").select("mention_id", F.lit("no such row").alias("reason"))
    return accepted, stale.unionByName(unknown)


def handoff(sheet: DataFrame) -> DataFrame:
    """``sheet`` with ``target``: observations of the fetus, context of others, ignored where no term or status is known."""
    target = F.when(F.col("hpo_id").isNull() | F.col("status").isNull(), "ignored").when(F.col("subject") == "fetus", "observation").otherwise("context")
    return sheet.withColumn("target", target)


def handoff_counts(sheet: DataFrame) -> DataFrame:
    return handoff(sheet).groupBy("report_id", "target").agg(F.count("*").alias("n"))


def selection_state(events: DataFrame) -> DataFrame:
    """``(case_id, term, status, sources, duplicates, conflicts)`` after ``events(case_id, term, status, at, seq)``, in order of time and seq.

    The first status stays; a later event with the same status is a duplicate, with another one a pending conflict.
    """
    ordered = events.where("case_id is not null and term is not null and status is not null")
    first = ordered.groupBy("case_id", "term").agg(F.min_by("status", F.struct("at", "seq")).alias("kept"))
    j = ordered.join(first, ["case_id", "term"])
    return j.groupBy("case_id", "term", F.col("kept").alias("status")).agg(
        F.count("*").alias("sources"), (F.sum((F.col("status") == F.col("kept")).cast("int")) - 1).alias("duplicates"), F.sum((F.col("status") != F.col("kept")).cast("int")).alias("conflicts")
    )
