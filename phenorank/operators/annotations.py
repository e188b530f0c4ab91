"""Annotation rows folded into profiles: frequency text, policies, positive and negative terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenorank.functions.scalars import EPSILON, clip, finite, normalize_term_id

# Probability of each frequency code and label; longest label first.
CODE_VALUES = {"HP:0040280": 0.995, "HP:0040281": 0.90, "HP:0040282": 0.545, "HP:0040283": 0.17, "HP:0040284": 0.025, "HP:0040285": 0.0}
LABEL_VALUES = [("very frequent", 0.90), ("occasional", 0.17), ("very rare", 0.025), ("obligate", 0.995), ("frequent", 0.545), ("excluded", 0.0)]
DEFAULT_FREQUENCY = 0.5


def _number(text: Column, pattern: str, group: int) -> Column:
    return finite(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double"))


def parsed_frequency(raw: Column) -> Column:
    """``struct(kind, probability, numerator, denominator)`` of a frequency text.

    In this order: a code as first token, a label anywhere, a percentage anywhere, 'n/m' as a whole, a number
    (above 1 in percent); else 'missing' with the default. Shares are clipped to [0, 1]; n/0 is missing.
    """
    text = F.lower(F.trim(raw))
    code = F.upper(F.regexp_extract(text, r"^(hp:[0-9]{7})", 1))
    by_code = F.lit(None).cast("double")
    for name, value in CODE_VALUES.items():
        by_code = F.when(code == name, F.lit(value)).otherwise(by_code)
    by_label = F.lit(None).cast("double")
    for label, value in reversed(LABEL_VALUES):
        by_label = F.when(text.contains(label), F.lit(value)).otherwise(by_label)
    percent = _number(text, r"([0-9]+(?:[.][0-9]+)?) *%", 1) / 100
    ratio = r"^([0-9]+(?:[.][0-9]+)?) */ *([0-9]+(?:[.][0-9]+)?)$"
    top, whole = _number(text, ratio, 1), _number(text, ratio, 2)
    number = finite(text.try_cast("double"))
    number = F.when(number > 1, number / 100).otherwise(number)

    def made(kind: str, p: Column, n: Column | None = None, m: Column | None = None) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(F.lit(kind).alias("kind"), clip(p, 0.0, 1.0).alias("probability"), (n if n is not None else none).alias("numerator"), (m if m is not None else none).alias("denominator"))

    missing = made("missing", F.lit(DEFAULT_FREQUENCY))
    return (
        F.when(by_code.isNotNull(), made("category", by_code))
        .when(by_label.isNotNull(), made("category", by_label))
        .when(percent.isNotNull(), made("percent", percent))
        .when(whole.isNotNull() & (whole > 0), made("ratio", top / whole, top, whole))
        .when(whole.isNotNull(), missing)
        .when(number.isNotNull() & (number >= 0), made("numeric", number))
        .otherwise(missing)
    )


def with_frequency(annotations: DataFrame) -> DataFrame:
    """``annotations`` with kind, probability, numerator and denominator of ``frequency_raw``."""
    parsed = annotations.withColumn("__f", parsed_frequency(F.col("frequency_raw")))
    return parsed.select(*annotations.columns, F.col("__f.kind").alias("kind"), F.col("__f.probability").alias("probability"), F.col("__f.numerator").alias("numerator"), F.col("__f.denominator").alias("denominator"))


def resolved_frequency(kind: Column, probability: Column, numerator: Column, denominator: Column, background: Column, excluded: Column, policy: str = "NEUTRAL") -> Column:
    """The probability a frequency stands for under a policy for missing ones.

    Excluded: epsilon. Missing: the background (NEUTRAL), 0.5 (CONFIGURABLE_DEFAULT) or null (EXCLUDE). Ratios are
    smoothed to (n + 0.5) / (m + 1). All within [epsilon, 1 - epsilon].
    """
    lacking = {"NEUTRAL": background, "CONFIGURABLE_DEFAULT": F.lit(DEFAULT_FREQUENCY), "EXCLUDE": F.lit(None).cast("double")}[policy]
    value = F.when(excluded, F.lit(EPSILON)).when(kind == "missing", lacking).when(kind == "ratio", (numerator + 0.5) / (denominator + 1.0)).otherwise(probability)
    return F.when(value.isNotNull(), clip(value, EPSILON, 1 - EPSILON))


def phenotypic(annotations: DataFrame) -> DataFrame:
    """``(profile_id, profile_name, term, negated, kind, probability, ...)`` of phenotypic rows, once each.

    Rows of another aspect and rows without a term id are left out; an empty aspect counts as phenotypic.
    ``negated``: a NOT, ABSENT or EXCLUDED qualifier, or a frequency of zero.
    """
    rows = with_frequency(annotations.where("coalesce(aspect, '') in ('', 'P')"))
    named = F.upper(F.coalesce(F.trim("qualifier"), F.lit(""))).isin("NOT", "ABSENT", "EXCLUDED")
    return rows.select(
        F.col("database_id").alias("profile_id"),
        F.col("disease_name").alias("profile_name"),
        normalize_term_id(F.col("hpo_id")).alias("term"),
        (named | (F.col("probability") <= 0)).alias("negated"),
        "kind",
        "probability",
        "numerator",
        "denominator",
    ).where("profile_id is not null and term is not null").distinct()


def inheritance(annotations: DataFrame) -> DataFrame:
    """``(profile_id, terms)``: sorted inheritance terms of each profile, negated ones left out."""
    rows = annotations.where("aspect = 'I' and coalesce(upper(qualifier), '') <> 'NOT'").select(F.col("database_id").alias("profile_id"), normalize_term_id(F.col("hpo_id")).alias("term"))
    return rows.where("term is not null").groupBy("profile_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def negative_terms(rows: DataFrame) -> DataFrame:
    """``(profile_id, term)`` with any negated row."""
    return rows.where("negated").select("profile_id", "term").distinct()


def positive_terms(rows: DataFrame, root: str | None = None) -> DataFrame:
    """``(profile_id, term, freq)``: the largest frequency of each term that no row of the profile negates; without the root."""
    kept = rows.where(F.col("term") != root) if root else rows
    fold = kept.groupBy("profile_id", "term").agg(F.max("negated").alias("any_negated"), F.max("probability").alias("freq"))
    return fold.where("not any_negated").select("profile_id", "term", "freq")


def annotation_for(rows: DataFrame, excluded: bool) -> DataFrame:
    """``(profile_id, term, kind, probability, ...)``: the row that speaks for a term, by frequency, then kind and counts.

    For excluded terms a negated row, else the one with the largest frequency among the others (all if none is left).
    """
    w = Window.partitionBy("profile_id", "term").orderBy(
        (F.col("negated") if not excluded else ~F.col("negated")).asc(), F.col("probability").desc(), F.col("kind"), F.col("numerator").asc_nulls_last(), F.col("denominator").asc_nulls_last(), "profile_name"
    )
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
