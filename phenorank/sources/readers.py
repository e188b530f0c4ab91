"""Readers of the engine's text formats, as distributed scans."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenorank.functions.scalars import normalize_term_id


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """``(hpo_id, name, parents, synonyms, definition, alt_ids, is_obsolete, replaced_by)`` of an OBO file's [Term] stanzas.

    Stanzas are the records of the scan, so a file is read in parallel. Comments after '!' are cut off ids; stanzas
    without a valid id are left out.
    """
    stanza = spark.read.text(path, lineSep="\n\n").select(F.regexp_replace("value", "\r", "").alias("s")).where(F.trim("s").startswith("[Term]"))

    def one(tag: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("s", rf"(?m)^{tag}: *(.*)$", 1)), F.lit(""))

    def many(tag: str, pattern: str) -> Column:
        return F.regexp_extract_all("s", F.lit(rf"(?m)^{tag}: *{pattern}"), F.lit(1))

    return stanza.select(
        normalize_term_id(one("id")).alias("hpo_id"),
        one("name").alias("name"),
        many("is_a", r"(\S+)").alias("parents"),
        many("synonym", '"([^"]*)"').alias("synonyms"),
        F.nullif(F.regexp_extract("s", r'(?m)^def: *"([^"]*)"', 1), F.lit("")).alias("definition"),
        many("alt_id", r"(\S+)").alias("alt_ids"),
        (F.coalesce(one("is_obsolete"), F.lit("")) == "true").alias("is_obsolete"),
        F.regexp_extract("s", r"(?m)^replaced_by: *(\S+)", 1).alias("r"),
    ).select("*", F.nullif("r", F.lit("")).alias("replaced_by")).drop("r").where("hpo_id is not null")


def obo_version(spark: SparkSession, path: str) -> str | None:
    found = spark.read.text(path).where(F.col("value").startswith("data-version:")).select(F.trim(F.substring("value", 14, 200)).alias("v")).take(1)
    return found[0].v if found else None


# The columns of an annotation file without a header, and other names of theirs.
HPOA_COLUMNS = ["database_id", "disease_name", "qualifier", "hpo_id", "reference", "evidence", "onset", "frequency_raw", "sex", "modifier", "aspect", "biocuration"]
HPOA_NAMES = {"databaseid": "database_id", "diseaseid": "database_id", "diseasename": "disease_name", "hpoid": "hpo_id", "frequency": "frequency_raw"}


def hpoa(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Annotation rows with the columns of the project's table, all text.

    A header may start with '#'; without one the standard columns are taken. ``strict`` fails on a row without a valid
    term id, otherwise such rows are left out. Repeated rows are kept.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).where("trim(line) <> ''")
    plain = lambda name: "".join(c for c in name.lower() if c.isalnum())
    head = lines.where(F.regexp_replace(F.lower("line"), "[^a-z0-9\t]", "").rlike(r"^(databaseid|diseaseid)\t.*hpoid")).take(1)
    names = HPOA_COLUMNS
    if head:
        names = [HPOA_NAMES.get(plain(c), next((h for h in HPOA_COLUMNS if plain(h) == plain(c)), plain(c))) for c in head[0].line.lstrip("#").split("\t")]
        lines = lines.where(F.col("line") != head[0].line)
    cells = lines.where(~F.col("line").startswith("#")).select(F.split("line", "\t").alias("c"))
    rows = cells.select(*[F.nullif(F.trim(F.get("c", F.lit(k))), F.lit("")).alias(n) for k, n in enumerate(names)])
    rows = rows.select(*[F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in HPOA_COLUMNS])
    valid = normalize_term_id(F.col("hpo_id"))
    if strict:
        return rows.withColumn("hpo_id", F.when(valid.isNotNull(), valid).otherwise(F.raise_error(F.concat(F.lit("not a term id: "), F.coalesce("hpo_id", F.lit("null"))))))
    return rows.withColumn("hpo_id", valid).where("hpo_id is not null")


def hpoa_version(spark: SparkSession, path: str) -> str | None:
    """What a comment line gives as version, release or date."""
    pattern = r"(?i)^#\s*(?:version|release|date)\s*[:=]\s*(.+)$"
    found = spark.read.text(path).select(F.regexp_extract("value", pattern, 1).alias("v")).where("v <> ''").take(1)
    return found[0].v.strip() if found else None


def gene_associations(spark: SparkSession, path: str) -> DataFrame:
    """``(profile_id, gene, evidence_type, association_id, source)`` of a tab-separated file with a header.

    Needs a disease and a gene column; evidence defaults to curated, the source to the file's kind.
    """
    raw = spark.read.csv(path, sep="\t", header=True)
    by_name = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in raw.columns}

    def pick(*names: str) -> Column | None:
        return next((F.nullif(F.trim(F.col(f"`{by_name[n]}`")), F.lit("")) for n in names if n in by_name), None)

    disease, gene = pick("diseaseid", "disease", "databaseid"), pick("genesymbol", "gene")
    if disease is None or gene is None:
        raise ValueError("a disease and a gene column are needed")
    none = F.lit(None).cast("string")
    evidence, ident, source = pick("evidencetype", "associationtype"), pick("associationid"), pick("source")
    return raw.select(
        disease.alias("profile_id"),
        F.upper(gene).alias("gene"),
        F.coalesce(evidence if evidence is not None else none, F.lit("curated")).alias("evidence_type"),
        (ident if ident is not None else none).alias("association_id"),
        F.coalesce(source if source is not None else none, F.lit("genes_to_disease")).alias("source"),
    ).where("profile_id is not null and gene is not null")


def genes_by_profile(associations: DataFrame) -> DataFrame:
    """``(profile_id, genes)`` as sorted distinct arrays."""
    return associations.groupBy("profile_id").agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """``(profile_id, concept_id)`` of a cross-reference file (concept_id, omim_id, orpha_id); fails where a member is in two concepts."""
    raw = spark.read.csv(path, sep="\t", header=True)
    missing = {"concept_id", "omim_id", "orpha_id"} - set(raw.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    rows = raw.select(F.trim("concept_id").alias("concept_id"), F.explode(F.array_distinct(F.array_compact(F.array("concept_id", "omim_id", "orpha_id")))).alias("m")).select("concept_id", F.trim("m").alias("profile_id"))
    rows = rows.where("concept_id <> '' and profile_id <> ''").distinct()
    double = rows.groupBy("profile_id").agg(F.count_distinct("concept_id").alias("n")).where("n > 1").take(1)
    if double:
        raise ValueError(f"{double[0].profile_id} belongs to several concepts")
    return rows.select("profile_id", "concept_id")


def catalog_csv(spark: SparkSession, path: str, include_obsolete: bool = False) -> DataFrame:
    """``(hpo_id, name)`` of a CSV catalogue whose header names an id and a name column; bad ids are left out, the first name in order stays."""
    raw = spark.read.csv(path, header=True)
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in raw.columns}
    id_ = next((plain[n] for n in ("hpoid", "mahpo", "id") if n in plain), None)
    name = next((plain[n] for n in ("name", "hponame", "label", "tenhpo") if n in plain), None)
    if id_ is None or name is None:
        raise ValueError("an id and a name column are needed")
    rows = raw.select(normalize_term_id(F.col(f"`{id_}`")).alias("hpo_id"), F.trim(F.col(f"`{name}`")).alias("name"), F.monotonically_increasing_id().alias("at")).where("hpo_id is not null and name is not null")
    if not include_obsolete:
        rows = rows.where(~F.lower("name").startswith("obsolete"))
    return rows.groupBy("hpo_id").agg(F.min_by("name", "at").alias("name"))


def lexicon_csv(spark: SparkSession, path: str, allow_unreviewed: bool = False) -> DataFrame:
    """``(hpo_id, phrase)`` of a lexicon; refused as a whole where a row isn't approved, unless allowed."""
    raw = spark.read.csv(path, header=True)
    need = {"hpo_id", "root_phrase_vi", "synonyms_vi"}
    if need - set(raw.columns):
        raise ValueError(f"columns missing: {sorted(need - set(raw.columns))}")
    if not allow_unreviewed:
        status = F.coalesce(F.lower(F.trim("review_status")), F.lit("")) if "review_status" in raw.columns else F.lit("")
        if raw.where(status != "approved").take(1):
            raise ValueError("the lexicon holds rows that aren't approved")
    phrases = F.concat(F.array("root_phrase_vi"), F.split(F.coalesce("synonyms_vi", F.lit("")), r"\|"))
    rows = raw.select(normalize_term_id(F.col("hpo_id")).alias("hpo_id"), F.explode(phrases).alias("phrase")).select("hpo_id", F.trim("phrase").alias("phrase"))
    return rows.where("hpo_id is not null and phrase <> ''").distinct()


def json_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``(id, vi, en, aliases, synonyms)`` of a JSON array of objects."""
    schema = "id string, vi string, en string, aliases string, synonyms string"
    return spark.read.schema(schema).json(path, multiLine=True)


def strict_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: lines that are one JSON object without repeated keys and without NaN or Infinity, and the others with the reason.

    Blank lines are neither. ``good`` has the line as ``value``.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(items: list) -> dict:
            out = dict(items)
            if len(out) != len(items):
                raise ValueError("repeated key")
            return out

        def refuse(name: str) -> None:
            raise ValueError(f"{name} is no JSON number")

        for pdf in batches:
            reasons = []
            for value in pdf["value"]:
                try:
                    parsed = json.loads(value, object_pairs_hook=pairs, parse_constant=refuse)
                    reasons.append(None if isinstance(parsed, dict) else "not an object")
                except ValueError as error:
                    reasons.append(str(error).split(":")[0])
            yield pdf.assign(reason=reasons)

    judged = lines.mapInPandas(judge, "value string, reason string")
    return judged.where("reason is null").select("value"), judged.where("reason is not null")
