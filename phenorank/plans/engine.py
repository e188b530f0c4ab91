"""Queries of the ranking engine, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenorank.functions import scalars
from phenorank.operators import annotations, downstream, hierarchy, observations, ontology, probability, ranking
from phenorank.plans import base
from phenorank.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL counterpart."""
    return base.registered(QUERIES, SQL, sql)


six = base.six


@query(base.ONTOLOGY + "SELECT term, anc, dist FROM closed")
def ontology_closure(spark, d):
    return base.closed(spark, d)


@query(
    base.ONTOLOGY
    + """, looped AS (SELECT DISTINCT node FROM reach WHERE anc IN (SELECT node FROM reach WHERE node = anc) OR node IN (SELECT node FROM reach WHERE node = anc)),
good AS (SELECT hpo_id FROM nodes WHERE hpo_id NOT IN (SELECT node FROM looped)),
walk(node, depth) AS (
  SELECT hpo_id, 0 FROM good WHERE hpo_id NOT IN (SELECT child FROM links)
  UNION SELECT l.child, w.depth + 1 FROM walk w JOIN links l ON l.parent = w.node WHERE l.child IN (SELECT hpo_id FROM good)
)
SELECT node AS hpo_id, max(depth) AS depth FROM walk GROUP BY node"""
)
def ontology_depth(spark, d):
    return ontology.longest_depth(base.nodes(spark, d), base.links(spark, d))


@query(
    base.ONTOLOGY
    + """, said AS (SELECT DISTINCT upper(trim(unnest(parents))) AS id FROM hpo_term),
known(id, target) AS (SELECT id, id FROM said WHERE id IS NOT NULL AND id <> '' UNION SELECT k.id, a.b FROM known k JOIN alias a ON a.a = k.target)
SELECT id, max(target) AS resolved FROM known WHERE target IS NULL OR target NOT IN (SELECT a FROM alias) GROUP BY id"""
)
def alias_resolution(spark, d):
    """What each id named as a parent means: itself, its term, its replacement, or null."""
    terms = table(spark, d, "hpo_term")
    state = terms.select(F.upper(F.trim("hpo_id")).alias("id"), F.coalesce("is_obsolete", F.lit(False)).alias("gone"), F.upper(F.trim("replaced_by")).alias("r"), "alt_ids")
    per = state.groupBy("id").agg(F.max("gone").alias("gone"), F.min("r").alias("r"))
    alt = state.select("id", F.explode("alt_ids").alias("a")).select(F.upper(F.trim("a")).alias("node"), F.col("id").alias("ptr"))
    alt = alt.join(per.select(F.col("id").alias("node")), "node", "left_anti").groupBy("node").agg(F.min("ptr").alias("ptr"))
    alias = hierarchy.follow_pointers(per.where("gone").select(F.col("id").alias("node"), F.col("r").alias("ptr")).unionByName(alt))
    said = terms.select(F.explode("parents").alias("p")).select(F.upper(F.trim("p")).alias("id")).where("id <> ''").distinct()
    return ontology.resolve_ids(said, alias)


@query(
    "WITH "
    + base.FREQUENCY
    + "SELECT annotation_id, kind, round(probability, 6) AS probability, numerator, denominator, count(*) AS n FROM frequency GROUP BY ALL"
)
def frequency_parse(spark, d):
    rows = annotations.with_frequency(table(spark, d, "hpoa_annotation").select("annotation_id", "frequency_raw"))
    return rows.groupBy("annotation_id", "kind", F.round("probability", 6).alias("probability"), "numerator", "denominator").agg(F.count("*").alias("n"))


@query(
    base.ONTOLOGY
    + ","
    + base.PROFILES
    + base.STATS
    + """SELECT a.profile_id, a.term, a.kind, a.probability AS stated, round(max(CASE WHEN negated THEN 0.0001 WHEN kind = 'missing' THEN least(0.9999, greatest(0.0001, background))
  WHEN kind = 'ratio' THEN least(0.9999, greatest(0.0001, (numerator + 0.5) / (denominator + 1))) ELSE least(0.9999, greatest(0.0001, probability)) END), 6) AS resolved
FROM annot a JOIN stats s ON s.term = a.term GROUP BY ALL"""
)
def frequency_policy(spark, d):
    rows = base.profile_rows(spark, d).join(base.stats(spark, d).select("term", "background"), "term")
    value = annotations.resolved_frequency(F.col("kind"), F.col("probability"), F.col("numerator"), F.col("denominator"), F.col("background"), F.col("negated"))
    return rows.groupBy("profile_id", "term", "kind", F.col("probability").alias("stated")).agg(F.round(F.max(value), 6).alias("resolved"))


@query("WITH " + base.PROFILES + "SELECT profile_id, term, round(freq, 6) AS freq FROM pos")
def profile_fold_positive(spark, d):
    return base.positive(spark, d).select("profile_id", "term", *six("freq"))


@query("WITH " + base.PROFILES + "SELECT profile_id, term FROM neg")
def profile_fold_negative(spark, d):
    return base.negative(spark, d)


@query(
    "SELECT database_id AS profile_id, string_agg(DISTINCT upper(trim(hpo_id)), ',' ORDER BY upper(trim(hpo_id))) AS terms FROM hpoa_annotation WHERE aspect = 'I' AND coalesce(upper(qualifier), '') <> 'NOT' AND hpo_id IS NOT NULL GROUP BY 1"
)
def profile_inheritance(spark, d):
    return annotations.inheritance(table(spark, d, "hpoa_annotation")).select("profile_id", F.array_join("terms", ",").alias("terms"))


@query(base.ONTOLOGY + "," + base.PROFILES + base.STATS + "SELECT term, df FROM df")
def document_frequency(spark, d):
    return ontology.document_frequency(base.positive(spark, d), base.closed(spark, d))


@query(base.ONTOLOGY + "," + base.PROFILES + base.STATS + "SELECT term, df, round(background, 6) AS background, round(ic, 6) AS ic FROM stats")
def information_content(spark, d):
    return base.stats(spark, d).select("term", "df", *six("background", "ic"))


@query(base.ONTOLOGY + "," + base.PROFILES + base.STATS + "SELECT term, round(-ln((df + 1.0) / (n + 1.0)), 6) AS ic FROM stats CROSS JOIN n_profiles")
def ic_alt_smoothing(spark, d):
    df = ontology.document_frequency(base.positive(spark, d), base.closed(spark, d))
    return ontology.smoothed_ic(base.nodes(spark, d).withColumnRenamed("hpo_id", "term"), df, base.profile_ids(spark, d).count()).select("term", *six("ic"))


@query(base.ONTOLOGY + "," + base.PROFILES + base.STATS + base.OBSERVATIONS + base.SIMILARITY + "SELECT q, t, relation, dist, round(sim, 6) AS sim, round(strength, 6) AS strength FROM similarity")
def term_similarity(spark, d):
    return base.similarity(spark, d).select("q", "t", "relation", "dist", *six("sim", "strength"))


@query(
    base.ONTOLOGY
    + ","
    + base.PROFILES
    + base.STATS
    + """, pairs AS (SELECT DISTINCT a.term AS a, b.term AS b FROM annot a JOIN annot b ON a.profile_id = b.profile_id AND a.term < b.term),
common AS (SELECT p.a, p.b, ca.anc, s.ic FROM pairs p JOIN closed ca ON ca.term = p.a JOIN closed cb ON cb.term = p.b AND cb.anc = ca.anc JOIN stats s ON s.term = ca.anc)
SELECT a, b, (max(struct_pack(ic := ic, anc := anc))).anc AS mica, round(max(ic), 6) AS ic FROM common GROUP BY a, b"""
)
def mica_of_profile_terms(spark, d):
    """For each two terms of a profile, their most informative common ancestor."""
    return ontology.mica_within(base.profile_rows(spark, d), "profile_id", base.closed(spark, d), base.stats(spark, d)).select("a", "b", "mica", *six("ic"))


@query(base.ONTOLOGY + base.OBSERVATIONS + "SELECT case_id, ord, term, status, round(w, 9) AS w FROM clean")
def observation_sanitise(spark, d):
    return base.case_observations(spark, d).select("case_id", "ord", "term", "status", F.round("w", 9).alias("w"))


@query(
    base.ONTOLOGY
    + base.REPORTS
    + """, bad AS (
  SELECT case_id, ord, unnest([CASE WHEN term IS NULL THEN 'no term id' END, CASE WHEN status IS NULL THEN 'unknown status' END,
    CASE WHEN extraction_confidence NOT BETWEEN 0 AND 1 THEN 'extraction_confidence outside 0 to 1' END, CASE WHEN linking_confidence NOT BETWEEN 0 AND 1 THEN 'linking_confidence outside 0 to 1' END,
    CASE WHEN assertion_certainty NOT BETWEEN 0 AND 1 THEN 'assertion_certainty outside 0 to 1' END, CASE WHEN gestational_age_weeks NOT BETWEEN 0 AND 45 THEN 'gestational age outside 0 to 45' END]) AS problem FROM obs)
SELECT DISTINCT * FROM bad WHERE problem IS NOT NULL"""
)
def observation_problems(spark, d):
    """What is wrong with the mentions, each report being a case (the calibration cases have no faulty observation)."""
    return observations.problems(base.report_observations(spark, d)).distinct()


@query(base.ONTOLOGY + base.REPORTS + " SELECT case_id, absent_term, present_term FROM clash")
def contradiction_check(spark, d):
    """Terms that a report both finds and excludes, itself or above what it finds."""
    known = base.nodes(spark, d).where(F.col("hpo_id") != base.ROOT).withColumnRenamed("hpo_id", "term")
    return observations.contradictions(observations.merged(base.report_observations(spark, d).join(known, "term", "left_semi")), base.closed(spark, d))


@query(base.ONTOLOGY + base.OBSERVATIONS + "SELECT case_id, term, status, conflict, mention_count FROM merged")
def observation_merge(spark, d):
    known = base.nodes(spark, d).withColumnRenamed("hpo_id", "term")
    return observations.merged(base.raw_observations(spark, d).join(known, "term", "left_semi")).select("case_id", "term", "status", "conflict", "mention_count")


@query(
    base.ONTOLOGY
    + ","
    + base.PROFILES
    + base.STATS
    + base.OBSERVATIONS
    + """SELECT o.case_id, CASE WHEN sum((s.term IS NULL)::INT) > 0 THEN 'UNKNOWN_TERM_ID' WHEN o.case_id IN (SELECT case_id FROM clash) THEN 'UNRESOLVED_CONTRADICTION'
  WHEN sum((s.term IS NOT NULL AND status IS NOT NULL)::INT) = 0 THEN 'NO_VALID_OBSERVATION' WHEN sum((s.term IS NOT NULL AND status <> 'NOT_ASSESSED')::INT) = 0 THEN 'ALL_NOT_ASSESSED'
  WHEN sum((s.term IS NOT NULL AND status IN ('PRESENT', 'SUSPECTED'))::INT) = 0 THEN 'NO_POSITIVE_OBSERVATION'
  WHEN max(CASE WHEN status IN ('PRESENT', 'SUSPECTED') THEN ic END) < 0.05 THEN 'ONLY_VERY_GENERAL_TERMS' END AS reason
FROM obs o LEFT JOIN stats s ON s.term = o.term GROUP BY o.case_id"""
)
def abstention_reason(spark, d):
    return observations.abstentions(base.raw_observations(spark, d), base.closed(spark, d), base.stats(spark, d))


@query(
    base.ALL
    + base.EVIDENCE
    + "SELECT case_id, ord, profile_id, relation, matched_term, distance, round(sim, 6) AS sim, round(probability, 6) AS probability, round(llr, 6) + 0.0 AS llr, round(w * llr, 6) + 0.0 AS contribution FROM evidence"
)
def evidence_rows(spark, d):
    """What speaks for and against the ten first profiles of each case."""
    return base.evidence(spark, d).select("case_id", "ord", "profile_id", "relation", "matched_term", "distance", *six("sim", "probability", "llr", "contribution"))


_RANK = "SELECT case_id, profile_id, rank, round(ic_coverage, 6) AS ic_coverage, round(exact, 6) AS exact, round(ancestor, 6) AS ancestor, round(conflict, 6) AS conflict, round(score, 6) + 0.0 AS score, round(compatibility, 6) AS compatibility FROM {0} WHERE rank <= 10"
_SHOWN = ["ic_coverage", "exact", "ancestor", "conflict", "score", "compatibility"]


@query(base.ALL + _RANK.format("ranked"))
def rank_ic_coverage(spark, d):
    return base.top(spark, d).select("case_id", "profile_id", "rank", *six(*_SHOWN))


@query(base.ALL + ", lik AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY case_id ORDER BY round(score, 10) DESC, profile_id DESC) AS rank FROM ranked)" + _RANK.format("lik"))
def rank_likelihood(spark, d):
    return ranking.top_profiles(*base.engine(spark, d), strategy="LIKELIHOOD_SCORE").select("case_id", "profile_id", "rank", *six(*_SHOWN))


@query(
    base.ALL
    + """, sub AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY case_id ORDER BY round(ic_coverage, 10) DESC, round(exact, 10) DESC, round(score, 10) DESC, profile_id DESC) AS rank
  FROM ranked WHERE profile_id IN (SELECT DISTINCT database_id FROM hpoa_annotation WHERE aspect = 'I'))"""
    + _RANK.format("sub")
)
def rank_subset(spark, d):
    """Ranked among the profiles with an inheritance annotation."""
    subset = table(spark, d, "hpoa_annotation").where("aspect = 'I'").select(F.col("database_id").alias("profile_id")).distinct()
    obs, known, by_term, by_profile, *rest = base.engine(spark, d)
    return ranking.top_profiles(obs, known, by_term, by_profile.join(subset, "profile_id", "left_semi"), *rest).select("case_id", "profile_id", "rank", *six(*_SHOWN))


@query(
    base.ALL
    + """, named_profiles AS (SELECT database_id AS profile_id, min(disease_name) AS concept_id FROM hpoa_annotation GROUP BY 1),
con AS (SELECT r.* EXCLUDE (rank), coalesce(n.concept_id, r.profile_id) AS concept_id FROM ranked r LEFT JOIN named_profiles n ON n.profile_id = r.profile_id),
win AS (SELECT *, row_number() OVER (PARTITION BY case_id, concept_id ORDER BY round(ic_coverage, 10) DESC, round(exact, 10) DESC, round(score, 10) DESC, profile_id DESC) AS n,
  string_agg(profile_id, ',' ORDER BY profile_id) OVER (PARTITION BY case_id, concept_id ORDER BY profile_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS members FROM con),
fin AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(ic_coverage, 10) DESC, round(exact, 10) DESC, round(score, 10) DESC, profile_id DESC) AS rank FROM win WHERE n = 1)
SELECT case_id, concept_id, profile_id, members, rank FROM fin WHERE rank <= 10"""
)
def rank_concept_merged(spark, d):
    """Profiles of one disease name are one concept."""
    concepts = table(spark, d, "hpoa_annotation").groupBy(F.col("database_id").alias("profile_id")).agg(F.min("disease_name").alias("concept_id"))
    named = base.profile_ids(spark, d).join(concepts, "profile_id", "left").select("profile_id", F.coalesce("concept_id", "profile_id").alias("concept_id"))
    members = named.groupBy("concept_id").agg(F.array_join(F.array_sort(F.collect_set("profile_id")), ",").alias("members"))
    return ranking.top_profiles(*base.engine(spark, d), concepts=named).join(members, "concept_id").select("case_id", "concept_id", "profile_id", "members", "rank")


_TOPS = "tops AS (SELECT c.term, min(c.anc) AS group_id FROM closed c WHERE c.anc IN (SELECT child FROM links WHERE parent = 'HP:0000118') GROUP BY c.term)"
_GROUPS = (
    base.EVIDENCE
    + f", {_TOPS},"
    + """
  bounded AS (SELECT e.*, g.group_id, least(5, greatest(-5, CASE WHEN e.status = 'ABSENT' THEN ln(1 - probability) - ln(1 - background) ELSE ln(probability) - ln(background) END)) AS cap
    FROM evidence e LEFT JOIN tops g ON g.term = e.term),
  grouped AS (SELECT case_id, profile_id, group_id, sum(w * cap) AS total FROM bounded GROUP BY ALL),
  capped AS (SELECT case_id, profile_id, sum(CASE WHEN group_id IS NULL THEN total ELSE least(8, greatest(-8, total)) END) AS llr,
    sum((group_id IS NOT NULL AND abs(total) > 8)::INT) AS capped_groups FROM grouped GROUP BY ALL)
"""
)


@query(base.ONTOLOGY + f", {_TOPS} SELECT term, group_id FROM tops")
def organ_group(spark, d):
    """The direct child of the root that each term belongs to."""
    return ontology.organ_group(base.closed(spark, d), base.links(spark, d), base.ROOT)


def _capped(spark: SparkSession, d: str) -> DataFrame:
    groups = ontology.organ_group(base.closed(spark, d), base.links(spark, d), base.ROOT)
    e = base.evidence(spark, d).join(groups, "term", "left")
    cap = probability.bounded_llr(F.col("probability"), F.col("background"), F.col("status") == "ABSENT")
    return probability.group_capped(e.withColumn("contribution", F.col("w") * cap), ["case_id", "profile_id"])


@query(base.ALL + _GROUPS + "SELECT case_id, profile_id, round(llr, 6) + 0.0 AS llr, capped_groups FROM capped")
def group_capped_llr(spark, d):
    return _capped(spark, d).select("case_id", "profile_id", *six("llr"), "capped_groups")


_PRIORS = """, golds AS (SELECT DISTINCT case_id, upper(trim(unnest(gold_disease_ids))) AS profile_id, cohort_id FROM calibration_case),
sizes AS (SELECT count(DISTINCT case_id) AS n FROM calibration_case), cohort_sizes AS (SELECT cohort_id, count(DISTINCT case_id) AS n FROM calibration_case GROUP BY 1),
general AS (SELECT profile_id, least(0.9999, count(DISTINCT case_id) / (SELECT n + 1.0 FROM sizes)) AS p FROM golds GROUP BY 1),
by_cohort AS (SELECT g.profile_id, g.cohort_id, least(0.9999, count(DISTINCT case_id) / (c.n + 1.0)) AS p FROM golds g JOIN cohort_sizes c ON c.cohort_id = g.cohort_id GROUP BY g.profile_id, g.cohort_id, c.n),
case_cohort AS (SELECT case_id, min(cohort_id) AS cohort_id FROM calibration_case GROUP BY 1),
cand AS (SELECT r.case_id, r.profile_id, r.rank, c.llr, coalesce(b.p, g.p) AS prior FROM ranked r JOIN capped c ON c.case_id = r.case_id AND c.profile_id = r.profile_id
  JOIN case_cohort k ON k.case_id = r.case_id LEFT JOIN by_cohort b ON b.profile_id = r.profile_id AND b.cohort_id = k.cohort_id LEFT JOIN general g ON g.profile_id = r.profile_id WHERE r.rank <= 10)
"""


def _priors(spark: SparkSession, d: str) -> DataFrame:
    """Prior of a profile: its share of cases with it as gold, in the cohort and in general."""
    cases = table(spark, d, "calibration_case")
    golds = cases.select("case_id", "cohort_id", F.explode("gold_disease_ids").alias("g")).select("case_id", "cohort_id", F.upper(F.trim("g")).alias("profile_id")).distinct()
    n = cases.select("case_id").distinct().count()
    least = lambda x: F.least(F.lit(0.9999), x)
    general = golds.groupBy("profile_id").agg(least(F.count_distinct("case_id") / (n + 1.0)).alias("p")).select("profile_id", F.lit(None).cast("string").alias("cohort_id"), F.lit(None).cast("string").alias("sex"), "p")
    sizes = cases.groupBy("cohort_id").agg(F.count_distinct("case_id").alias("n"))
    cohort = golds.join(sizes, "cohort_id").groupBy("profile_id", "cohort_id", "n").agg(F.count_distinct("case_id").alias("k"))
    cohort = cohort.select("profile_id", "cohort_id", F.lit(None).cast("string").alias("sex"), least(F.col("k") / (F.col("n") + 1.0)).alias("p"))
    return general.unionByName(cohort)


def _with_prior(spark: SparkSession, d: str) -> DataFrame:
    cohort = table(spark, d, "calibration_case").groupBy("case_id").agg(F.min("cohort_id").alias("cohort_id")).withColumn("sex", F.lit(None).cast("string"))
    top = base.top(spark, d).select("case_id", "profile_id", "rank").join(_capped(spark, d), ["case_id", "profile_id"]).join(cohort, "case_id")
    return probability.prior_for(top, _priors(spark, d)).select("case_id", "profile_id", "rank", "llr", "prior")


_POST = "CASE WHEN prior IS NOT NULL THEN least(1 - 1e-6, greatest(1e-6, 1 / (1 + exp(-(ln(prior) - ln(1 - prior) + llr))))) END"


@query(base.ALL + _GROUPS + _PRIORS + f"SELECT case_id, profile_id, rank, round(prior, 6) AS prior, round({_POST}, 6) AS posterior FROM cand")
def binary_posterior(spark, d):
    rows = _with_prior(spark, d)
    return rows.withColumn("posterior", probability.binary_posterior(F.col("prior"), F.col("llr"))).select("case_id", "profile_id", "rank", *six("prior", "posterior"))


@query(
    base.ALL
    + _GROUPS
    + _PRIORS
    + """, pool AS (SELECT case_id, profile_id, prior, llr FROM cand WHERE prior IS NOT NULL
  UNION ALL SELECT case_id, 'OTHER_OR_UNKNOWN', least(0.95, greatest(0.05, 1 - sum(prior))), 0 FROM cand WHERE prior IS NOT NULL GROUP BY case_id),
weights AS (SELECT *, exp(ln(prior) + llr - max(ln(prior) + llr) OVER (PARTITION BY case_id)) AS e FROM pool)
SELECT case_id, profile_id, round(prior, 6) AS prior, round(e / sum(e) OVER (PARTITION BY case_id), 6) AS posterior FROM weights"""
)
def single_cause_softmax(spark, d):
    return probability.single_cause(_with_prior(spark, d)).select("case_id", "profile_id", *six("prior", "posterior"))


_ASSOC = """, assoc AS (
  SELECT DISTINCT database_id AS profile_id, reference AS association_id, split_part(database_id, ':', 1) AS source, nullif(regexp_extract(biocuration, ':([a-z]+)', 1), '') AS gene,
    CASE evidence WHEN 'PCS' THEN 'curated' WHEN 'TAS' THEN 'strong' WHEN 'IEA' THEN 'limited' ELSE 'candidate' END AS evidence_type,
    CASE WHEN onset IS NULL THEN 'sequencing' ELSE 'array' END AS test_evidence_type FROM hpoa_annotation),
judged_assoc AS (
  SELECT a.*, r.case_id, r.rank, CASE evidence_type WHEN 'curated' THEN 0.9 WHEN 'strong' THEN 0.8 WHEN 'limited' THEN 0.35 WHEN 'candidate' THEN 0.2 ELSE 0.1 END AS weight,
    row_number() OVER (PARTITION BY r.case_id, a.profile_id, gene, evidence_type, association_id, source ORDER BY test_evidence_type) AS n
  FROM assoc a LEFT JOIN ranked r ON r.profile_id = a.profile_id AND r.rank <= 20),
reasons AS (SELECT *, CASE WHEN rank IS NULL THEN 'profile_not_ranked' WHEN coalesce(gene, '') = '' THEN 'no_gene' WHEN n > 1 THEN 'duplicate' WHEN rank > 10 THEN 'rank_beyond_gate'
  WHEN weight < 0.35 THEN 'weight_below_gate' END AS reason FROM judged_assoc),
genes AS (SELECT case_id, gene, sum(weight / rank) AS score, count(*) AS explanations FROM reasons WHERE reason IS NULL GROUP BY ALL HAVING sum(weight / rank) >= 0.05),
gene_ranks AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 10) DESC, explanations DESC, gene) AS rank FROM genes)
"""


def _associations(spark: SparkSession, d: str) -> DataFrame:
    """Associations stand-in: a curator's name is the gene, the evidence code its kind."""
    a = table(spark, d, "hpoa_annotation").select(
        F.col("database_id").alias("profile_id"),
        F.col("reference").alias("association_id"),
        F.split_part("database_id", F.lit(":"), F.lit(1)).alias("source"),
        F.nullif(F.regexp_extract("biocuration", ":([a-z]+)", 1), F.lit("")).alias("gene"),
        F.expr("case evidence when 'PCS' then 'curated' when 'TAS' then 'strong' when 'IEA' then 'limited' else 'candidate' end").alias("evidence_type"),
        F.expr("case when onset is null then 'sequencing' else 'array' end").alias("test_evidence_type"),
    )
    return a.distinct()


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return downstream.judged_associations(_associations(spark, d), base.top(spark, d, 20).select("case_id", "profile_id", "rank"))


def _explained(spark: SparkSession, d: str) -> DataFrame:
    return downstream.explained(_associations(spark, d), base.top(spark, d, 20).select("case_id", "profile_id", "rank"))


@query(base.ALL + _ASSOC + "SELECT case_id, gene, round(score, 6) + 0.0 AS score, explanations, rank FROM gene_ranks WHERE rank <= 20")
def gene_ranking(spark, d):
    return downstream.gene_ranking(_explained(spark, d)).select("case_id", "gene", *six("score"), "explanations", "rank")


@query(base.ALL + _ASSOC + "SELECT reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY reason")
def gene_exclusion_reasons(spark, d):
    return downstream.exclusion_reasons(_judged(spark, d))


@query(
    base.ALL
    + _ASSOC
    + """SELECT r.case_id, CASE test_evidence_type WHEN 'sequencing' THEN 'exome' ELSE 'microarray' END AS test, string_agg(DISTINCT r.gene, ',' ORDER BY r.gene) AS basis
FROM reasons r JOIN gene_ranks g ON g.case_id = r.case_id AND g.gene = r.gene AND g.rank <= 20 WHERE reason IS NULL AND weight >= 0.6 GROUP BY 1, 2"""
)
def test_considerations(spark, d):
    judged = _explained(spark, d)
    rules = spark.createDataFrame([("sequencing", "exome"), ("array", "microarray")], "test_evidence_type string, test string")
    return downstream.test_considerations(judged, downstream.gene_ranking(judged), rules)


@query(
    """WITH v AS (SELECT event_id AS variant_id, 'G' || (user_id % 97) AS gene, value / 100 AS score, CASE WHEN event_type = 'error' THEN 'LowQual' ELSE 'PASS' END AS f FROM events),
g AS (SELECT DISTINCT gene, row_number() OVER (ORDER BY n DESC, gene) AS rank FROM (SELECT gene, count(*) AS n FROM v GROUP BY 1)),
kept AS (SELECT v.variant_id, v.gene, 0.5 * score + 0.5 / g.rank AS combined FROM v JOIN g ON g.gene = v.gene WHERE f = 'PASS' AND score BETWEEN 0 AND 1)
SELECT variant_id, gene, round(combined, 9) AS combined, row_number() OVER (ORDER BY round(combined, 10) DESC, variant_id) AS rank FROM kept"""
)
def variant_ranking(spark, d):
    """Events stand in for variants: the user is the gene, the value the score, errors fail the filter."""
    v = table(spark, d, "events").select(
        F.col("event_id").alias("variant_id"),
        F.concat(F.lit("G"), F.col("user_id") % 97).alias("gene"),
        (F.col("value") / 100).alias("score"),
        F.when(F.col("event_type") == "error", "LowQual").otherwise("PASS").alias("filter"),
    )
    genes = downstream.with_place(v.groupBy("gene").count(), F.col("count").desc(), F.col("gene"))
    return downstream.variant_ranking(v, genes).select("variant_id", "gene", F.round("combined", 9).alias("combined"), "rank")


@query(
    base.ALL
    + """, top AS (SELECT case_id, profile_id, rank FROM ranked WHERE rank <= 10),
lacking AS (SELECT t.case_id, t.profile_id, t.rank, p.term, p.freq FROM top t JOIN pos p ON p.profile_id = t.profile_id WHERE (t.case_id, p.term) NOT IN (SELECT (case_id, term) FROM clean)),
listed AS (SELECT *, row_number() OVER (PARTITION BY case_id, profile_id ORDER BY freq DESC, term) AS pos FROM lacking)
SELECT case_id, profile_id, term, round(freq, 6) AS freq, pos FROM listed WHERE pos <= 25"""
)
def features_to_check(spark, d):
    top = base.top(spark, d)
    return downstream.features_to_check(top, base.positive(spark, d), base.case_observations(spark, d)).select("case_id", "profile_id", "term", *six("freq"), "pos")


@query(
    base.ALL
    + """, top AS (SELECT case_id, profile_id, rank FROM ranked WHERE rank <= 10),
lacking AS (SELECT t.case_id, t.profile_id, t.rank, p.term, p.freq FROM top t JOIN pos p ON p.profile_id = t.profile_id WHERE (t.case_id, p.term) NOT IN (SELECT (case_id, term) FROM clean)),
listed AS (SELECT *, row_number() OVER (PARTITION BY case_id, profile_id ORDER BY freq DESC, term) AS pos FROM lacking),
seen AS (SELECT *, row_number() OVER (PARTITION BY case_id, term ORDER BY rank, pos) AS n FROM listed WHERE pos <= 25)
SELECT case_id, term, rank, pos FROM seen WHERE n = 1"""
)
def phenotypes_to_collect(spark, d):
    top = base.top(spark, d)
    return downstream.phenotypes_to_collect(downstream.features_to_check(top, base.positive(spark, d), base.case_observations(spark, d)), top)


@query(
    base.ONTOLOGY
    + base.OBSERVATIONS
    + f", {_TOPS},"
    + """
f AS (SELECT o.case_id, o.term, g.group_id FROM clean o LEFT JOIN tops g ON g.term = o.term WHERE status IN ('PRESENT', 'SUSPECTED'))
SELECT case_id, coalesce(string_agg(DISTINCT group_id, ' + ' ORDER BY group_id), '') AS organs, count(DISTINCT group_id) AS n_organs, count(DISTINCT term) AS n_terms,
  count(DISTINCT group_id) >= 2 OR count(DISTINCT term) >= 3 AS multiple FROM f GROUP BY case_id"""
)
def pattern_synthesis(spark, d):
    return downstream.pattern(base.case_observations(spark, d), ontology.organ_group(base.closed(spark, d), base.links(spark, d), base.ROOT))


@query(
    base.ALL
    + """, bonus AS (SELECT database_id AS profile_id, CASE WHEN contains(min(disease_name), 'dysplasia') THEN 1.5 ELSE 1.0 END * CASE WHEN contains(min(disease_name), 'complex') THEN 0.1 ELSE 1.0 END AS b FROM hpoa_annotation GROUP BY 1),
fin AS (SELECT r.case_id, r.profile_id, r.rank, round(score * b + 5 * ic_coverage * b, 2) AS final FROM ranked r JOIN bonus USING (profile_id) WHERE rank <= 20),
new AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY final DESC, rank) AS new_rank FROM fin)
SELECT case_id, profile_id, rank, new_rank FROM new WHERE new_rank <= 5"""
)
def disease_rerank(spark, d):
    """Reranked by a factor per word of the name, as a stand-in for rule tables."""
    names = table(spark, d, "hpoa_annotation").groupBy(F.col("database_id").alias("profile_id")).agg(F.min("disease_name").alias("name"))
    top = base.top(spark, d, 20)
    rules = F.explode(F.array_compact(F.array(F.when(F.col("name").contains("dysplasia"), F.lit(1.5)), F.when(F.col("name").contains("complex"), F.lit(0.1)))))
    bonus = top.join(names, "profile_id").select("case_id", "profile_id", rules.alias("factor"))
    return downstream.reranked(top, bonus).select("case_id", "profile_id", "rank", "new_rank")


@query("SELECT DISTINCT case_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT case_id, ('0x' || substr(sha256(case_id), 1, 8))::BIGINT % 100 AS b FROM calibration_case WHERE case_id IS NOT NULL)")
def hash_split(spark, d):
    return table(spark, d, "calibration_case").where("case_id is not null").select("case_id", scalars.hash_split(F.col("case_id")).alias("split")).distinct()


@query(
    base.ALL
    + ", firsts AS (SELECT case_id, profile_id FROM ranked WHERE rank <= 20)"
    + base.evidence_sql("evidence", "firsts")
    + """, matched AS (
  SELECT case_id, profile_id, ord, matched_term, relation, term FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, profile_id, matched_term ORDER BY ord) AS n FROM evidence WHERE status <> 'ABSENT' AND relation IN ('exact', 'profile_ancestor', 'profile_descendant', 'semantic'))
  WHERE n = 1),
m AS (SELECT case_id, profile_id, string_agg(matched_term || ' ' || relation || ' ' || term, ', ' ORDER BY ord, matched_term) AS matched FROM matched GROUP BY ALL),
lacking AS (SELECT f.case_id, f.profile_id, string_agg(p.term, ', ' ORDER BY round(p.freq, 10) DESC, p.term) AS to_check FROM firsts f JOIN pos p ON p.profile_id = f.profile_id
  WHERE (f.case_id, p.term) NOT IN (SELECT (case_id, term) FROM clean) AND (f.case_id, f.profile_id, p.term) NOT IN (SELECT (case_id, profile_id, matched_term) FROM matched) GROUP BY ALL),
names AS (SELECT database_id AS profile_id, min(disease_name) AS name, string_agg(DISTINCT nullif(regexp_extract(biocuration, ':([a-z]+)', 1), ''), ', ' ORDER BY nullif(regexp_extract(biocuration, ':([a-z]+)', 1), '')) AS genes FROM hpoa_annotation GROUP BY 1),
modes AS (SELECT database_id AS profile_id, string_agg(DISTINCT upper(trim(hpo_id)), ', ' ORDER BY upper(trim(hpo_id))) AS modes FROM hpoa_annotation WHERE aspect = 'I' AND coalesce(upper(qualifier), '') <> 'NOT' AND hpo_id IS NOT NULL GROUP BY 1)
SELECT r.case_id, r.rank, r.profile_id, n.name, round(least(1, greatest(0, r.ic_coverage)) * 100, 1) AS match_percentage, coalesce(m.matched, '') AS matched, coalesce(i.modes, '') AS modes, coalesce(n.genes, '') AS genes,
  coalesce(l.to_check, '') AS to_check, round(r.conflict, 6) AS conflict
FROM ranked r LEFT JOIN m ON m.case_id = r.case_id AND m.profile_id = r.profile_id LEFT JOIN lacking l ON l.case_id = r.case_id AND l.profile_id = r.profile_id
  LEFT JOIN names n ON n.profile_id = r.profile_id LEFT JOIN modes i ON i.profile_id = r.profile_id WHERE r.rank <= 20"""
)
def match_report(spark, d):
    """The whole answer to a request, for every case: the twenty first profiles with what matched, inheritance, genes (stand-ins) and what to check."""
    top = base.top(spark, d, 20)
    ev = base.evidence(spark, d, top)
    facts = table(spark, d, "hpoa_annotation").select(F.col("database_id").alias("profile_id"), F.col("disease_name").alias("name"), F.nullif(F.regexp_extract("biocuration", ":([a-z]+)", 1), F.lit("")).alias("gene"))
    modes = annotations.inheritance(table(spark, d, "hpoa_annotation")).select("profile_id", F.array_join("terms", ", ").alias("modes"))
    return downstream.match_report(top, ev, base.positive(spark, d), base.case_observations(spark, d), facts, modes)
