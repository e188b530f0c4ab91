"""The engine's core tables, bound to the project's data, and the SQL that makes the same tables in DuckDB.

Tables that many queries share are written once per session and data folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenorank.functions import scalars
from phenorank.operators import annotations, hierarchy, observations, ontology, ranking
from phenorank.session import shared_dir, table, written

_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` over ``sf_dir``, written to the shared folder when first asked for."""
    key = (spark.sparkContext.applicationId + shared_dir(spark), sf_dir, name)
    if key not in _kept:
        _kept[key] = written(make(), name)[0]
    return _kept[key]


def forget() -> None:
    """Make shared tables anew from now on."""
    _kept.clear()


def registered(queries: dict[str, Callable], sqls: dict[str, str], sql: str | None) -> Callable:
    """A decorator that puts a query into ``queries`` under its function's name, and its SQL counterpart into ``sqls``."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        queries[function.__name__] = function
        if sql:
            sqls[function.__name__] = sql
        return function

    return add


def six(*names: str) -> list:
    """Rounded to six decimals; a negative zero becomes zero."""
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


#: Fixed value: the root of the phenotype branch. It is accepted in observations and profiles, and never scored.
ROOT = "HP:0000118"


def _inner_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term links of the extension modules, and each catalogue entry under the place its English name ends with."""

    def make() -> DataFrame:
        own = hierarchy.resolved_links(table(spark, sf_dir, "hpo_term"))[1]
        cat = table(spark, sf_dir, "hpo_catalog_vi").where("id is not null").select(F.upper(F.trim("id")).alias("child"), F.regexp_extract(F.lower("en"), r" of the ([a-z ]+)$", 1).alias("place"))
        return own.unionByName(cat.where("place <> ''").select("child", F.concat(F.lit("PLACE:"), "place").alias("parent"))).distinct()

    return kept(spark, sf_dir, "inner_links", make)


def _below_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        live = hierarchy.resolved_links(table(spark, sf_dir, "hpo_term"))[0]
        cat = table(spark, sf_dir, "hpo_catalog_vi").where("id is not null").select(F.upper(F.trim("id")).alias("hpo_id"))
        return live.unionByName(cat).unionByName(_inner_links(spark, sf_dir).select(F.col("parent").alias("hpo_id"))).where(F.col("hpo_id") != ROOT).distinct()

    return kept(spark, sf_dir, "below_root", make)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links: modules, places and entries without a parent hang under the one root."""
    inner = _inner_links(spark, sf_dir)
    tops = _below_root(spark, sf_dir).join(inner.select(F.col("child").alias("hpo_id")).distinct(), "hpo_id", "left_anti")
    return inner.unionByName(tops.select(F.col("hpo_id").alias("child"), F.lit(ROOT).alias("parent")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _below_root(spark, sf_dir).unionByName(spark.createDataFrame([(ROOT,)], "hpo_id string"))


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "closed_terms", lambda: ontology.closed(nodes(spark, sf_dir), links(spark, sf_dir)))


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.phenotypic(table(spark, sf_dir, "hpoa_annotation"))


def positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "positive", lambda: annotations.positive_terms(profile_rows(spark, sf_dir), ROOT))


def negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "negative", lambda: annotations.negative_terms(profile_rows(spark, sf_dir)))


def profile_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "profile_ids", lambda: profile_rows(spark, sf_dir).select("profile_id").distinct())


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        df = ontology.document_frequency(positive(spark, sf_dir), closed(spark, sf_dir))
        return ontology.information_content(nodes(spark, sf_dir).withColumnRenamed("hpo_id", "term"), df, profile_ids(spark, sf_dir).count(), ROOT)

    return kept(spark, sf_dir, "stats", make)


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.exploded(table(spark, sf_dir, "calibration_case"))


def report_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions of a report as the observations of a case."""
    m = table(spark, sf_dir, "phenotype_mention").where("report_id is not null and mention_id is not null")
    return m.select(
        F.col("report_id").alias("case_id"), F.col("mention_id").alias("ord"), scalars.normalize_term_id(F.col("hpo_id")).alias("term"), scalars.normalize_status(F.col("assertion")).alias("status"),
        scalars.normalize_subject(F.col("subject")).alias("subject"), F.lit(None).cast("string").alias("reviewer_status"), "extraction_confidence", "linking_confidence",
        F.col("certainty").alias("assertion_certainty"), "gestational_age_weeks",
    ).distinct()


def case_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "observations", lambda: observations.sanitized(raw_observations(spark, sf_dir), closed(spark, sf_dir), ROOT))


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        q = case_observations(spark, sf_dir).select("term").distinct()
        t = positive(spark, sf_dir).select("term").unionByName(negative(spark, sf_dir).select("term")).distinct()
        c, st = closed(spark, sf_dir), stats(spark, sf_dir)
        return ontology.term_similarity(q, t, c, st, ontology.trunk(c, st, ROOT)[0])

    return kept(spark, sf_dir, "similarity", make)


def engine(spark: SparkSession, sf_dir: str) -> tuple:
    """What :func:`ranking.top_profiles` takes: observations, matches, matches through the root by term and profile, statistics, the root's information."""
    obs, st = case_observations(spark, sf_dir), stats(spark, sf_dir)
    known = kept(spark, sf_dir, "known", lambda: ranking.known_matches(obs, similarity(spark, sf_dir), positive(spark, sf_dir), negative(spark, sf_dir)))
    _, root, ic = ontology.trunk(closed(spark, sf_dir), st, ROOT)
    by_term, by_profile = ranking.root_matches(closed(spark, sf_dir), positive(spark, sf_dir), profile_ids(spark, sf_dir), root or ROOT, ic)
    return obs, known, by_term, kept(spark, sf_dir, "by_profile", lambda: by_profile), st, ic


def top(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The first profiles of each case by coverage."""
    return kept(spark, sf_dir, "top_20", lambda: ranking.top_profiles(*engine(spark, sf_dir), top_k=20)).where(F.col("rank") <= k)


def evidence(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """The evidence of ``pairs(case_id, profile_id)``, by default that of the ten first profiles of each case."""
    return ranking.evidence(top(spark, sf_dir) if pairs is None else pairs, *engine(spark, sf_dir))


def pair_scores(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    return ranking.scores(case_observations(spark, sf_dir), evidence(spark, sf_dir, pairs), stats(spark, sf_dir))


ONTOLOGY = """
WITH RECURSIVE ids AS (
  SELECT DISTINCT upper(trim(hpo_id)) AS id, coalesce(is_obsolete, false) AS gone, upper(trim(replaced_by)) AS replaced, parents, alt_ids FROM hpo_term
),
live AS (SELECT DISTINCT id FROM ids WHERE id NOT IN (SELECT id FROM ids WHERE gone)),
alias AS (
  SELECT id AS a, min(replaced) AS b FROM ids WHERE gone GROUP BY id
  UNION ALL
  SELECT a, min(id) FROM (SELECT upper(trim(unnest(alt_ids))) AS a, id FROM ids) WHERE a NOT IN (SELECT id FROM ids) GROUP BY a
),
named AS (SELECT DISTINCT child, parent FROM (SELECT id AS child, upper(trim(unnest(parents))) AS parent FROM ids WHERE NOT gone) WHERE child IN (SELECT id FROM live)),
meant(child, parent) AS (
  SELECT child, parent FROM named
  UNION
  SELECT m.child, a.b FROM meant m JOIN alias a ON a.a = m.parent
),
cat AS (SELECT DISTINCT upper(trim(id)) AS id, regexp_extract(lower(en), ' of the ([a-z ]+)$', 1) AS place FROM hpo_catalog_vi WHERE id IS NOT NULL),
inner_links AS (
  SELECT DISTINCT child, parent FROM meant WHERE parent IN (SELECT id FROM live)
  UNION
  SELECT id, 'PLACE:' || place FROM cat WHERE place <> ''
),
below_root AS (SELECT id AS hpo_id FROM live UNION SELECT id FROM cat UNION SELECT parent FROM inner_links),
links AS (
  SELECT child, parent FROM inner_links
  UNION
  SELECT hpo_id, 'HP:0000118' FROM below_root WHERE hpo_id NOT IN (SELECT child FROM inner_links)
),
nodes AS (SELECT hpo_id FROM below_root UNION SELECT 'HP:0000118'),
reach(node, anc, dist) USING KEY (node, anc) AS (
  SELECT child, parent, 1 FROM links
  UNION
  SELECT r.node, l.parent, min(r.dist + 1) FROM reach r JOIN links l ON l.child = r.anc LEFT JOIN recurring.reach k ON k.node = r.node AND k.anc = l.parent
  WHERE k.dist IS NULL OR k.dist > r.dist + 1 GROUP BY r.node, l.parent
),
closed AS (
  SELECT node AS term, anc, dist FROM reach WHERE node <> anc
  UNION ALL SELECT hpo_id, hpo_id, 0 FROM nodes
)
"""

NORMAL_ID = r"CASE WHEN regexp_matches(regexp_replace(replace(upper(trim({0})), '_', ':'), '^HP([0-9])', 'HP:\1'), '^HP:[0-9]{{7}}$') THEN regexp_replace(replace(upper(trim({0})), '_', ':'), '^HP([0-9])', 'HP:\1') END"

#: A text as ``scalars.normalize_text`` makes it: compatibility letters that occur are spelled out, then accents go.
NORMAL_TEXT = (
    "trim(regexp_replace(strip_accents(nfc_normalize(lower(translate(replace(replace({0}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯ"
    + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    + "đĐ', 'ivxlcdmIVXLCDM"
    + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    + "dD')))), '[^a-z0-9:+]+', ' ', 'g'))"
)


def normal_sql(column: str) -> str:
    return NORMAL_TEXT.replace("{0}", column)


FREQUENCY = """
parsed AS (
  SELECT annotation_id, database_id, disease_name, qualifier, hpo_id, aspect, lower(trim(frequency_raw)) AS t FROM hpoa_annotation
),
cut AS (
  SELECT *, upper(regexp_extract(t, '^(hp:[0-9]{7})', 1)) AS code,
    try_cast(nullif(regexp_extract(t, '([0-9]+(?:[.][0-9]+)?) *%', 1), '') AS DOUBLE) AS pct,
    try_cast(nullif(regexp_extract(t, '^([0-9]+(?:[.][0-9]+)?) */ *([0-9]+(?:[.][0-9]+)?)$', 1), '') AS DOUBLE) AS num,
    try_cast(nullif(regexp_extract(t, '^([0-9]+(?:[.][0-9]+)?) */ *([0-9]+(?:[.][0-9]+)?)$', 2), '') AS DOUBLE) AS den,
    CASE WHEN regexp_matches(t, '^[-+]?[0-9.]+(e[-+]?[0-9]+)?$') THEN try_cast(t AS DOUBLE) END AS plain
  FROM parsed
),
valued AS (
  SELECT *,
    CASE code WHEN 'HP:0040280' THEN 0.995 WHEN 'HP:0040281' THEN 0.9 WHEN 'HP:0040282' THEN 0.545 WHEN 'HP:0040283' THEN 0.17 WHEN 'HP:0040284' THEN 0.025 WHEN 'HP:0040285' THEN 0 END AS by_code,
    CASE WHEN contains(t, 'very frequent') THEN 0.9 WHEN contains(t, 'occasional') THEN 0.17 WHEN contains(t, 'very rare') THEN 0.025 WHEN contains(t, 'obligate') THEN 0.995
         WHEN contains(t, 'frequent') THEN 0.545 WHEN contains(t, 'excluded') THEN 0 END AS by_label
  FROM cut
),
frequency AS (
  SELECT annotation_id, database_id, disease_name, qualifier, hpo_id, aspect,
    CASE WHEN by_code IS NOT NULL OR by_label IS NOT NULL THEN 'category' WHEN pct IS NOT NULL THEN 'percent' WHEN den > 0 THEN 'ratio' WHEN den IS NOT NULL THEN 'missing'
         WHEN plain >= 0 THEN 'numeric' ELSE 'missing' END AS kind,
    least(1, CASE WHEN by_code IS NOT NULL THEN by_code WHEN by_label IS NOT NULL THEN by_label WHEN pct IS NOT NULL THEN pct / 100 WHEN den > 0 THEN num / den WHEN den IS NOT NULL THEN 0.5
         WHEN plain > 1 THEN plain / 100 WHEN plain >= 0 THEN plain ELSE 0.5 END)::DOUBLE AS probability,
    CASE WHEN by_code IS NULL AND by_label IS NULL AND pct IS NULL AND den > 0 THEN num END AS numerator,
    CASE WHEN by_code IS NULL AND by_label IS NULL AND pct IS NULL AND den > 0 THEN den END AS denominator
  FROM valued
)
"""

PROFILES = (
    FREQUENCY
    + """,
rows_ AS (
  SELECT DISTINCT database_id AS profile_id, disease_name AS profile_name, """
    + NORMAL_ID.format("hpo_id").replace("{{", "{").replace("}}", "}")
    + """ AS term,
    upper(coalesce(trim(qualifier), '')) IN ('NOT', 'ABSENT', 'EXCLUDED') OR probability <= 0 AS negated, kind, probability, numerator, denominator
  FROM frequency WHERE coalesce(aspect, '') IN ('', 'P') AND database_id IS NOT NULL
),
annot AS (SELECT * FROM rows_ WHERE term IS NOT NULL),
n_profiles AS (SELECT count(DISTINCT profile_id) AS n FROM annot),
neg AS (SELECT DISTINCT profile_id, term FROM annot WHERE negated),
pos AS (SELECT profile_id, term, max(probability) AS freq FROM annot WHERE term <> 'HP:0000118' GROUP BY profile_id, term HAVING NOT bool_or(negated))
"""
)

STATS = """,
df AS (SELECT c.anc AS term, count(DISTINCT p.profile_id) AS df FROM pos p JOIN closed c ON c.term = p.term GROUP BY c.anc),
stats AS (
  SELECT term, df, background, -ln(background) AS ic FROM (
    SELECT hpo_id AS term, coalesce(df, 0) AS df, CASE WHEN hpo_id = 'HP:0000118' THEN 0.9999 ELSE least(greatest((coalesce(df, 0) + 0.5) / (n + 1.0), 0.0001), 0.9999) END::DOUBLE AS background
    FROM nodes LEFT JOIN df ON df.term = hpo_id CROSS JOIN n_profiles)
)
"""

OBSERVATIONS = (
    """,
one_case AS (SELECT case_id, arg_min(observations, received_at) AS observations FROM calibration_case WHERE case_id IS NOT NULL GROUP BY case_id),
flat AS (SELECT case_id, unnest(observations) AS o, generate_subscripts(observations, 1) - 1 AS ord FROM one_case),
obs AS (
  SELECT case_id, ord, """
    + NORMAL_ID.format("o.hpo_id").replace("{{", "{").replace("}}", "}")
    + """ AS term,
    CASE WHEN upper(trim(o.status)) IN ('PRESENT', 'CÓ') THEN 'PRESENT' WHEN upper(trim(o.status)) IN ('SUSPECTED', 'NGHI NGỜ') THEN 'SUSPECTED'
         WHEN upper(trim(o.status)) IN ('ABSENT', 'KHÔNG') THEN 'ABSENT' WHEN upper(trim(o.status)) = 'NOT_ASSESSED' THEN 'NOT_ASSESSED' END AS status,
    upper(trim(o.reviewer_status)) AS reviewer_status, o.extraction_confidence, o.linking_confidence, o.assertion_certainty, o.gestational_age_weeks
  FROM flat
),
merged AS (
  SELECT case_id, term, min(ord) AS ord,
    arg_max(status, CASE status WHEN 'PRESENT' THEN 3 WHEN 'SUSPECTED' THEN 2 WHEN 'ABSENT' THEN 2 ELSE 1 END * 100000 - ord) AS status,
    bool_or(status IN ('PRESENT', 'SUSPECTED')) AND bool_or(status = 'ABSENT') AS conflict,
    max(extraction_confidence) AS extraction_confidence, max(linking_confidence) AS linking_confidence, max(reviewer_status) AS reviewer_status, count(*) AS mention_count
  FROM obs WHERE term IN (SELECT hpo_id FROM nodes) AND term <> 'HP:0000118' AND status IS NOT NULL GROUP BY case_id, term
),
clash AS (
  SELECT DISTINCT a.case_id, a.term AS absent_term, f.term AS present_term FROM merged a JOIN merged f ON a.case_id = f.case_id AND a.status = 'ABSENT' AND f.status IN ('PRESENT', 'SUSPECTED')
    JOIN closed c ON c.term = f.term AND c.anc = a.term AND c.dist > 0
  UNION SELECT case_id, term, term FROM merged WHERE conflict
),
sound AS (SELECT * FROM merged WHERE case_id NOT IN (SELECT case_id FROM clash)),
redundant AS (
  SELECT g.case_id, g.term FROM sound g JOIN sound l ON g.case_id = l.case_id AND g.status IN ('PRESENT', 'SUSPECTED') AND l.status IN ('PRESENT', 'SUSPECTED')
    JOIN closed c ON c.term = l.term AND c.anc = g.term AND c.dist > 0 WHERE (l.status = 'PRESENT') >= (g.status = 'PRESENT')
  UNION
  SELECT l.case_id, l.term FROM sound g JOIN sound l ON g.case_id = l.case_id AND g.status = 'ABSENT' AND l.status = 'ABSENT' JOIN closed c ON c.term = l.term AND c.anc = g.term AND c.dist > 0
),
clean AS (
  SELECT case_id, ord, term, status,
    CASE WHEN coalesce(reviewer_status = 'REJECTED', false) OR status = 'NOT_ASSESSED' THEN 0
      WHEN status IN ('PRESENT', 'ABSENT') THEN least(1, greatest(0, m))
      WHEN extraction_confidence IS NULL AND linking_confidence IS NULL AND NOT coalesce(reviewer_status = 'CLINICIAN_CONFIRMED', false) THEN 0.5
      ELSE least(0.75, greatest(0.10, 0.75 * m)) END::DOUBLE AS w
  FROM (SELECT *, CASE WHEN reviewer_status = 'CLINICIAN_CONFIRMED' THEN 1 ELSE coalesce(extraction_confidence, 1) * coalesce(linking_confidence, 1) END AS m FROM sound)
  WHERE (case_id, term) NOT IN (SELECT (case_id, term) FROM redundant)
)
"""
)

STATUS_SQL = """CASE WHEN regexp_replace(upper(trim({0})), '[-\\s]+', '_', 'g') IN ('PRESENT', 'CÓ', 'OBSERVED', 'POSITIVE') THEN 'PRESENT'
  WHEN regexp_replace(upper(trim({0})), '[-\\s]+', '_', 'g') IN ('SUSPECTED', 'NGHI_NGỜ', 'POSSIBLE', 'UNCERTAIN') THEN 'SUSPECTED'
  WHEN regexp_replace(upper(trim({0})), '[-\\s]+', '_', 'g') IN ('ABSENT', 'KHÔNG', 'NEGATED', 'NEGATIVE') THEN 'ABSENT'
  WHEN regexp_replace(upper(trim({0})), '[-\\s]+', '_', 'g') IN ('NOT_ASSESSED', 'UNKNOWN', 'CHƯA_KHẢO_SÁT') THEN 'NOT_ASSESSED' END"""
#: The mentions of a report as the observations of a case, and what follows for them.
REPORTS = (
    ", obs AS (SELECT DISTINCT report_id AS case_id, mention_id AS ord, "
    + NORMAL_ID.format("hpo_id").replace("{{", "{").replace("}}", "}")
    + " AS term, "
    + STATUS_SQL.replace("{0}", "assertion")
    + " AS status, NULL::VARCHAR AS reviewer_status, extraction_confidence, linking_confidence, certainty AS assertion_certainty, gestational_age_weeks FROM phenotype_mention WHERE report_id IS NOT NULL AND mention_id IS NOT NULL),\nmerged AS ("
    + OBSERVATIONS.split("merged AS (")[1].split("sound AS (")[0].rstrip().rstrip(",")
)

SIMILARITY = """,
targets AS (SELECT term FROM pos UNION SELECT term FROM neg),
sources AS (SELECT DISTINCT term FROM clean),
best_anc AS (
  SELECT q, t, max(struct_pack(ic := ic, anc := anc, d := d)) AS m FROM (
    SELECT a.term AS q, b.term AS t, a.anc AS anc, s.ic AS ic, struct_pack(dq := a.dist, dt := b.dist) AS d
    FROM closed a JOIN sources ON sources.term = a.term JOIN closed b ON b.anc = a.anc AND a.anc <> 'HP:0000118' JOIN targets ON targets.term = b.term JOIN stats s ON s.term = a.anc)
  GROUP BY q, t
),
sims AS (
  SELECT b.q, b.t, sq.ic AS ic_q, st.ic AS ic_t, m.ic AS ic_m, m.d.dq + m.d.dt AS d_m, dn.dist AS d_below, up.dist AS d_above
  FROM best_anc b JOIN stats sq ON sq.term = b.q JOIN stats st ON st.term = b.t
    LEFT JOIN closed dn ON dn.term = b.t AND dn.anc = b.q AND dn.dist > 0
    LEFT JOIN closed up ON up.term = b.q AND up.anc = b.t AND up.dist > 0
),
similarity AS (
  SELECT * FROM (
    SELECT q, t, CASE WHEN q = t THEN 'exact' WHEN d_below IS NOT NULL THEN 'profile_descendant' WHEN d_above IS NOT NULL THEN 'profile_ancestor' ELSE 'semantic' END AS relation,
      CASE WHEN q = t THEN 0 WHEN d_below IS NOT NULL THEN d_below WHEN d_above IS NOT NULL THEN d_above ELSE d_m END AS dist,
      CASE WHEN q = t OR d_below IS NOT NULL THEN 1 WHEN d_above IS NOT NULL THEN CASE WHEN ic_q > 1e-9 THEN least(1, ic_t / ic_q) ELSE 1.0 / (1 + d_above) END
           ELSE CASE WHEN ic_q > 1e-9 THEN least(1, ic_m / ic_q) ELSE 0 END END::DOUBLE AS sim,
      CASE WHEN q = t OR d_below IS NOT NULL THEN 1 WHEN d_above IS NOT NULL THEN greatest(CASE WHEN ic_q > 1e-9 THEN least(1, ic_t / ic_q) ELSE 1.0 / (1 + d_above) END, pow(0.5, d_above))
           ELSE CASE WHEN ic_q > 1e-9 THEN least(1, ic_m / ic_q) ELSE 0 END END::DOUBLE AS strength, ic_m
    FROM sims) WHERE relation <> 'semantic' OR ic_m > 1e-9
)
"""

KNOWN = """,
hits AS (
  SELECT s.q, p.profile_id, s.relation, s.t, s.dist, s.sim, s.strength, p.freq, false AS negative,
    CASE s.relation WHEN 'exact' THEN 4 WHEN 'semantic' THEN 1 ELSE 3 END AS prio, s.strength * greatest(p.freq, 0.01) AS value
  FROM similarity s JOIN pos p ON p.term = s.t
  UNION ALL
  SELECT s.q, p.profile_id, s.relation, s.t, s.dist, s.sim, s.strength, 0, true, CASE s.relation WHEN 'exact' THEN 4 ELSE 3 END, s.strength * 0.01
  FROM similarity s JOIN neg p ON p.term = s.t WHERE s.relation <> 'semantic'
),
picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, profile_id, negative ORDER BY prio DESC, value DESC, dist, t DESC) AS n FROM hits) WHERE n = 1
),
root_ic AS (SELECT ic AS root_ic FROM stats WHERE term = 'HP:0000118'),
by_term AS (SELECT term, dist AS dq FROM closed WHERE anc = 'HP:0000118'),
by_profile AS (
  SELECT profile_id, term AS r_t, freq AS r_freq, dq AS r_dt FROM (
    SELECT p.profile_id, p.term, p.freq, b.dq, row_number() OVER (PARTITION BY p.profile_id ORDER BY greatest(p.freq, 0.01) DESC, b.dq, p.term DESC) AS n FROM pos p JOIN by_term b ON b.term = p.term)
  WHERE n = 1
),
profile_ids AS (SELECT DISTINCT profile_id FROM annot)
"""


def evidence_sql(name: str, pairs: str) -> str:
    """Common table expressions that end in the evidence ``name`` of the pairs in the table ``pairs``."""
    return f""",
{name}_met AS (
  SELECT o.case_id, o.ord, w.profile_id, o.term, o.status, o.w, s.background, s.ic,
    coalesce(p.relation, CASE WHEN r.r_freq IS NOT NULL AND b.dq IS NOT NULL THEN 'semantic' END) AS p_relation,
    CASE WHEN p.relation IS NOT NULL THEN p.freq ELSE r.r_freq END AS p_freq, coalesce(p.strength, least(1, root_ic / greatest(s.ic, 1e-9))) AS p_strength,
    coalesce(p.sim, least(1, root_ic / greatest(s.ic, 1e-9))) AS p_sim, coalesce(p.t, r.r_t) AS p_t, coalesce(p.dist, b.dq + r.r_dt) AS p_dist, coalesce(p.prio, 1) AS p_prio,
    n.relation AS n_relation, n.t AS n_t, n.dist AS n_dist, n.prio AS n_prio
  FROM {pairs} w JOIN clean o ON o.case_id = w.case_id JOIN stats s ON s.term = o.term CROSS JOIN root_ic
    LEFT JOIN by_term b ON b.term = o.term LEFT JOIN by_profile r ON r.profile_id = w.profile_id
    LEFT JOIN picked p ON NOT p.negative AND p.q = o.term AND p.profile_id = w.profile_id LEFT JOIN picked n ON n.negative AND n.q = o.term AND n.profile_id = w.profile_id
),
{name}_judged AS (
  SELECT *, n_prio IS NOT NULL AND (p_relation IS NULL OR n_prio >= p_prio) AS absent FROM {name}_met
),
{name}_likely AS (
  SELECT *,
    least(0.9999, greatest(0.0001, CASE WHEN absent OR p_relation IS NULL THEN 0.0001 WHEN p_relation IN ('exact', 'profile_descendant') THEN p_freq
      WHEN p_relation = 'profile_ancestor' THEN 0.0001 + (p_freq - 0.0001) * p_strength ELSE 0.0001 + (p_freq - 0.0001) * 0.25 * p_strength END))::DOUBLE AS probability
  FROM {name}_judged
),
{name} AS (
  SELECT case_id, ord, profile_id, term, status, w, background, ic, CASE WHEN absent THEN 'profile_absent_' || n_relation ELSE coalesce(p_relation, 'no_match') END AS relation,
    CASE WHEN absent THEN n_t WHEN p_relation IS NOT NULL THEN p_t END AS matched_term, CASE WHEN absent THEN n_dist WHEN p_relation IS NOT NULL THEN p_dist END AS distance,
    CASE WHEN absent OR p_relation IS NULL THEN 0 ELSE p_sim END AS sim, absent, p_relation IS NOT NULL AS positive, probability,
    CASE WHEN status = 'ABSENT' THEN ln(1 - probability) - ln(1 - background) ELSE ln(probability) - ln(background) END AS llr
  FROM {name}_likely
)
"""


def scores_sql(name: str, evidence: str) -> str:
    """The scores ``name`` of the pairs in the table ``evidence``."""
    return f""",
{name}_case AS (
  SELECT o.case_id, sum(CASE WHEN status IN ('PRESENT', 'SUSPECTED') THEN w ELSE 0 END) AS w_all, sum(CASE WHEN status IN ('PRESENT', 'SUSPECTED') THEN w * ic ELSE 0 END) AS ic_all,
    sum(CASE WHEN status = 'ABSENT' THEN ic ELSE 0 END) AS absent_all
  FROM clean o JOIN stats s ON s.term = o.term GROUP BY o.case_id
),
{name}_pair AS (
  SELECT case_id, profile_id, sum(CASE WHEN status <> 'NOT_ASSESSED' THEN w * llr ELSE 0 END) AS log_likelihood,
    sum(CASE WHEN status IN ('PRESENT', 'SUSPECTED') AND NOT absent AND relation = 'exact' THEN w ELSE 0 END) AS w_exact,
    sum(CASE WHEN status IN ('PRESENT', 'SUSPECTED') AND NOT absent AND relation NOT IN ('semantic', 'no_match') THEN w ELSE 0 END) AS w_anc,
    sum(CASE WHEN status IN ('PRESENT', 'SUSPECTED') AND NOT absent THEN w * ic * sim ELSE 0 END) AS ic_hit,
    sum(CASE WHEN status = 'ABSENT' AND positive THEN ic * probability ELSE 0 END) AS clash_sum
  FROM {evidence} GROUP BY case_id, profile_id
),
{name}_parts AS (
  SELECT p.case_id, profile_id, CASE WHEN w_all > 1e-9 THEN w_exact / w_all ELSE 0 END AS exact, CASE WHEN w_all > 1e-9 THEN w_anc / w_all ELSE 0 END AS ancestor,
    CASE WHEN ic_all > 1e-9 THEN ic_hit / ic_all WHEN w_all > 1e-9 THEN w_anc / w_all ELSE 0 END AS ic_coverage,
    CASE WHEN absent_all > 1e-9 THEN clash_sum / absent_all ELSE 0 END AS conflict, log_likelihood
  FROM {name}_pair p JOIN {name}_case c ON c.case_id = p.case_id
),
{name} AS (
  SELECT *, log_likelihood + 0.5 * ic_coverage + 0.25 * exact + 0.1 * ancestor - 0.75 * conflict AS score,
    least(1, greatest(0, 0.45 * ic_coverage + 0.3 * exact + 0.25 * ancestor - 0.5 * conflict)) AS compatibility
  FROM {name}_parts
)
"""


ALL_KNOWN = ONTOLOGY + "," + PROFILES + STATS + OBSERVATIONS + SIMILARITY + KNOWN
ALL = (
    ALL_KNOWN
    + ", pairs AS (SELECT case_id, profile_id FROM (SELECT DISTINCT case_id FROM clean) CROSS JOIN profile_ids)"
    + evidence_sql("all_evidence", "pairs")
    + scores_sql("scores", "all_evidence")
    + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(ic_coverage, 10) DESC, round(exact, 10) DESC, round(score, 10) DESC, profile_id DESC) AS rank FROM scores
)
"""
)
#: The evidence of the ten first profiles of each case.
EVIDENCE = ", firsts AS (SELECT case_id, profile_id FROM ranked WHERE rank <= 10)" + evidence_sql("evidence", "firsts")
