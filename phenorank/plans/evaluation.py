"""Queries of evaluation, text, review and calibration data, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenorank.functions import scalars
from phenorank.operators import clauses, metrics, ranking, review, splits, text
from phenorank.plans import base
from phenorank.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL counterpart."""
    return base.registered(QUERIES, SQL, sql)


six = base.six


def _golds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "calibration_case").where("case_id is not null").select("case_id", F.explode("gold_disease_ids").alias("g")).select("case_id", F.upper(F.trim("g")).alias("profile_id")).distinct()


_HITS = (
    base.ALL
    + """, golds AS (SELECT DISTINCT case_id, upper(trim(unnest(gold_disease_ids))) AS profile_id FROM calibration_case WHERE case_id IS NOT NULL),
hit_ranks AS (SELECT g.case_id, min(r.rank) AS hit_rank FROM golds g LEFT JOIN ranked r ON r.case_id = g.case_id AND r.profile_id = g.profile_id GROUP BY g.case_id)
"""
)


@query(
    _HITS
    + """SELECT count(*) AS cases, round(avg((coalesce(hit_rank, 999999) <= 1)::INT), 6) AS top_1, round(avg((coalesce(hit_rank, 999999) <= 3)::INT), 6) AS top_3,
round(avg((coalesce(hit_rank, 999999) <= 5)::INT), 6) AS top_5, round(avg((coalesce(hit_rank, 999999) <= 10)::INT), 6) AS top_10, round(avg(coalesce(1.0 / hit_rank, 0)), 6) AS mrr FROM hit_ranks"""
)
def ranking_metrics(spark, d):
    return metrics.ranking_metrics(first_relevant_rank(spark, d)).select("cases", *six("top_1", "top_3", "top_5", "top_10", "mrr"))


@query(_HITS + "SELECT case_id, hit_rank FROM hit_ranks")
def first_relevant_rank(spark, d):
    golds = _golds(spark, d)
    return metrics.hit_rank(base.kept(spark, d, "gold_places", lambda: ranking.places(golds, *base.engine(spark, d))), golds)


_SCORED = "WITH scored AS (SELECT linking_confidence AS score, (hpo_id IS NOT NULL)::INT AS label FROM phenotype_mention WHERE linking_confidence BETWEEN 0 AND 1)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "phenotype_mention").where("linking_confidence between 0 and 1").select(F.col("linking_confidence").alias("score"), F.col("hpo_id").isNotNull().cast("int").alias("label"))


@query(
    _SCORED
    + """, per AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS rate FROM scored GROUP BY 1)
SELECT b.bin::INT AS bin, coalesce(n, 0) AS n, round(mean_score, 6) AS mean_score, round(rate, 6) AS rate FROM range(10) b(bin) LEFT JOIN per ON per.bin = b.bin"""
)
def reliability_bins(spark, d):
    return metrics.reliability(_scored(spark, d)).select("bin", "n", *six("mean_score", "rate"))


@query(
    _SCORED
    + """, per AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS s, avg(label) AS r FROM scored GROUP BY 1),
c AS (SELECT label, least(1 - 1e-12, greatest(1e-12, score)) AS p, score FROM scored)
SELECT (SELECT count(*) FROM scored) AS n, round((SELECT avg(pow(score - label, 2)) FROM scored), 6) AS brier, round((SELECT sum(n * abs(s - r)) / sum(n) FROM per), 6) AS ece,
  round((SELECT avg(-(label * ln(p) + (1 - label) * ln(1 - p))) FROM c), 6) AS log_loss"""
)
def brier_ece(spark, d):
    return metrics.brier_ece(_scored(spark, d)).select("n", *six("brier", "ece", "log_loss"))


@query(
    _SCORED
    + """, c AS (SELECT score + 0.0 AS score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT round(sum(pos * (before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM r"""
)
def auc(spark, d):
    return metrics.auc(_scored(spark, d)).select(*six("auc"))


@query(
    _SCORED
    + """, c AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT score + 0.0 AS score, label AS pos, 1 - label AS neg FROM scored UNION ALL SELECT 0.5, 0, 0) GROUP BY 1),
r AS (SELECT *, coalesce(sum(neg) OVER w, 0) AS bn, coalesce(sum(pos) OVER w, 0) AS bp FROM c WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT score, round(((SELECT sum(pos) FROM c) - bp) / (SELECT sum(pos) FROM c) / 2 + bn / (SELECT sum(neg) FROM c) / 2, 10) AS ba FROM r)
SELECT score AS threshold, round(ba, 6) AS balanced_accuracy FROM b ORDER BY ba DESC, abs(score - 0.5), score LIMIT 1"""
)
def threshold_selection(spark, d):
    return metrics.best_threshold(_scored(spark, d)).select("threshold", *six("balanced_accuracy"))


@query(
    """WITH m AS (SELECT mention_id, report_id, hpo_id FROM phenotype_mention WHERE hpo_id IS NOT NULL AND report_id IS NOT NULL),
best AS (SELECT mention_id, hpo_id FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC NULLS LAST, hpo_id) AS n FROM hpo_candidate WHERE hpo_id IS NOT NULL) WHERE n = 1),
g AS (SELECT report_id, hpo_id, count(*) AS g FROM m GROUP BY ALL), p AS (SELECT m.report_id, b.hpo_id, count(*) AS p FROM m JOIN best b ON b.mention_id = m.mention_id GROUP BY ALL),
s AS (SELECT sum(least(coalesce(g, 0), coalesce(p, 0))) AS tp, sum(greatest(coalesce(p, 0) - coalesce(g, 0), 0)) AS fp, sum(greatest(coalesce(g, 0) - coalesce(p, 0), 0)) AS fn
  FROM g FULL JOIN p ON p.report_id = g.report_id AND p.hpo_id = g.hpo_id)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s"""
)
def mention_prf(spark, d):
    """Linked mentions against the best candidate of each, as multisets per report."""
    m = table(spark, d, "phenotype_mention").where("hpo_id is not null and report_id is not null")
    c = table(spark, d, "hpo_candidate").where("hpo_id is not null")
    best = c.groupBy("mention_id").agg(F.min(F.struct((-F.coalesce("score", F.lit(-1.0))).alias("s"), "hpo_id")).alias("b")).select("mention_id", F.col("b.hpo_id").alias("hpo_id"))
    predicted = m.select("mention_id", "report_id").join(best, "mention_id").select("report_id", "hpo_id")
    return metrics.multiset_prf(m.select("report_id", "hpo_id"), predicted, ["report_id", "hpo_id"]).select("tp", "fp", "fn", *six("precision", "recall", "f1"))


_CUE = r"(?i)(?:^|[^\p{L}\p{N}_])(1\s*phần|một\s*phần|1\s*phan|mot\s*phan|theo\s*dõi|theo\s*doi|t/d|td|nghi\s*ngờ|nghi\s*ngo|nghi)(?:$|[^\p{L}\p{N}_])"
_CUED = f"cued AS (SELECT mention_id, assertion, nullif(regexp_extract(nfc_normalize(mention_text), '{_CUE}', 1), '') AS cue FROM phenotype_mention WHERE mention_text IS NOT NULL)"
_STATUS = base.STATUS_SQL.replace("{0}", "assertion")


def _cued(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "phenotype_mention").where("mention_text is not null").select("mention_id", "assertion", scalars.nfc(F.col("mention_text")).alias("t"))
    return m.select("mention_id", "assertion", text.cue_assertion(F.col("t")).alias("c"))


@query(f"WITH {_CUED} SELECT mention_id, CASE WHEN cue IS NULL THEN 'PRESENT' ELSE 'SUSPECTED' END AS status, cue, CASE WHEN cue IS NOT NULL THEN 'mention' END AS place, count(*) AS n FROM cued GROUP BY ALL")
def assertion_cues(spark, d):
    """Status of each mention by the cues in it, with the cue."""
    return _cued(spark, d).groupBy("mention_id", "c.status", "c.cue", "c.place").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_CUED}, pairs AS (SELECT {_STATUS} AS gold, CASE WHEN cue IS NULL THEN 'PRESENT' ELSE 'SUSPECTED' END AS predicted FROM cued),
g AS (SELECT gold AS label, sum((predicted = gold)::INT) AS tp, count(*) AS g FROM pairs WHERE gold IS NOT NULL GROUP BY 1), p AS (SELECT predicted AS label, count(*) AS p FROM pairs GROUP BY 1)
SELECT coalesce(g.label, p.label) AS label, coalesce(tp, 0)::BIGINT AS tp, (coalesce(p, 0) - coalesce(tp, 0))::BIGINT AS fp, (coalesce(g, 0) - coalesce(tp, 0))::BIGINT AS fn, round(coalesce(2.0 * tp / (g + coalesce(p, 0)), 0), 6) AS f1
FROM g FULL JOIN p ON p.label = g.label"""
)
def assertion_label_f1(spark, d):
    pairs = _cued(spark, d).select(scalars.normalize_status(F.col("assertion")).alias("gold"), F.col("c.status").alias("predicted"))
    return metrics.label_f1(pairs).select("label", "tp", "fp", "fn", *six("f1"))


def _case_sql(column: str, rules: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in rules.items()) + " END"


_TRIGGERS = ", ".join(f"('{status}', '{phrase}', {k}, {n})" for n, (k, status, phrase) in enumerate((k, status, p) for k, (status, phrases) in enumerate(clauses.ASSERTIONS) for p in phrases))
_WHO = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(padded, {chr(39)} {w} {chr(39)})' for w in words)} THEN '{who}/{rule}'" for who, rule, words in clauses.SUBJECTS) + f" ELSE '{'/'.join(clauses.DEFAULT_SUBJECT)}' END"


@query(
    f"""WITH m AS (SELECT DISTINCT mention_id, {base.normal_sql('mention_text')} AS n FROM phenotype_mention WHERE mention_text IS NOT NULL),
p AS (SELECT *, ' ' || n || ' ' AS padded, row_number() OVER () AS r FROM m),
triggers(status, phrase, priority, place) AS (VALUES {_TRIGGERS}),
said AS (SELECT r, arg_max(struct_pack(status := t.status, phrase := t.phrase), [len(string_split(phrase, ' ')), length(phrase), -priority, -place]) AS t FROM p JOIN triggers t ON contains(padded, ' ' || phrase || ' ') GROUP BY r)
SELECT mention_id, n AS normal, coalesce(t.status, 'PRESENT') AS status, t.phrase AS trigger, split_part({_WHO}, '/', 1) AS subject, split_part({_WHO}, '/', 2) AS rule,
  {_case_sql('n', clauses.LATERALITY)} AS laterality, {_case_sql('n', clauses.SEVERITY)} AS severity, {_case_sql('n', clauses.DISTRIBUTION)} AS distribution, {_case_sql('n', clauses.PROGRESSION)} AS progression
FROM p LEFT JOIN said ON said.r = p.r"""
)
def mention_attributes(spark, d):
    """What each mention's text says of status, subject, side, severity, distribution and progression."""
    m = table(spark, d, "phenotype_mention").where("mention_text is not null").select("mention_id", scalars.normalize_text(F.col("mention_text")).alias("normal")).distinct()
    n = F.col("normal")
    rows = m.select("mention_id", "normal", clauses.assertion(n).alias("a"), clauses.subject(n).alias("s"), clauses.laterality(n).alias("laterality"), clauses.severity(n).alias("severity"), clauses.distribution(n).alias("distribution"), clauses.progression(n).alias("progression"))
    return rows.select("mention_id", "normal", "a.status", "a.trigger", "s.subject", "s.rule", "laterality", "severity", "distribution", "progression")


@query(
    f"""WITH c AS (SELECT mention_id, list_sort(list(score), 'DESC') AS scores FROM hpo_candidate WHERE mention_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1),
m AS (SELECT DISTINCT mention_id, {_STATUS} AS status FROM phenotype_mention WHERE mention_id IS NOT NULL),
j AS (SELECT m.mention_id, m.status, coalesce(scores[1], 0) AS top, coalesce(abs(scores[1] - scores[2]) < 0.05, false) AS ambiguous, coalesce(len(scores), 0) AS n FROM m LEFT JOIN c ON c.mention_id = m.mention_id),
a AS (SELECT *, n = 0 OR top < 0.55 OR ambiguous AS abstained FROM j)
SELECT mention_id, status, abstained, ambiguous, abstained OR top < 0.85 OR coalesce(status, '') <> 'PRESENT' AS needs_review FROM a"""
)
def link_decision(spark, d):
    """Whether the retriever's candidates link a mention, are ambiguous, or need a review."""
    c = table(spark, d, "hpo_candidate").where("mention_id is not null and score is not null and not isnan(score)").groupBy("mention_id").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
    m = table(spark, d, "phenotype_mention").where("mention_id is not null").select("mention_id", scalars.normalize_status(F.col("assertion")).alias("status")).distinct()
    rows = m.join(c, "mention_id", "left").select("mention_id", "status", clauses.link_decision(F.col("scores"), F.col("status")).alias("x"))
    return rows.select("mention_id", "status", "x.abstained", "x.ambiguous", "x.needs_review")


@query()
def rule_mentions(spark, d):
    """Catalogue phrases in whole documents with clause, status, subject and attributes (checked by brute force in the tests)."""
    cat = table(spark, d, "hpo_catalog_vi").select("id", F.explode(F.array_compact(F.flatten(F.array(F.array("vi", "en"), F.coalesce(F.split("synonyms", "[|]"), F.array()))))).alias("phrase"))
    found = clauses.phrase_mentions(table(spark, d, "documents").where("doc_id is not null"), cat.select(F.col("id").alias("term"), "phrase"), "doc_id", "text")
    n = F.col("normal")
    rows = found.withColumn("normal", scalars.normalize_text(F.col("clause"))).withColumn("cue", text.cue_assertion(scalars.nfc(F.col("mention")), scalars.nfc(F.col("before"))))
    return rows.select(
        "doc_id", "start", "end", "mention", F.array_join("terms", ",").alias("terms"), clauses.assertion(n)["status"].alias("status"), F.col("cue.status").alias("cue_status"), text.cautious_context(F.col("before")).alias("cautious"),
        clauses.subject(n)["subject"].alias("subject"), clauses.laterality(n).alias("laterality"), clauses.severity(n).alias("severity"), F.to_json(clauses.measurement_map(F.col("clause"))).alias("measurements"),
    )


@query(
    """WITH s AS (SELECT DISTINCT report_id, span_start AS a, span_end AS b, hpo_id IS NOT NULL AS gold, coalesce(linking_confidence >= 0.5, false) AS found FROM phenotype_mention WHERE report_id IS NOT NULL AND span_start IS NOT NULL AND span_end IS NOT NULL),
g AS (SELECT DISTINCT report_id, a, b FROM s WHERE gold), p AS (SELECT DISTINCT report_id, a, b FROM s WHERE found),
c AS (SELECT coalesce(g.report_id, p.report_id) AS report_id, coalesce(g.a, p.a) AS a, coalesce(g.b, p.b) AS b, (g.a IS NOT NULL)::INT AS g, (p.a IS NOT NULL)::INT AS p FROM g FULL JOIN p ON g.report_id = p.report_id AND g.a = p.a AND g.b = p.b),
per AS (SELECT report_id, sum(g * p) AS tp, sum((1 - g) * p) AS fp, sum(g * (1 - p)) AS fn FROM c GROUP BY 1),
broken AS (SELECT count(*) AS fragmented FROM (SELECT c.report_id, c.a, c.b FROM c JOIN p ON p.report_id = c.report_id AND c.g = 1 AND c.p = 0 AND p.a >= c.a AND p.b <= c.b AND p.b > p.a GROUP BY ALL HAVING count(*) >= 2)),
one AS (SELECT count(*) AS samples, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn, avg((coalesce(fp, 0) + coalesce(fn, 0) = 0)::INT) AS exact FROM (SELECT DISTINCT report_id FROM s) LEFT JOIN per USING (report_id))
SELECT samples, 0::BIGINT AS invalid_outputs, tp, fp, fn, round(exact, 6) AS exact_rate, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, fragmented FROM one, broken"""
)
def span_score(spark, d):
    """Exact spans of the mentions linked with confidence against those of the mentions that a reviewer linked, per report."""
    m = table(spark, d, "phenotype_mention").where("report_id is not null and span_start is not null and span_end is not null")
    m = m.select("report_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.col("hpo_id").isNotNull().alias("gold"), (F.col("linking_confidence") >= 0.5).alias("found"))
    samples = m.select("report_id", F.lit(False).alias("failed")).distinct()
    return metrics.span_scores(samples, m.where("gold"), m.where("found"), "report_id").select("samples", "invalid_outputs", "tp", "fp", "fn", *six("exact_rate", "precision", "recall", "f1"), "fragmented")


_SPANS = """WITH s AS (SELECT DISTINCT mention_id AS id, report_id, span_start, span_end, lower(trim(assertion)) = 'present' AS found FROM phenotype_mention WHERE report_id IS NOT NULL AND mention_id IS NOT NULL AND span_end > span_start)
"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "phenotype_mention").where("report_id is not null and mention_id is not null").select(F.col("mention_id").alias("id"), "report_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"), (F.lower(F.trim("assertion")) == "present").alias("found")).distinct()
    return metrics.overlaps(s.where("found"), s.where("not found"), "report_id")


@query(_SPANS + "SELECT a.report_id, count(*) AS n_edges FROM s a JOIN s b ON a.report_id = b.report_id AND a.found AND NOT b.found AND a.span_start < b.span_end AND b.span_start < a.span_end GROUP BY a.report_id")
def span_overlap_edges(spark, d):
    """Per report, overlaps of found mentions with others."""
    return _edges(spark, d).groupBy("report_id").agg(F.count("*").alias("n_edges"))


@query(f"SELECT DISTINCT mention_id, {base.normal_sql('mention_text')} AS normal FROM phenotype_mention WHERE mention_text IS NOT NULL")
def normalise_text(spark, d):
    m = table(spark, d, "phenotype_mention").where("mention_text is not null")
    return m.select("mention_id", scalars.normalize_text(F.col("mention_text")).alias("normal")).distinct()


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hpo_catalog_vi").where("en is not null").select(F.col("id").alias("term"), F.col("en").alias("phrase"))


@query(
    f"""WITH l AS (SELECT DISTINCT id AS term, {base.normal_sql('en')} AS phrase FROM hpo_catalog_vi WHERE en IS NOT NULL),
t AS (SELECT doc_id, ' ' || {base.normal_sql('text')} || ' ' AS body FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, term FROM t JOIN l ON phrase <> '' AND contains(body, ' ' || phrase || ' ')"""
)
def dictionary_scan(spark, d):
    """Catalogue names in all documents."""
    return text.dictionary_scan(table(spark, d, "documents"), _lexicon(spark, d), "doc_id", "text").select("doc_id", "term").distinct()


@query()
def longest_match(spark, d):
    """Greedy longest, non-overlapping catalogue names in all documents (checked by brute force in the tests)."""
    return text.greedy_spans(text.dictionary_scan(table(spark, d, "documents"), _lexicon(spark, d), "doc_id", "text"), "doc_id")


@query()
def bipartite_match(spark, d):
    """Largest matching of overlapping mentions, island by island (checked by brute force in the tests)."""
    from pyspark.sql import Window

    s = table(spark, d, "phenotype_mention").where("report_id is not null and mention_id is not null and span_end > span_start")
    s = s.select(F.col("mention_id").alias("id"), "report_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"), (F.lower(F.trim("assertion")) == "present").alias("found")).distinct()
    before = Window.partitionBy("report_id").orderBy("start", "end", "id").rowsBetween(Window.unboundedPreceding, -1)
    new = s.withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    island = new.withColumn("island", F.concat_ws("#", "report_id", F.sum("new").over(Window.partitionBy("report_id").orderBy("start", "end", "id"))))
    return text.matched_intervals(island, "island")


def _ages_sql(pattern: str) -> str:
    zipped = f"list_zip(regexp_extract_all(n, '{pattern}', 1), regexp_extract_all(n, '{pattern}', 2))"
    parsed = f"list_transform({zipped}, lambda x: [x[1]::INT, coalesce(try_cast(nullif(x[2], '') AS INT), 0)])"
    return f"list_filter({parsed}, lambda x: x[1] BETWEEN 10 AND 45 AND x[2] BETWEEN 0 AND 6)[1]"


@query(
    f"""WITH t AS (SELECT doc_id, {base.normal_sql('text')} AS n FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, coalesce({_ages_sql('(?:^|[^0-9])([0-9]{1,2}) *tuan(?: *([0-9]) *ngay)?\\b')}, {_ages_sql('(?:^|[^0-9])([0-9]{1,2}) *w(?: *[+]? *([0-9]) *d?)?\\b')}) AS x FROM t)
SELECT doc_id, round(x[1] + x[2] / 7, 3) AS weeks FROM f WHERE x IS NOT NULL"""
)
def gestational_age(spark, d):
    """The first gestational age that each document states, in weeks."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", scalars.normalize_text(F.col("text")).alias("n"))
    return t.select("doc_id", clauses.gestational_age(F.col("n")).alias("weeks")).where("weeks is not null")


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT doc_id, '{name}' AS measure, try_cast(replace(regexp_extract(text, '(?i)(?:^|[^0-9])([0-9]+(?:[.,][0-9]+)?)[\\s\\p{{Z}}]*{unit}[\\s\\p{{Z}}]*(?:$|[^\\p{{L}}\\p{{N}}_])', 1), ',', '.') AS DOUBLE) AS value FROM documents WHERE text IS NOT NULL) WHERE value IS NOT NULL"
        for unit, name in clauses.MEASURES.items()
    )
)
def measurement_extract(spark, d):
    """The first measurement of each kind in each document."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.explode(clauses.measurement_map(F.col("text"))).alias("measure", "value"))


_ASKED = "WITH asked AS (SELECT id || '/where' AS query_id, regexp_extract(lower(en), ' of the ([a-z ]+)$', 1) AS query FROM hpo_catalog_vi UNION ALL SELECT id || '/what', array_to_string(string_split(vi, ' ')[1:2], ' ') FROM hpo_catalog_vi UNION ALL SELECT id || '/id', lower(id) FROM hpo_catalog_vi)"


@query(
    f"""{_ASKED},
q AS (SELECT query_id, upper(trim(query)) AS asked, {base.normal_sql('query')} AS q FROM asked WHERE query IS NOT NULL),
dq AS (SELECT DISTINCT asked, q FROM q WHERE q <> ''),
c AS (SELECT DISTINCT id, coalesce({base.normal_sql('vi')}, '') AS vi, coalesce({base.normal_sql('en')}, '') AS en, coalesce({base.normal_sql('synonyms')}, '') AS syn FROM hpo_catalog_vi WHERE id IS NOT NULL),
p AS (SELECT asked, q, id, length(vi) AS len, CASE WHEN id = asked THEN -10 WHEN q = vi THEN 0 WHEN q = en THEN 1 WHEN contains(' ' || vi || ' ', ' ' || q || ' ') THEN 2
  WHEN len(list_filter(string_split(q, ' '), lambda x: NOT starts_with(vi, x) AND NOT contains(vi, ' ' || x))) = 0 THEN 3 WHEN contains(en, q) OR starts_with(id, asked) THEN 4 WHEN contains(syn, q) THEN 5 END AS score FROM dq CROSS JOIN c),
m AS (SELECT asked, q, id, min(score) AS score, min(len) AS len FROM p WHERE score IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY asked, q ORDER BY score, len, id) AS rank FROM m)
SELECT query_id, id, score, rank FROM r JOIN q ON q.asked = r.asked AND q.q = r.q WHERE rank <= 20"""
)
def catalog_search(spark, d):
    """The catalogue searched for each entry's place in English, the first two words of its Vietnamese name, and its id."""
    cat = table(spark, d, "hpo_catalog_vi")
    ask = lambda kind, query: cat.select(F.concat("id", F.lit(f"/{kind}")).alias("query_id"), query.alias("query"))
    queries = ask("where", F.regexp_extract(F.lower("en"), r" of the ([a-z ]+)$", 1)).unionByName(ask("what", F.array_join(F.slice(F.split("vi", " "), 1, 2), " "))).unionByName(ask("id", F.lower("id")))
    return text.catalog_search(queries, cat)


_SHEET = f"""WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY received_at DESC NULLS LAST, mention_text, span_end) AS n FROM phenotype_mention WHERE mention_id IS NOT NULL) WHERE n = 1),
sheet AS (SELECT report_id, mention_id, row_number() OVER (PARTITION BY report_id ORDER BY span_start NULLS LAST, mention_id) AS item, hpo_id, {_STATUS} AS status,
  CASE WHEN lower(trim(subject)) IN ('fetus', 'thai_nhi') THEN 'fetus' WHEN lower(trim(subject)) = 'mother' THEN 'mother' WHEN lower(trim(subject)) = 'family_history' THEN 'family' ELSE 'unknown' END AS subject,
  CASE WHEN coalesce(needs_review, true) THEN 'review' ELSE 'accept' END AS action FROM one)
"""


@query(_SHEET + "SELECT report_id, mention_id, item, status, subject, action FROM sheet")
def review_sheet(spark, d):
    return review.review_sheet(table(spark, d, "phenotype_mention")).select("report_id", "mention_id", "item", "status", "subject", "action")


@query(
    _SHEET
    + "SELECT report_id, CASE WHEN hpo_id IS NULL OR status IS NULL THEN 'ignored' WHEN subject = 'fetus' THEN 'observation' ELSE 'context' END AS target, count(*) AS n FROM sheet GROUP BY ALL"
)
def handoff_split(spark, d):
    return review.handoff_counts(review.review_sheet(table(spark, d, "phenotype_mention")))


@query(
    f"""WITH e AS (SELECT DISTINCT report_id AS case_id, hpo_id AS term, {_STATUS} AS status, observed_at AS seen_at, mention_id AS seq FROM phenotype_mention WHERE report_id IS NOT NULL AND hpo_id IS NOT NULL AND mention_id IS NOT NULL),
ok AS (SELECT *, first_value(status) OVER (PARTITION BY case_id, term ORDER BY seen_at NULLS FIRST, seq) AS kept FROM e WHERE status IS NOT NULL)
SELECT case_id, term, kept AS status, count(*) AS sources, (sum((status = kept)::INT) - 1)::BIGINT AS duplicates, sum((status <> kept)::INT)::BIGINT AS conflicts FROM ok GROUP BY ALL"""
)
def selection_state_fold(spark, d):
    m = table(spark, d, "phenotype_mention").where("mention_id is not null")
    events = m.select(F.col("report_id").alias("case_id"), F.col("hpo_id").alias("term"), scalars.normalize_status(F.col("assertion")).alias("status"), F.col("observed_at").alias("at"), F.col("mention_id").alias("seq")).distinct()
    return review.selection_state(events)


@query(
    "WITH "
    + base.PROFILES
    + """, golds AS (SELECT DISTINCT case_id, upper(trim(unnest(gold_disease_ids))) AS profile_id FROM calibration_case WHERE case_id IS NOT NULL),
ids AS (SELECT profile_id, row_number() OVER (ORDER BY substr(sha256(profile_id), 1, 2), profile_id) - 1 AS at FROM (SELECT DISTINCT profile_id FROM annot)),
total AS (SELECT count(*) AS n FROM ids),
draws AS (SELECT case_id, ('0x' || substr(sha256('17|' || case_id || '|' || d), 1, 8))::BIGINT % n AS at, min(d) AS draw FROM (SELECT DISTINCT case_id FROM golds) CROSS JOIN range(400) r(d) CROSS JOIN total GROUP BY 1, 2),
kept AS (SELECT d.case_id, i.profile_id, row_number() OVER (PARTITION BY d.case_id ORDER BY draw) AS k FROM draws d JOIN ids i ON i.at = d.at WHERE NOT EXISTS (SELECT 1 FROM golds g WHERE g.case_id = d.case_id AND g.profile_id = i.profile_id)),
firsts AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS drawn FROM kept WHERE k <= 100),
known AS (SELECT g.case_id, count(i.profile_id) AS golds FROM golds g LEFT JOIN ids i ON i.profile_id = g.profile_id GROUP BY 1)
SELECT case_id, profile_id, 1 AS label, 1.0::DOUBLE AS weight FROM golds
UNION ALL SELECT f.case_id, f.profile_id, 0, round((n - k.golds) / drawn, 6) FROM firsts f JOIN known k ON k.case_id = f.case_id CROSS JOIN total"""
)
def negative_sampling(spark, d):
    return splits.sampled_negatives(base.profile_ids(spark, d), _golds(spark, d)).select("case_id", "profile_id", "label", *six("weight"))


@query(
    """SELECT 'family_id' AS kind, family_id AS value, count(DISTINCT split) AS splits FROM calibration_case WHERE family_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'group_id', group_id, count(DISTINCT split) FROM calibration_case WHERE group_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'patient_id', patient_id, count(DISTINCT split) FROM calibration_case WHERE patient_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1"""
)
def split_leakage(spark, d):
    cases = table(spark, d, "calibration_case")
    parts = [splits.crossing(cases, c).select(F.lit(c).alias("kind"), "value", "splits") for c in ("family_id", "group_id", "patient_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """WITH bad AS (SELECT DISTINCT case_id, unnest([CASE WHEN coalesce(len(observations), 0) = 0 THEN 'no observation' END, CASE WHEN coalesce(len(gold_disease_ids), 0) = 0 THEN 'no gold disease' END,
  CASE WHEN reference_standard.source IS NULL THEN 'no reference source' END, CASE WHEN coalesce(lower(trim(review_status)), '') <> 'approved' THEN 'not approved' END, CASE WHEN coalesce(synthetic, false) THEN 'synthetic' END,
  CASE WHEN coalesce(lower(trim(split)), '') NOT IN ('train', 'validation', 'test') THEN 'split spelled otherwise' END]) AS problem FROM calibration_case WHERE case_id IS NOT NULL)
SELECT case_id, problem FROM bad WHERE problem IS NOT NULL"""
)
def case_label_problems(spark, d):
    return splits.label_problems(table(spark, d, "calibration_case"))


@query()
def calibrated_candidates(spark, d):
    """The ten first candidates of each case with a probability from a logistic model fitted on sampled negatives (an iterative fit: no SQL)."""
    features = ["exact", "ancestor", "ic_coverage", "conflict"]
    scored = base.top(spark, d)
    labels = splits.sampled_negatives(base.profile_ids(spark, d), _golds(spark, d))
    rows = labels.join(base.pair_scores(spark, d, labels), ["case_id", "profile_id"])
    model = splits.fit_logistic(rows, features, weight="weight")
    return splits.predicted(scored, model, features).select("case_id", "profile_id", *six("probability"))
