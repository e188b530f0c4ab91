"""The worked example: four profiles over a small ontology, checked against values computed by hand."""

from __future__ import annotations

import pytest

from phenorank.functions.scalars import EPSILON
from phenorank.operators import annotations, downstream, observations, ontology, probability, ranking
from phenorank.session import written

H = "HP:"
LINKS = [
    ("HP:0000118", "HP:0000001"), ("HP:1000001", "HP:0000118"), ("HP:1000002", "HP:0000118"), ("HP:1000011", "HP:1000001"), ("HP:1000012", "HP:1000001"),
    ("HP:1000021", "HP:1000002"), ("HP:1000111", "HP:1000011"), ("HP:1000111", "HP:1000021"), ("HP:1000112", "HP:1000011"),
]
POSITIVE = [("DX:1", "HP:1000111", 0.9), ("DX:1", "HP:1000012", 0.5), ("DX:2", "HP:1000011", 0.545), ("DX:3", "HP:1000021", 0.3), ("DX:3", "HP:1000112", 0.25), ("DX:4", "HP:1000002", 0.17)]
OBS = [("C", 0, "HP:1000112", "PRESENT", 1.0), ("C", 1, "HP:1000012", "SUSPECTED", 0.5), ("C", 2, "HP:1000021", "ABSENT", 1.0)]
WANT = {
    "DX:1": (0.333333, 0.333333, 0.530832, 0.9, -2.856876, -3.149793, 0.0),
    "DX:2": (0.0, 0.666667, 0.296248, 0.020807, -0.425618, -0.226432, 0.289575),
    "DX:3": (0.666667, 0.666667, 0.765416, 0.3, -1.235942, -0.844900, 0.561104),
    "DX:4": (0.0, 0.0, 0.029170, 0.087526, -9.586973, -9.638032, 0.0),
}
EVIDENCE = {
    ("DX:1", 0): ("semantic", "HP:1000111", 2, 0.296248, 0.066748, -1.502851),
    ("DX:1", 2): ("profile_descendant", "HP:1000111", 1, 1.0, 0.9, -1.609438),
    ("DX:2", 0): ("profile_ancestor", "HP:1000011", 1, 0.296248, 0.272550, -0.095960),
    ("DX:2", 2): ("semantic", "HP:1000011", 6, 0.152003, 0.020807, 0.672121),
    ("DX:3", 1): ("semantic", "HP:1000112", 3, 0.296248, 0.018608, -2.780185),
    ("DX:4", 0): ("profile_absent_profile_ancestor", "HP:1000011", 1, 0.0, EPSILON, -8.006368),
    ("DX:4", 2): ("profile_ancestor", "HP:1000002", 1, 0.514573, 0.087526, 0.601552),
}


@pytest.fixture(scope="module")
def toy(spark):
    links = spark.createDataFrame(LINKS, "child string, parent string")
    nodes = spark.createDataFrame(sorted({(x,) for pair in LINKS for x in pair}), "hpo_id string")
    closed = ontology.closed(nodes, links)
    positive = spark.createDataFrame(POSITIVE, "profile_id string, term string, freq double")
    negative = spark.createDataFrame([("DX:4", "HP:1000011")], "profile_id string, term string")
    df = ontology.document_frequency(positive, closed)
    stats = ontology.information_content(nodes.withColumnRenamed("hpo_id", "term"), df, 4, root="HP:0000118")
    obs = spark.createDataFrame(OBS, "case_id string, ord int, term string, status string, w double")
    skip, root, ic = ontology.trunk(closed, stats, "HP:0000118")
    assert sorted(skip) == ["HP:0000001", "HP:0000118"] and root == "HP:0000001" and ic == pytest.approx(0.105361, abs=1e-6)
    sim = ontology.term_similarity(obs.select("term"), positive.select("term").union(negative.select("term")), closed, stats, skip)
    profiles = spark.createDataFrame([(f"DX:{k}",) for k in range(1, 6)], "profile_id string")  # the last has no term at all
    engine = (obs, ranking.known_matches(obs, sim, positive, negative), *ranking.root_matches(closed, positive, profiles, root, ic), stats, ic)
    pairs = profiles.where("profile_id <> 'DX:5'").selectExpr("'C' case_id", "profile_id")
    rows = ranking.evidence(pairs, *engine)
    return dict(links=links, nodes=nodes, closed=closed, stats=stats, obs=obs, rows=rows, scores=ranking.scores(obs, rows, stats), engine=engine, pairs=pairs)


def test_information_content(toy):
    ic = {r.term: r.ic for r in toy["stats"].collect()}
    assert ic["HP:0000001"] == pytest.approx(0.105361, abs=1e-6) and ic["HP:0000118"] == pytest.approx(0.0001, abs=1e-7)
    assert ic["HP:1000011"] == pytest.approx(0.356675, abs=1e-6) and ic["HP:1000021"] == pytest.approx(0.693147, abs=1e-6)


def test_scores(toy):
    got = {r.profile_id: r for r in toy["scores"].collect()}
    for profile, want in WANT.items():
        r = got[profile]
        assert (r.exact, r.ancestor, r.ic_coverage, r.conflict, r.log_likelihood, r.score, r.compatibility) == pytest.approx(want, abs=2e-6), profile


def test_evidence(toy):
    got = {(r.profile_id, r.ord): r for r in toy["rows"].collect()}
    for key, (relation, term, dist, sim, p, llr) in EVIDENCE.items():
        r = got[key]
        assert (r.relation, r.matched_term, r.distance) == (relation, term, dist), key
        if not relation.startswith("profile_absent"):
            assert r.sim == pytest.approx(sim, abs=1e-6)
        assert (r.probability, r.llr) == pytest.approx((p, llr), abs=2e-6), key


def test_orders_and_limits(toy):
    order = lambda s: [r.profile_id for r in ranking.ranked(toy["scores"], s, None).orderBy("rank").collect()]
    assert order("IC_COVERAGE") == ["DX:3", "DX:1", "DX:2", "DX:4"]
    assert order("LIKELIHOOD_SCORE") == ["DX:2", "DX:3", "DX:1", "DX:4"]
    assert ranking.ranked(toy["scores"], top_k=0).count() == 0
    with pytest.raises(ValueError):
        ranking.ranked(toy["scores"], top_k=-1)


@pytest.mark.parametrize("blocks", [(4096, 1024), (2, 1)])
def test_blocks(spark, toy, monkeypatch, blocks):
    """Scored in blocks, all profiles have the scores that they have one by one."""
    monkeypatch.setattr(ranking, "BLOCK_PROFILES", blocks[0])
    monkeypatch.setattr(ranking, "BLOCK_CASES", blocks[1])
    obs, *rest = toy["engine"]
    more = obs.unionByName(obs.selectExpr("'B' case_id", "ord", "term", "'ABSENT' status", "w")).unionByName(obs.where("ord = 0").selectExpr("'N' case_id", "ord", "term", "'NOT_ASSESSED' status", "w"))
    for strategy, want in (("IC_COVERAGE", ["DX:3", "DX:1", "DX:2", "DX:4", "DX:5"]), ("LIKELIHOOD_SCORE", ["DX:2", "DX:3", "DX:1", "DX:4", "DX:5"])):
        got = ranking.top_profiles(more, *rest, strategy=strategy).collect()
        assert [r.profile_id for r in sorted(got, key=lambda r: r["rank"]) if r.case_id == "C"] == want
        assert sorted({r.case_id for r in got}) == ["B", "C", "N"] and len(got) == 15
        for r in got:
            if r.case_id == "C" and r.profile_id in WANT:
                assert (r.exact, r.ancestor, r.ic_coverage, r.conflict, r.log_likelihood, r.score, r.compatibility) == pytest.approx(WANT[r.profile_id], abs=2e-6)
        assert all(r.score == 0 for r in got if r.case_id == "N") and [r.profile_id for r in sorted(got, key=lambda r: r["rank"]) if r.case_id == "N"][0] == "DX:5"
        pairs = toy["pairs"].unionByName(spark.createDataFrame([("C", "DX:9"), ("Z", "DX:1"), ("N", "DX:1")], "case_id string, profile_id string"))
        assert {(r.case_id, r.profile_id): r["rank"] for r in ranking.places(pairs, more, *rest, strategy=strategy).collect()} == {("C", p): k + 1 for k, p in enumerate(want[:4])} | {("N", "DX:1"): 5}
        assert {r.profile_id for r in ranking.top_profiles(more, *rest, strategy=strategy, top_k=1).where("case_id = 'C'").collect()} == {want[0]}
    concepts = spark.createDataFrame([("DX:3", "X"), ("DX:1", "X"), ("DX:4", "Y"), ("DX:5", "Y")], "profile_id string, concept_id string")
    got = ranking.top_profiles(*toy["engine"], top_k=2, concepts=concepts).orderBy("rank").collect()
    assert [(r.concept_id, r.profile_id) for r in got] == [("X", "DX:3"), ("DX:2", "DX:2")]
    assert ranking.top_profiles(more.limit(0), *rest).count() == 0
    alone = ranking.evidence(toy["pairs"].selectExpr("case_id", "'DX:5' profile_id").distinct(), *toy["engine"]).collect()
    assert {r.relation for r in alone} == {"no_match"} and {r.matched_term for r in alone} == {None}


def test_matches_are_packed(toy, monkeypatch):
    """A block has so many profiles as its matrices allow, and a term's matches in it are one row."""
    import pyarrow as pa

    monkeypatch.setattr(ranking, "BLOCK_CELLS", 6)  # three terms: two profiles
    seen = {r.profile_id: r["rank"] for r in ranking.top_profiles(*toy["engine"]).collect()}
    assert seen == {"DX:3": 1, "DX:1": 2, "DX:2": 3, "DX:4": 4, "DX:5": 5}
    rows = pa.table({"no": pa.array([1, 0, 1], pa.int32()), "at": pa.array([0, 1, 1], pa.int32()), "probability": [0.1, 0.2, 0.3], "sim": [1.0, 0.5, 0.25], "flags": pa.array([7, 4, 4], pa.int8())})
    assert ranking._packed((pa.scalar(0),), rows).num_rows == 2


def test_only_the_final_rows_leave_a_task(spark, toy, monkeypatch):
    """Blocks of profiles meet in the task that has the case: nothing is ranked or shuffled again after it."""
    monkeypatch.setattr(ranking, "BLOCK_CELLS", 3)  # a profile a block
    concepts = spark.createDataFrame([("DX:3", "X"), ("DX:1", "X"), ("DX:4", "Y"), ("DX:5", "Y")], "profile_id string, concept_id string")
    for options, want in (({}, ["DX:3", "DX:1"]), ({"strategy": "LIKELIHOOD_SCORE"}, ["DX:2", "DX:3"]), ({"concepts": concepts}, ["DX:3", "DX:2"])):
        got = ranking.top_profiles(*toy["engine"], top_k=2, **options)
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert [(r["rank"], r.profile_id) for r in got.orderBy("rank").collect()] == list(enumerate(want, 1))


def test_matches_that_share_their_values_are_runs():
    import pyarrow as pa

    rows = pa.table({"no": pa.array([1, 0, 1, 1], pa.int32()), "at": pa.array([0, 1, 1, 2], pa.int32()), "probability": [0.1, 0.2, 0.3, 0.1], "sim": [1.0, 0.5, 0.25, 1.0], "flags": pa.array([7, 4, 4, 7], pa.int8())})
    got = ranking._packed((pa.scalar(0),), rows).to_pylist()
    assert [(r["no"], len(r["ats"]), len(r["times"]), len(r["probabilities"])) for r in got] == [(0, 2, 2, 8), (1, 6, 4, 16)]
    assert ranking._packed((pa.scalar(0),), rows.slice(0, 0)).num_rows == 0


def test_evidence_shuffles_wide_rows_once(spark, toy):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        obs, known, by_term, by_profile, stats, ic = toy["engine"]
        by_profile = written(by_profile, "by_profile")[0]
        plan = ranking.evidence(toy["pairs"], obs, known, by_term, by_profile, stats, ic)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("BroadcastHashJoin") == 2


def test_common_ancestors_within_profiles(spark, toy):
    """The same as pair by pair, without a row per pair and ancestor."""
    rows = spark.createDataFrame([*[(p, t) for p, t, _ in POSITIVE], ("DX:6", "HP:1000112"), ("DX:6", "HP:1000111"), ("DX:6", "HP:1000021"), ("DX:6", "HP:9999999")], "profile_id string, term string")
    b = rows.select("profile_id", rows.term.alias("b"))
    pairs = rows.withColumnRenamed("term", "a").join(b, "profile_id").where("a < b").select("a", "b").distinct()
    want = {tuple(r) for r in ontology.mica(pairs, toy["closed"], toy["stats"]).collect()}
    got = ontology.mica_within(rows, "profile_id", toy["closed"], toy["stats"]).select("a", "b", "mica", "ic").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 4
    assert {(r.a, r.b): r.mica for r in got}["HP:1000111", "HP:1000112"] == "HP:1000011"


def test_report_has_no_row_per_profile_and_term(spark, toy):
    obs, positive = toy["obs"], spark.createDataFrame(POSITIVE, "profile_id string, term string, freq double")
    ranks = toy["scores"].withColumn("rank", ranking.F.lit(1))
    facts, modes = spark.createDataFrame([("DX:1", "one", None)], "profile_id string, name string, gene string"), spark.createDataFrame([], "profile_id string, modes string")
    got = downstream.match_report(ranks, toy["rows"].where("ord = 2"), positive, obs, facts, modes)
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.profile_id: r.to_check for r in got.collect()} == {"DX:1": "HP:1000111", "DX:2": "HP:1000011", "DX:3": "", "DX:4": "HP:1000002"}


def test_sanitation(spark, toy):
    def rows(*pairs):
        data = [("C", n, t, s, "fetus", None, None, None, None, None) for n, (t, s) in enumerate(pairs)]
        names = "case_id string, ord int, term string, status string, subject string, reviewer_status string, extraction_confidence double, linking_confidence double, assertion_certainty double, gestational_age_weeks double"
        return spark.createDataFrame(data, names)

    clean = lambda *pairs: sorted((r.term, r.status) for r in observations.sanitized(rows(*pairs), toy["closed"], "HP:0000118").collect())
    assert clean(("HP:1000112", "PRESENT"), ("HP:1000112", "SUSPECTED")) == [("HP:1000112", "PRESENT")]
    assert clean(("HP:1000001", "PRESENT"), ("HP:1000011", "PRESENT")) == [("HP:1000011", "PRESENT")]
    assert clean(("HP:1000001", "PRESENT"), ("HP:1000011", "SUSPECTED")) == [("HP:1000001", "PRESENT"), ("HP:1000011", "SUSPECTED")]
    assert clean(("HP:1000001", "ABSENT"), ("HP:1000011", "PRESENT")) == []
    why = lambda *pairs: observations.abstentions(rows(*pairs), toy["closed"], toy["stats"], "HP:0000118").collect()[0].reason
    assert why(("HP:1000001", "ABSENT"), ("HP:1000011", "PRESENT")) == "UNRESOLVED_CONTRADICTION"
    assert why(("HP:0000118", "PRESENT")) == "ONLY_ROOT_PHENOTYPE"
    assert why(("HP:1000011", "NOT_ASSESSED")) == "ALL_NOT_ASSESSED"
    assert why(("HP:1000011", "ABSENT")) == "NO_POSITIVE_OBSERVATION"
    assert why(("HP:9999999", "PRESENT")) == "UNKNOWN_TERM_ID"
    assert why(("HP:1000112", "PRESENT")) is None


def test_frequency_texts(spark):
    from pyspark.sql import functions as F

    cases = {
        "HP:0040281": ("category", 0.9), "HP:0040285": ("category", 0.0), "Very rare": ("category", 0.025), "infrequent": ("category", 0.545), "45%": ("percent", 0.45), "150%": ("percent", 1.0),
        "7/13": ("ratio", 0.538462), "0/12": ("ratio", 0.0), "3/0": ("missing", 0.5), "0.2": ("numeric", 0.2), "12": ("numeric", 0.12), "": ("missing", 0.5), "abc": ("missing", 0.5), "inf": ("missing", 0.5),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "frequency_raw string")
    got = {r.frequency_raw: r for r in annotations.with_frequency(df).collect()}
    for k, (kind, p) in cases.items():
        assert got[k].kind == kind and got[k].probability == pytest.approx(p, abs=1e-6), k
    assert got[None].kind == "missing"
    smooth = spark.range(1).select(annotations.resolved_frequency(F.lit("ratio"), F.lit(0.5), F.lit(7.0), F.lit(13.0), F.lit(0.1), F.lit(False)).alias("p")).collect()[0].p
    assert smooth == pytest.approx(0.535714, abs=1e-6)


def test_probabilities(spark):
    from pyspark.sql import functions as F

    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0].x
    assert one(probability.binary_posterior(F.lit(0.01), F.lit(2.0))) == pytest.approx(0.069453, abs=1e-6)
    assert one(probability.binary_posterior(F.lit(0.2), F.lit(-1.5))) == pytest.approx(0.052835, abs=1e-6)
    assert one(probability.binary_posterior(F.lit(None).cast("double"), F.lit(1.0))) is None
    assert one(probability.bounded_llr(F.lit(0.9), F.lit(0.05), F.lit(False))) == pytest.approx(2.890372, abs=1e-6)
    assert one(probability.bounded_llr(F.lit(0.9), F.lit(0.05), F.lit(True))) == pytest.approx(-2.251292, abs=1e-6)
    capped = spark.createDataFrame([("P", "g", 5.0), ("P", "g", 5.0), ("P", None, 1.0)], "profile_id string, group_id string, contribution double")
    assert probability.group_capped(capped, ["profile_id"]).collect()[0].llr == 9.0
    pool = spark.createDataFrame([("C", "A", 0.01, 2.0), ("C", "B", 0.02, -1.0), ("C", "X", None, 9.0)], "case_id string, profile_id string, prior double, llr double")
    got = {r.profile_id: r.posterior for r in probability.single_cause(pool).collect()}
    # the unknown class takes what the priors leave, at most 0.95
    import math

    weights = {"A": 0.01 * math.exp(2), "B": 0.02 * math.exp(-1), probability.UNKNOWN: 0.95}
    assert got == pytest.approx({k: v / sum(weights.values()) for k, v in weights.items()}, abs=1e-9)
