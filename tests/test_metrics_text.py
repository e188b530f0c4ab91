from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from phenorank.functions import scalars
from phenorank.operators import downstream, metrics, review, splits, text


def test_calibration_metrics(spark):
    data = list(zip([0.1, 0.4, 0.35, 0.8, 0.8, 0.05], [0, 0, 1, 1, 0, 0]))
    df = spark.createDataFrame(data, "score double, label int")
    r = metrics.brier_ece(df).collect()[0]
    assert (r.brier, r.ece) == pytest.approx((0.2125, 0.3), abs=1e-9)
    assert metrics.auc(df).collect()[0].auc == pytest.approx(0.6875)
    assert metrics.auc(df.where("label = 1")).collect()[0].auc is None
    bins = metrics.reliability(df).collect()
    assert len(bins) == 10 and sum(b.n for b in bins) == 6
    assert len(metrics.reliability(df.limit(0)).collect()) == 10


def test_threshold_against_search(spark):
    rng = random.Random(3)
    data = [(rng.randrange(20) / 20, rng.randrange(2)) for _ in range(200)]
    pos, neg = sum(y for _, y in data), sum(1 - y for _, y in data)
    key = lambda t: (round((sum(y for s, y in data if s >= t) / pos + sum(1 - y for s, y in data if s < t) / neg) / 2, 10), -abs(t - 0.5), -t)
    got = metrics.best_threshold(spark.createDataFrame(data, "score double, label int")).collect()[0]
    assert got.threshold == max({0.5, *(s for s, _ in data)}, key=key)


def test_ranking_metrics(spark):
    p = spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("A", "y", 3), ("B", "z", 4)], "case_id string, profile_id string, rank int")
    t = spark.createDataFrame([("A", "y"), ("B", "q"), ("C", "x")], "case_id string, profile_id string")
    r = metrics.ranking_metrics(metrics.first_hit(p, t)).collect()[0]
    assert r.cases == 3 and r.top_1 == 0 and r.top_3 == pytest.approx(1 / 3) and r.mrr == pytest.approx(1 / 6)


def test_overlaps_and_matching(spark):
    rng = random.Random(1)
    spans = lambda n: [("R", k, s := rng.randrange(900), s + rng.choice([0, 3, 40, 200])) for k in range(n)]
    a, b = spans(40), spans(40)
    schema = "report string, id bigint, start int, end int"
    edges = metrics.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "report")
    got = sorted((r.left_id, r.right_id) for r in edges.collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[3] > x[2] and y[3] > y[2] and x[2] < y[3] and y[2] < x[3])
    assert got == want
    for seed in range(30):
        rng = random.Random(seed)
        e = [(x, y) for x in range(5) for y in range(5) if rng.random() < 0.35]
        best = max((len(c) for k in range(6) for c in itertools.combinations(e, k) if len({x for x, _ in c}) == k == len({y for _, y in c})), default=0)
        m = text.largest_matching(e)
        assert len(m) == best and set(m) <= set(e) and len({x for x, _ in m}) == len(m) == len({y for _, y in m})


def test_span_matching_without_edges(spark):
    """As large as by augmenting paths over all edges; four thousand spans over one another are no sixteen million edges."""
    for seed in range(60):
        rng = random.Random(seed)
        spans = lambda n: [(s := rng.randrange(30), s + rng.choice([1, 3, 9, 20]), k) for k in range(n)]  # noqa: B023, E731
        a, b = spans(12), spans(12)
        edges = {(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]}
        got = text.largest_span_matching(a, b)
        assert set(got) <= edges and len({x for x, _ in got}) == len(got) == len({y for _, y in got}) == len(text.largest_matching(list(edges)))
    many = spark.range(8000).selectExpr("'R' island", "id", "id start", "id + 9000 end", "id % 2 = 0 found")
    assert text.matched_intervals(many, "island").count() == 4000
    twice = spark.createDataFrame([("R", 1, 0, 5, True), ("R", 1, 6, 9, True), ("R", 2, 0, 5, False), ("R", 3, 6, 9, False), ("S", 4, 0, 1, True)], "island string, id bigint, start int, end int, found boolean")
    assert text.matched_intervals(twice, "island").count() == 1


def test_alignment():
    assert text.align_uniquely("big heart and small heart", ["big", "heart", "small"]) == [(0, 3), (4, 9), (14, 19)]
    assert text.align_uniquely("heart heart", ["heart"]) is None
    assert text.align_uniquely("heartbeat", ["heart"]) is None
    assert text.align_uniquely("a b a", ["a", "b"]) == [(0, 1), (2, 3)]
    assert text.align_uniquely("x", []) == []


def test_scan_and_greedy(spark):
    docs = spark.createDataFrame([(1, "Tight stenosis of the lung, lung. And LUNG!"), (2, None), (3, ""), (4, "stenosis of")], "doc_id bigint, text string")
    lex = spark.createDataFrame([("A", "lung"), ("B", "tight stenosis of the lung"), ("C", "stenosis of the lung"), ("D", None), ("E", "")], "term string, phrase string")
    hits = text.dictionary_scan(docs, lex, "doc_id", "text")
    assert sorted((r.doc_id, r.term, r.first, r.last) for r in hits.collect()) == [(1, "A", 4, 4), (1, "A", 5, 5), (1, "A", 7, 7), (1, "B", 0, 4), (1, "C", 1, 4)]
    assert sorted((r.term, r.first) for r in text.greedy_spans(hits, "doc_id").collect()) == [("A", 5), ("A", 7), ("B", 0)]


def test_text_functions(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).collect()[0].y
    assert one("Đầu NHỎ, x2!", scalars.normalize_text) == "dau nho x2"
    assert one("Tật đầu nhỏ", scalars.group_key) == "dau nho"
    assert one("hp_1234567", scalars.normalize_term_id) == "HP:1234567" and one("HP12", scalars.normalize_term_id) is None
    assert one("mẹ có, chưa thấy", text.cautious_context) is True and one("mẹ. rõ", text.cautious_context) is False
    assert one("ab@c.de", scalars.identifier_hint) and not one("week 12", scalars.identifier_hint)
    assert one("Case_1", scalars.pseudonymous) and not one("A123456789", scalars.pseudonymous)


def test_genes(spark):
    ranks = spark.createDataFrame([("C", "D1", 1), ("C", "D2", 2), ("C", "D3", 3)], "case_id string, profile_id string, rank int")
    rows = [("D1", "G1", "curated"), ("D1", "G1", "curated"), ("D2", "G1", "limited"), ("D2", "G2", "strong"), ("D3", "G2", "candidate"), ("D1", "G2", "moderate"), ("D9", "G3", "strong")]
    a = spark.createDataFrame([(*r, None, None) for r in rows], "profile_id string, gene string, evidence_type string, association_id string, source string")
    judged = downstream.judged_associations(a, ranks)
    assert [(r.gene, round(r.score, 6), r["rank"]) for r in downstream.gene_ranking(judged).orderBy("rank").collect()] == [("G1", 1.075, 1), ("G2", 1.0, 2)]
    assert {r.reason: r.n for r in downstream.exclusion_reasons(judged).collect()} == {"duplicate": 1, "weight_below_gate": 1, "profile_not_ranked": 1}


def test_repeated_before_the_join(spark):
    """Which of a repeated association counts is told by its kind of evidence, once for all cases."""
    ranks = spark.createDataFrame([("C", "D1", 1), ("E", "D1", 2)], "case_id string, profile_id string, rank int")
    schema = "profile_id string, gene string, evidence_type string, association_id string, source string, test_evidence_type string"
    a = spark.createDataFrame([("D1", "G1", "curated", "A", "S", k) for k in ("sequencing", "array")], schema).coalesce(1)
    judged = downstream.judged_associations(a, ranks)
    assert {(r.case_id, r.test_evidence_type, r.reason) for r in judged.collect()} == {(c, k, w) for c in "CE" for k, w in (("array", None), ("sequencing", "duplicate"))}
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_summed_before_the_join(spark):
    """Summed per profile, gene and kind, associations rank the same genes."""
    ranks = spark.createDataFrame([("C", "D1", 1), ("C", "D2", 2), ("E", "D2", 11)], "case_id string, profile_id string, rank int")
    schema = "profile_id string, gene string, evidence_type string, association_id string, source string, test_evidence_type string"
    a = spark.createDataFrame([("D1", "G1", "curated", "A", "S", "array"), ("D1", "G1", "limited", "B", "S", "array"), ("D1", "G1", "limited", "B", "S", "sequencing"), ("D2", "G2", "strong", "A", "S", "array"), ("D2", "G1", "candidate", "A", "S", "array")], schema)
    summed = downstream.explained(a, ranks)
    assert sorted((r.case_id, r.gene, r.times) for r in summed.collect()) == [("C", "G1", 2), ("C", "G2", 1)]
    rows = lambda judged: [(r.case_id, r.gene, round(r.score, 9), r.explanations, r["rank"]) for r in downstream.gene_ranking(judged).orderBy("rank").collect()]
    assert rows(summed) == rows(downstream.judged_associations(a, ranks)) == [("C", "G1", 1.25, 2, 1), ("C", "G2", 0.4, 1, 2)]


def test_features_as_lists(spark):
    positive = spark.createDataFrame([("D", t, f) for t, f in (("b", 0.5), ("a", 0.5), ("c", 0.9), ("d", 0.1))] + [("N", "a", 0.2)], "profile_id string, term string, freq double")
    pairs = spark.createDataFrame([("C", "D"), ("X", "D"), ("C", "N")], "case_id string, profile_id string")
    got = downstream.features_to_check(pairs, positive, spark.createDataFrame([("C", "a"), ("C", "z")], "case_id string, term string"), 3)
    assert sorted((r.case_id, r.profile_id, r.term, r.freq, r.pos) for r in got.collect()) == [
        ("C", "D", "b", 0.5, 2), ("C", "D", "c", 0.9, 1), ("C", "D", "d", 0.1, 3), ("X", "D", "a", 0.5, 2), ("X", "D", "b", 0.5, 3), ("X", "D", "c", 0.9, 1),
    ]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_review(spark):
    sheet = spark.createDataFrame([(1, "HP:0000001", "PRESENT", "fetus"), (2, None, None, "mother"), (3, "HP:0000003", "ABSENT", "mother")], "mention_id bigint, hpo_id string, status string, subject string")
    decisions = spark.createDataFrame([(1, "HP:0000001", "edit", "hp_0000009"), (2, None, "reject", None), (3, "HP:0000007", "accept", None), (9, None, "accept", None)], "mention_id bigint, seen_hpo_id string, action string, new_hpo_id string")
    accepted, refused = review.applied(sheet, decisions)
    assert [(r.mention_id, r.hpo_id) for r in accepted.collect()] == [(1, "HP:0000009")]
    assert {r.mention_id for r in refused.collect()} == {3, 9}
    assert {r.mention_id: r.target for r in review.handoff(sheet).collect()} == {1: "observation", 2: "ignored", 3: "context"}


def test_logistic_fit(spark):
    rng = random.Random(5)
    rows = [(x := rng.gauss(0, 1), rng.gauss(0, 1), int(rng.random() < 1 / (1 + 2.718281828 ** -(2 * x - 0.5)))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    model = splits.fit_logistic(df, ["a", "b"])
    assert model["coefficients"][0] == pytest.approx(2, abs=0.3) and abs(model["coefficients"][1]) < 0.2
    assert splits.fit_logistic(df.where("label = 1"), ["a", "b"])["coefficients"] == [0.0, 0.0]
    assert splits.fit_logistic(df.limit(0), ["a", "b"])["intercept"] == 0.0
