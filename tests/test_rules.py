"""Rules over clauses, phrases with offsets, and the smaller operators, against worked examples and plain search."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from phenorank.functions import scalars
from phenorank.operators import annotations, clauses, metrics, ontology, text


@pytest.fixture(scope="module")
def ask(spark):
    def run(function, values):
        df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, x string")
        return [r.y for r in df.select("n", function(F.col("x")).alias("y")).orderBy("n").collect()]

    return run


def test_assertions(ask):
    said = {
        "khong loai tru gian nao that": ("SUSPECTED", "khong loai tru"), "loai tru gian nao that": ("ABSENT", "loai tru"), "khong co the chai": ("ABSENT", "khong co"), "gian nao that": ("PRESENT", None),
        "khong thay ro tim": ("NOT_ASSESSED", "khong thay ro"), "khong quan sat duoc va khong khao sat duoc": ("NOT_ASSESSED", "khong khao sat duoc"), "theo doi, khong thay": ("ABSENT", "khong thay"), "": ("PRESENT", None), "nghiem trong": ("PRESENT", None),
    }
    assert [tuple(r) for r in ask(clauses.assertion, said)] == list(said.values())
    assert tuple(ask(clauses.assertion, [None])[0]) == ("PRESENT", None)


def test_subjects_and_attributes(ask):
    who = {"tien su gia dinh thai nhi": "family_history", "thai nhi co me bi sot": "fetus", "me bi sot o thai": "mother", "tren thai co": "fetus", "x": "fetus", "fetalis": "fetus"}
    got = ask(clauses.subject, who)
    assert [r.subject for r in got] == list(who.values()) and got[4].rule == got[5].rule == "prenatal_fetus_default" and got[3].rule == "fetal_context_rule"
    assert ask(clauses.laterality, ["than trai hai ben", "ben trai va ben phai", "right sided", "mot ben", "x", None]) == ["bilateral", "left", "right", "unilateral", None, None]
    assert ask(clauses.severity, ["rat nang", "trung binh nhe", "nhe", "x"]) == ["severe", "moderate", "mild", None]
    assert ask(clauses.distribution, ["focal", "lan toa focal", ""]) == ["focal", "diffuse", None] and ask(clauses.progression, ["on dinh", "tien trien", ""]) == ["stable", "progressive", None]
    assert ask(lambda x: clauses.method(x, F.lit("mri")), ["sieu am", "sieu am mri", "x"]) == ["ultrasound", "mri", "mri"]


def test_numbers(ask):
    age = {"thai 22 tuan 3 ngay": 22.429, "22 tuan": 22.0, "9 tuan 24w+2d": 24.286, "46 tuan": None, "30 w 7": None, "tuan 22": None, "122 tuan": None, "12w": 12.0, "": None, "20w 25 tuan": 25.0}
    assert ask(clauses.gestational_age, age) == pytest.approx(list(age.values()), abs=1e-9)
    got = ask(clauses.measurement_map, ["rộng 3,5 mm, 4 mm; 12cm và 5 mmol, 140 bpm 20% 1.2.5 kg", "", None])
    assert got == [{"width_mm": 3.5, "length_cm": 12.0, "heart_rate_bpm": 140.0, "percent": 20.0, "weight_kg": 2.5}, {}, {}]
    scores = lambda *s: F.array(*[F.lit(x) for x in s]).cast("array<double>")
    decide = lambda s, status="PRESENT": tuple(ask(lambda x: clauses.link_decision(s, F.lit(status)), [""])[0])
    assert decide(scores(0.9, 0.5)) == (False, False, False) and decide(scores(0.9, 0.86)) == (True, True, True) and decide(scores(0.54)) == (True, False, True)
    assert decide(scores(0.7)) == (False, False, True) and decide(scores(0.9), "ABSENT") == (False, False, True) and decide(scores()) == (True, False, True)


def test_cues(spark):
    rows = [("theo dõi giãn", ""), ("td", ""), ("tddx", ""), ("giãn 1 phần", ""), ("giãn", "nghi ngờ "), ("giãn", "nghi ngờ. "), ("giãn", "t/d: "), ("nghiêng", None), (None, None), ("THIỂU SẢN MỘT  PHẦN", "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, m string, l string")
    got = [tuple(r.c) for r in df.select("k", text.cue_assertion(scalars.nfc(F.col("m")), F.col("l")).alias("c")).orderBy("k").collect()]
    S, P = "SUSPECTED", ("PRESENT", None, None)
    # a slash is a delimiter of contexts, so t/d counts inside a mention only
    assert got == [(S, "theo dõi", "mention"), (S, "td", "mention"), P, (S, "1 phần", "mention"), (S, "nghi ngờ", "context"), P, P, P, P, (S, "MỘT  PHẦN", "mention")]


def test_phrase_mentions(spark):
    lex = spark.createDataFrame([("A", "giãn não thất"), ("B", "não thất"), ("C", "não thất"), ("D", "thể chai"), ("E", "không có thể chai"), (None, "x"), ("F", None), ("G", " ")], "term string, phrase string")
    docs = [(1, "Thai có GIÃN được não  thất nặng, không có thể chai."), (2, "não thất nhưng giãn có có có não thất"), (3, None), (4, ""), (None, "não thất"), (5, "x " * 20_000 + "thể chai")]
    got = clauses.phrase_mentions(spark.createDataFrame(docs, "doc_id bigint, text string"), lex, "doc_id", "text").orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.mention, r.terms, r.clause) for r in got] == [
        (None, "não thất", ["B", "C"], "não thất"), (1, "GIÃN được não  thất", ["A"], "Thai có GIÃN được não  thất nặng"), (1, "không có thể chai", ["E"], " không có thể chai"),
        (2, "não thất", ["B", "C"], "não thất "), (2, "não thất", ["B", "C"], " giãn có có có não thất"), (5, "thể chai", ["D"], docs[5][1]),
    ]
    texts = dict(docs)
    assert all(texts[r.doc_id][r.start : r.end] == r.mention and r.clause.startswith(r.before) for r in got)
    assert clauses.phrase_mentions(spark.createDataFrame(docs, "doc_id bigint, text string").limit(0), lex, "doc_id", "text").count() == 0


def test_longest_phrases_against_search():
    rng = random.Random(5)
    phrases = {tuple(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(25)}
    known = clauses.Phrases([("T", " ".join(p)) for p in phrases])
    for _ in range(300):
        words = rng.choices("abcde", k=12)
        for start in range(12):
            best = max((n for n in range(1, 13 - start) if tuple(words[start : start + n]) in phrases), default=None)
            hit = known.longest([(w, 0, 0) for w in words], start)
            assert (hit[0] - start if hit else None) == best


def test_smaller_operators(spark):
    closed = spark.createDataFrame([("a", "a", 0), ("a", "r", 1), ("r", "r", 0)], "term string, anc string, dist int")
    assert {r.term: r.ancestors for r in ontology.ancestor_sets(closed).collect()} == {"a": ["a", "r"], "r": ["r"]}
    assert {r.term: r.ancestors for r in ontology.ancestor_sets(closed, False).collect()} == {"a": ["r"]}
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("j", 5, "c")], "key string, n int, v string")
    assert {tuple(r) for r in ontology.first_seen(rows, ["key"], ["n"]).collect()} == {("k", 1, "z"), ("j", 5, "c")}
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0].x
    assert one(scalars.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0)))) == pytest.approx(1000 + math.log(2))
    assert json.loads(one(scalars.strip_json(F.lit('```json\n{"a": {"b": 1}}\n``` done')))) == {"a": {"b": 1}} and one(scalars.strip_json(F.lit("none"))) is None
    facts = [("p", "n", "t", False, "percent", 0.4, None, None), ("p", "n", "t", False, "ratio", 0.5, 1.0, 2.0), ("p", "n", "t", True, "missing", 0.9, None, None)]
    df = spark.createDataFrame(facts, "profile_id string, profile_name string, term string, negated boolean, kind string, probability double, numerator double, denominator double")
    assert annotations.annotation_for(df, False).collect()[0].kind == "ratio" and annotations.annotation_for(df, True).collect()[0].kind == "missing"
    texts = spark.createDataFrame([(1, "big heart"), (2, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in text.extract_with(texts, "doc_id", "text", lambda t: ["heart", "lung", ""]).collect()] == [(1, "heart")]


def test_span_scores(spark):
    samples = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", None), ("a", False)], "k string, failed boolean")
    gold = spark.createDataFrame([("a", 0, 5), ("a", 0, 5), ("a", 10, 20), ("b", 1, 2), ("c", 0, 9)], "k string, start int, end int")
    pred = spark.createDataFrame([("a", 0, 5), ("a", 10, 14), ("a", 15, 20), ("b", 1, 2), ("c", 0, 9), ("x", 0, 1)], "k string, start int, end int")
    r = metrics.span_scores(samples, gold, pred, "k").collect()[0]
    assert (r.samples, r.invalid_outputs, r.tp, r.fp, r.fn, r.fragmented) == (4, 1, 2, 2, 2, 1) and (r.exact_rate, r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5, 0.5)
    none = metrics.span_scores(samples.limit(0), gold, pred, "k").collect()[0]
    assert (none.samples, none.tp, none.f1, none.fragmented) == (0, 0, 0.0, 0)


def test_catalog_search(spark):
    cat = spark.createDataFrame([("HP:0000001", "Giãn não thất", "Dilation of ventricle", "não to"), ("HP:0000002", "Não thất giãn nhẹ", "Ventricle, mild", None), ("HP:0000003", None, "Heart", "ventricular heart"), (None, "x", "x", "x")], "id string, vi string, en string, synonyms string")
    q = spark.createDataFrame([(1, "giãn não thất"), (2, "hp:0000002"), (3, "ventric"), (4, "nã th"), (5, ""), (6, None), (7, "heart"), (8, "v")], "query_id int, query string")
    got: dict[int, list] = {}
    for r in text.catalog_search(q, cat).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id[-1], r.score))
    in_text = [("1", 4), ("2", 4), ("3", 5)]
    assert got == {1: [("1", 0), ("2", 3)], 2: [("2", -10)], 3: in_text, 4: [("1", 3), ("2", 3)], 7: [("3", 1)], 8: in_text}
