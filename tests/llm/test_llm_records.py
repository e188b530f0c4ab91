from __future__ import annotations

import random

from phenorank.llm import grouping, overlap

CASE = (
    "case_id string, patient_id string, family_id string, group_id string, split string, observations array<struct<hpo_id string, status string>>, gold_disease_ids array<string>,"
    " reference_standard struct<source string>, codes int, cls int"
)


def case(id_, split, obs, gold=("DX:1",), ties=(None, None, None), source="S"):
    return (id_, *ties, split, None if obs is None else [tuple(o) for o in obs], None if gold is None else list(gold), (source,), 0, 0)


def test_block_keys_lose_no_pair(spark):
    """Every pair with Jaccard of at least three quarters, of sets from one to sixty features, shares a key."""
    rng = random.Random(11)
    rows, sets = [], {}
    for k in range(160):
        base = [f"F{rng.randrange(5000)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 12, 15, 30, 60]))]
        for v in range(2):
            keep = set(base)
            if v:
                for _ in range(rng.randrange(0, len(base) // 4 + 1)):
                    if rng.random() < 0.5 and len(keep) > 1:
                        keep.discard(rng.choice(sorted(keep)))
                    else:
                        keep.add(f"G{rng.randrange(5000)}")
            sets[2 * k + v] = keep
            rows.append((2 * k + v, "g", sorted(keep)))
    keys: dict[int, set[int]] = {}
    for r in overlap.block_keys(spark.createDataFrame(rows, "cls bigint, gold string, features array<string>")).collect():
        keys.setdefault(r.cls, set()).add(r.key)
    near = [(a, b) for a in sets for b in sets if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    assert len(near) > 60
    for a, b in near:
        assert keys[a] & keys[b], (sets[a], sets[b])


def test_overlap_edge_cases(spark):
    o = [("HP:1", "PRESENT"), ("HP:2", "ABSENT"), ("HP:3", "SUSPECTED"), ("HP:4", "PRESENT")]
    odd = [("hp_1", "CÓ"), ("HP-2", "KHÔNG"), ("HP:3", "nghi ngờ"), ("HP:4", "present"), ("HP:4", "present"), (None, "PRESENT")]
    rows = [
        case("A", "training", o), case("A", "training", o), case("B", " Test ", odd), case("C", "val", o[:3]), case("D", "validation", o[:2]), case("E", "test", o, ("DX:2",)), case("F", "elsewhere", o), case("G", "test", None),
        case("H", "test", []), case("I", "test", o, None), case(None, "test", o), case("J", "train", o, ("dx_1", "DX:1")), case("K", "test", o, (None,)),
    ]
    df = spark.createDataFrame(rows, CASE)
    assert sorted(tuple(r) for r in overlap.found(spark, df).collect()) == [("A", "B"), ("A", "C"), ("B", "J"), ("C", "J")]
    assert {(r.split, r.cases, r.leaked_cases) for r in overlap.report(df).collect()} == {("test", 2, 1), ("validation", 2, 1)}
    assert overlap.found(spark, df.limit(0)).count() == 0


def test_components_over_many_tasks(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)] + [(k, k + 1) for k in range(10_000, 10_400)] + [(20_000, k) for k in range(20_001, 20_500)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    groups = {}
    for x in list(up):
        groups.setdefault(root(x), set()).add(x)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for task_edges in (100, 10_000):
        got = {}
        for r in grouping.components(df, task_edges).collect():
            got.setdefault(r.label, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert grouping.components(df.limit(0)).count() == 0


def test_ties_and_splits(spark):
    rows = [
        case("A", "train", [], ties=("P1", None, None)), case("B", "train", [], ties=(" p1", "F1", None)), case("C", "train", [], ties=(None, "f1 ", "unknown")), case("D", "train", [], ties=("Unknown", "không rõ", "-")),
        case("E", "train", [], ties=("unknown", None, "P1")), case("F", "train", [], ties=(None, None, "G")), case("G", "train", [], ties=(None, None, "g")), case("G", "train", [], ties=("P9", None, None)), case(None, "train", [], ties=("P1", "F1", "G")),
    ]
    df = spark.createDataFrame(rows, CASE)
    assert sorted(tuple(r) for r in grouping.found(spark, df).collect()) == [("A", "A"), ("B", "A"), ("C", "A"), ("F", "F"), ("G", "F")]
    assert grouping.found(spark, df.limit(0)).count() == 0 and grouping.split_groups(df.limit(0)).count() == 0
    rng = random.Random(2)
    many = spark.createDataFrame([case(f"C{k:05d}", "train", [], ties=(f"P{rng.randrange(1500)}", None, "hot" if k < 600 else None)) for k in range(2000)], CASE)
    got = grouping.split_groups(many, {"train": 0.5, "validation": 0.3, "test": 0.2}).collect()
    assert len(got) == 2000 and all(r.split for r in got)
    per: dict[str, set] = {}
    for r in got:
        per.setdefault(r.set_id, set()).add(r.split)
    assert all(len(s) == 1 for s in per.values())


def test_quotas_follow_the_greedy_order():
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    histogram = [(40, 1), (7, 30), (3, 100), (1, 30_000)]
    total = sum(s * n for s, n in histogram)
    gap = {k: total * v for k, v in shares.items()}
    for size, n in sorted(histogram, reverse=True):
        for _ in range(n):
            k = max(shares, key=lambda x: gap[x])
            gap[k] -= size
    got = grouping.quotas(histogram, shares)
    for k in shares:
        assert abs(total * shares[k] - gap[k] - sum(s * dict(got[s])[k] for s, _ in histogram)) <= 2
    assert all(sum(c for _, c in got[s]) == n for s, n in histogram)


def test_small_sets_of_one_disease_do_not_all_meet(spark):
    """Sets of three or four features have empty blocks; they share keys for what they have in common, not for what they lack."""
    rng = random.Random(8)
    rows = [(k, "g", [f"F{rng.randrange(10**9)}" for _ in range(rng.choice([3, 4, 5]))]) for k in range(3000)]
    keys = overlap.block_keys(spark.createDataFrame(rows, "cls bigint, gold string, features array<string>"))
    most = keys.distinct().groupBy("key").count().agg({"count": "max"}).collect()[0][0]
    assert most <= 60  # one in nine of the sets of three would share a key that knows only of two empty blocks
