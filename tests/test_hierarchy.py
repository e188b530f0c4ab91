from __future__ import annotations

import random

from phenorank.operators import hierarchy, ontology

SCHEMA = "hpo_id string, parents array<string>, alt_ids array<string>, is_obsolete boolean, replaced_by string, name string"


def table(spark, rows):
    return spark.createDataFrame([(r + (None,) * 6)[:6] for r in rows], SCHEMA)


def test_resolution_and_cycles(spark):
    terms = table(
        spark,
        [
            ("HP:1", ["hp:2 ", "HP:2"]), ("HP:2", [" HP:3"]), ("HP:3", ["HP:91"], ["HP:33"]), ("HP:4", ["HP:33"]), ("HP:5", ["HP:5"]), ("HP:6", ["HP:404", "", None]), ("HP:7", None), ("HP:8", []),
            ("HP:90", ["HP:1"], None, True, "HP:1"), ("HP:91", None, None, True, "hp:90"), ("HP:92", ["HP:1"], None, True, None), ("HP:10", ["HP:92"]), (None, ["HP:1"]), ("HP:1", ["hp:2 ", "HP:2"]),
        ],
    )
    assert sorted(tuple(r) for r in hierarchy.found(spark, terms).collect()) == [("HP:1", "HP:1"), ("HP:2", "HP:1"), ("HP:3", "HP:1"), ("HP:5", "HP:5")]
    nodes, links = hierarchy.resolved_links(terms)
    got = {r.hpo_id: r for r in hierarchy.paths(nodes, links).collect()}
    assert got["HP:4"].path is None and not got["HP:4"].in_cycle and got["HP:1"].in_cycle
    assert (got["HP:6"].path, got["HP:6"].depth, got["HP:6"].root) == ("HP:6", 0, "HP:6")
    assert got["HP:3"].n_descendants == 3 and "HP:90" not in got


def test_empty_table(spark):
    empty = table(spark, [("HP:1", [])]).limit(0)
    assert hierarchy.found(spark, empty).count() == 0
    assert hierarchy.paths(*hierarchy.resolved_links(empty)).count() == 0


def test_random_graphs_against_search(spark):
    for seed in range(2):
        rng = random.Random(seed)
        n = 60
        edges = {(a, rng.randrange(n)) for a in range(n) for _ in range(rng.choice([0, 1, 1, 2]))}
        up = {a: {q for p, q in edges if p == a} for a in range(n)}

        def reach(a):
            dist, todo = {}, [(b, 1) for b in up[a]]
            while todo:
                b, k = todo.pop(0)
                if b not in dist:
                    dist[b] = k
                    todo += [(c, k + 1) for c in up[b]]
            return dist

        all_up = {a: reach(a) for a in range(n)}
        name = lambda x: f"T{x:03d}"
        links = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "child string, parent string")
        nodes = spark.createDataFrame([(name(a),) for a in range(n)], "hpo_id string")
        got = {(r.node, r.anc): r.dist for r in hierarchy.closure(links).collect()}
        assert got == {(name(a), name(b)): k for a in range(n) for b, k in all_up[a].items()}
        loops = {name(a): min(name(b) for b in all_up[a] if a in all_up[b]) for a in range(n) if a in all_up[a]}
        assert {r.hpo_id: r.cycle_id for r in hierarchy.cycles(links).collect()} == loops
        for r in hierarchy.paths(nodes, links).collect():
            a = int(r.hpo_id[1:])
            tops = [(k, b) for b, k in {**all_up[a], a: 0}.items() if not up[b]]
            assert (r.depth is None) == (not tops)
            if tops:
                assert r.depth == min(tops)[0] and len(r.path.split("/")) == r.depth + 1 and r.path.startswith(r.root)
        bad = {a for a in range(n) if a in all_up[a] or any(b in all_up[b] for b in all_up[a])}

        def longest(a):
            return max((1 + longest(b) for b in up[a]), default=0)

        assert {r.hpo_id: r.depth for r in ontology.longest_depth(nodes, links).collect()} == {name(a): longest(a) for a in range(n) if a not in bad}


def test_long_chain(spark):
    links = spark.createDataFrame([(f"N{k:04d}", f"N{k + 1:04d}") for k in range(150)], "child string, parent string")
    nodes = spark.createDataFrame([(f"N{k:04d}",) for k in range(151)], "hpo_id string")
    got = {r.hpo_id: r.depth for r in hierarchy.paths(nodes, links).collect()}
    assert got["N0000"] == 150 and got["N0150"] == 0


def test_pointers_into_cycles(spark, monkeypatch):
    rounds = []
    real = hierarchy.written_counting
    monkeypatch.setattr(hierarchy, "written_counting", lambda *a, **k: rounds.append(a[1]) or real(*a, **k))
    for rows, want in (
        ([("x", "a"), ("a", "b"), ("b", "a"), ("y", "z")], {("y", "z")}),
        ([("a", "b"), ("b", "c"), ("c", "a")], set()),
        ([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", None), ("f", "e")], {("e", None), ("f", None)}),
    ):
        rounds.clear()
        got = hierarchy.follow_pointers(spark.createDataFrame(rows, "node string, ptr string"))
        assert {tuple(r) for r in got.collect()} == want
        assert len(rounds) <= len(rows).bit_length() + 2


def test_cycles_above_cycles(spark):
    """Cycles that hang on cycles with smaller and larger ids, a smallest node between two, chains at both ends."""
    links = [("D", "E"), ("E", "D"), ("D", "A"), ("A", "G"), ("G", "H"), ("H", "I"), ("I", "G"), ("I", "B"), ("B", "C"), ("C", "B"), ("C", "Z1"), ("Z1", "Z2"), ("L1", "L2"), ("L2", "E"), ("S", "S"), ("Y", "S")]
    got = {r.hpo_id: r.cycle_id for r in hierarchy.cycles(spark.createDataFrame(links, "child string, parent string")).collect()}
    assert got == {"D": "D", "E": "D", "G": "G", "H": "G", "I": "G", "B": "B", "C": "B", "S": "S"}
    ring = [(f"N{k:03d}", f"N{(k + 1) % 100:03d}") for k in range(100)]
    got = {r.hpo_id: r.cycle_id for r in hierarchy.cycles(spark.createDataFrame(ring, "child string, parent string")).collect()}
    assert len(got) == 100 and set(got.values()) == {"N000"}
