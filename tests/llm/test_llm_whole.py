"""Nothing is left out by numbers of matches, lists of signs or candidates."""

from __future__ import annotations

import itertools
import random

import numpy as np

from phenorank.llm import leakage, mapping, residue
from phenorank.llm.words import folded


def test_readings_of_many_matches():
    ref = mapping.Reference.__new__(mapping.Reference)
    ref.longest, ref.entries = 4, {("Z", "Y"): [("", "ID")]}
    ref.lookup = lambda shown, plain, edits, lenient: {"xxxx": [("what", "X", 0.0)], "zzzz": [("what", "Z", 0.0)], "yyyy": [("where", "Y", 0.0)]}.get(shown, [])
    assert ref._readings([*["xxxx"] * 45, "zzzz", "yyyy"], 0, False)[1] == ["ID"]
    assert ref._readings([*["xxxx"] * 45, "yyyy"], 0, False)[1] == []


def test_every_date_mask_is_a_field():
    masks = [s.join(p) for s in "/.-" for p in itertools.product(("dd", "jj", "mm", "nn"), ("mm", "dd", "tt"), ("yyyy", "yy", "aaaa", "nnnn"))]
    masks = [*masks, *map(str.upper, masks), *map(str.title, masks), *[s.join(p) for s in "/.-" for p in itertools.product(("XX", "xx", "Xx"), ("XX", "xx"), ("XXXX", "xx"))]]
    assert all(residue._FIELD["date mask"].search(m) for m in masks)
    assert [m for m in masks if not residue.has_open_field(f"Examined on {m} at the clinic")] == []


def test_passages_with_evenly_spaced_changes():
    rng, search = random.Random(11), leakage.Search()
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    lost = 0
    for _ in range(1500):
        item = [word() for _ in range(30)]
        ((_, words, chunk, codes, least),) = leakage.item_rows([1], [" ".join(item)], search)
        likely = np.zeros(1 << 13, np.uint8)
        at = codes.view(np.uint64) >> np.uint64(48)
        np.bitwise_or.at(likely, (at >> np.uint64(3)).astype(int), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        text = " ".join([word() for _ in range(60)] + [word() if n in (8, 16, 23) else w for n, w in enumerate(item)] + [word() for _ in range(60)])
        held = leakage.stretches([folded("nothing here"), folded(text)], likely, 16, search)
        ok = [n for n, w in held if set(leakage.minima(leakage.shingles(w, 5), search.window).view(np.int64)) & set(least) and leakage.contained(w, leakage.shingles(w, 5), words.view(np.uint64), np.sort(codes.view(np.uint64)), chunk, search)]
        lost += ok != [1]
    assert lost == 0


def test_minima_of_shared_runs():
    """Sequences with a run of ``window`` codes in common have a minimum in common."""
    rng = np.random.default_rng(3)
    for _ in range(500):
        a, b, run = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (20, 20, 3))
        a[5:8] = b[11:14] = run
        assert set(leakage.minima(a, 3)) & set(leakage.minima(b, 3))
    assert len(leakage.minima(np.arange(2, dtype=np.uint64), 3)) == 0
