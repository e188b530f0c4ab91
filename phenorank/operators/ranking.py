"""Profiles ranked against the observations of many cases at once.

A match depends on a term and a profile, not on a case, so it is worked out once per term and profile. Terms that meet
only at the root of the branch match with the root's information, which takes no pair of terms: one number per term and
one per profile say what such a match is worth. Cases are scored in blocks of cases and profiles, as a product of
sparse matrices. A task holds a block of cases and takes the blocks of profiles one after the other, with the best of
each case so far: pairs are neither joined nor shuffled, and only the final rows leave it.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenorank.functions.scalars import EPSILON, clip
from phenorank.session import broadcast_if_small, written, written_counting

# How coverages, score and compatibility are weighed.
IC_BONUS, EXACT_BONUS, ANCESTOR_BONUS, CONFLICT_COST = 0.50, 0.25, 0.10, 0.75
IC_PART, EXACT_PART, ANCESTOR_PART, CONFLICT_PART = 0.45, 0.30, 0.25, 0.50
SEMANTIC_SHARE = 0.25
#: Most profiles and places in a matrix of terms and profiles that a task scores at once, and most cases that it holds.
BLOCK_PROFILES, BLOCK_CELLS, BLOCK_CASES = 4096, 1_500_000, 32768
#: Cases whose results of a block are held before they meet those of the blocks before.
CHUNK_CASES = 1024
#: So many tasks at least, as long as each has so many cases.
LEAST_TASKS, LEAST_CASES = 12, 1024


def _priority(relation: str) -> F.Column:
    return F.expr(f"case {relation} when 'exact' then 4 when 'profile_descendant' then 3 when 'profile_ancestor' then 3 when 'semantic' then 1 end")


def best_matches(queries: DataFrame, similarity: DataFrame, terms: DataFrame, negative: bool = False) -> DataFrame:
    """``(q, profile_id, m)``: per term of ``queries(term)`` and profile the best of ``terms(profile_id, term, freq)``.

    By relation, strength * max(freq, 0.01), nearness, term. Negative terms have frequency 0 and no semantic relation.
    A match depends on the term alone, not on the case, so it is worked out once however many cases report the term.
    """
    rows = similarity.where("relation <> 'semantic'") if negative else similarity
    freq = F.lit(0.0) if negative else F.col("freq")
    hits = queries.select(F.col("term").alias("q")).distinct().join(rows, "q").join(terms.withColumnRenamed("term", "t"), "t")
    m = F.struct(
        _priority("relation").alias("prio"),
        (F.col("strength") * F.greatest(freq, F.lit(0.01))).alias("value"),
        (-F.col("dist")).alias("near"),
        F.col("t").alias("term"),
        "relation",
        "sim",
        "strength",
        freq.alias("freq"),
    )
    return hits.groupBy("q", "profile_id").agg(F.max(m).alias("m"))


def known_matches(queries: DataFrame, similarity: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """``(term, profile_id, p, n)``: the best positive and negative match of each term and profile that have one."""
    pos = best_matches(queries, similarity, positive).withColumnRenamed("m", "p")
    neg = best_matches(queries, similarity, negative, negative=True).withColumnRenamed("m", "n")
    return pos.join(neg, ["q", "profile_id"], "full").withColumnRenamed("q", "term")


def root_matches(closed_terms: DataFrame, positive: DataFrame, profiles: DataFrame, root: str, ic: float) -> tuple[DataFrame, DataFrame]:
    """``(by_term(term, dq), by_profile(profile_id, freq, t, dt))``: what a match through the root ``root`` rests on.

    Every one of ``profiles(profile_id)`` has a row; ``freq`` is null where none of its terms is below the root, or
    where the root tells nothing. All matches of a term through the root are equally strong, so that the most frequent
    of a profile's terms, then the nearest, then the larger id is matched, whatever the term.
    """
    below = closed_terms.where(F.col("anc") == root).select("term", F.col("dist").alias("d"))
    below = below if ic > 1e-9 else below.where("false")
    best = F.max(F.struct(F.greatest("freq", F.lit(0.01)).alias("value"), (-F.col("d")).alias("near"), "term", "freq")).alias("b")
    by_profile = positive.join(below, "term").groupBy("profile_id").agg(best)
    every = profiles.select("profile_id").distinct().join(by_profile, "profile_id", "left")
    return below.withColumnRenamed("d", "dq"), every.select("profile_id", F.col("b.freq").alias("freq"), F.col("b.term").alias("t"), (-F.col("b.near")).alias("dt"))


def _judged(rows: DataFrame, ic_root: float) -> DataFrame:
    """``rows`` (term and profile with p, n, dq, freq, t, dt, background, ic) with relation, probability and what follows."""
    strength_root = F.least(F.lit(1.0), F.lit(ic_root) / F.greatest("ic", F.lit(1e-9)))
    through = F.struct(
        F.lit(1).alias("prio"), (strength_root * F.greatest("freq", F.lit(0.01))).alias("value"), (-(F.col("dq") + F.col("dt"))).alias("near"), F.col("t").alias("term"),
        F.lit("semantic").alias("relation"), strength_root.alias("sim"), strength_root.alias("strength"), F.col("freq").alias("freq"),
    )
    rows = rows.withColumn("p", F.coalesce("p", F.when(F.col("dq").isNotNull() & F.col("freq").isNotNull(), through)))
    absent = F.col("n").isNotNull() & (F.col("p").isNull() | (F.col("n.prio") >= F.col("p.prio")))
    p, strength = F.col("p.freq"), F.col("p.strength")
    probability = (
        F.when(absent | F.col("p").isNull(), F.lit(EPSILON))
        .when(F.col("p.prio") == 4, p)
        .when(F.col("p.relation") == "profile_descendant", p)
        .when(F.col("p.relation") == "profile_ancestor", EPSILON + (p - EPSILON) * strength)
        .otherwise(EPSILON + (p - EPSILON) * SEMANTIC_SHARE * strength)
    )
    rows = rows.withColumn("absent", absent).withColumn("probability", clip(probability, EPSILON, 1 - EPSILON)).withColumn("c", F.when(absent, F.col("n")).otherwise(F.col("p")))
    return rows.withColumns(
        {
            "relation": F.when(F.col("absent"), F.concat(F.lit("profile_absent_"), F.col("c.relation"))).otherwise(F.coalesce("c.relation", F.lit("no_match"))),
            "matched_term": F.col("c.term"),
            "distance": (-F.col("c.near")).cast("int"),
            "sim": F.when(F.col("absent"), F.lit(0.0)).otherwise(F.coalesce("p.sim", F.lit(0.0))),
            "positive": F.col("p").isNotNull(),
            "found_llr": F.log("probability") - F.log("background"),
            "absent_llr": F.log1p(-F.col("probability")) - F.log1p(-F.col("background")),
        }
    )


def evidence(pairs: DataFrame, observations: DataFrame, known: DataFrame, by_term: DataFrame, by_profile: DataFrame, stats: DataFrame, ic_root: float) -> DataFrame:
    """One row per observation and profile of ``pairs(case_id, profile_id)``: relation, matched term, probability, LLR, contribution.

    ``observations(case_id, ord, term, status, w)``; ``stats(term, background, ic)``. A negative match at least as good
    as the positive one means the profile says the term is absent (relation ``profile_absent_*``); an observation that
    nothing of the profile meets has relation ``no_match``.
    """
    rows = observations.join(pairs.select("case_id", "profile_id").distinct(), "case_id").join(known, ["term", "profile_id"], "left")
    terms, _ = written(stats.select("term", "background", "ic").join(observations.select("term").distinct(), "term").join(by_term, "term", "left"), "terms")
    rows = rows.join(broadcast_if_small(terms), "term").join(broadcast_if_small(by_profile), "profile_id", "left")  # wide rows, better not shuffled again
    out = _judged(rows, ic_root).withColumn("llr", F.when(F.col("status") == "ABSENT", F.col("absent_llr")).otherwise(F.col("found_llr")))
    return out.select(
        "case_id", "ord", "profile_id", "term", "status", "w", "background", "ic", "relation", "matched_term", "distance", "sim", "absent", "positive", "probability", "llr", (F.col("w") * F.col("llr")).alias("contribution")
    )


def _nothing() -> F.Column:
    """What an observation without a match adds."""
    return F.when(F.col("status") == "ABSENT", F.log1p(F.lit(-EPSILON)) - F.log1p(-F.col("background"))).otherwise(F.log(F.lit(EPSILON)) - F.log("background"))


def _per_case(observations: DataFrame, stats: DataFrame) -> DataFrame:
    """``(case_id, base, w_all, ic_all, absent_all)``: the log-likelihood without any match and the weights of each case."""
    obs = observations.join(stats.select("term", "background", "ic"), "term")
    found = F.col("status").isin("PRESENT", "SUSPECTED")
    return obs.groupBy("case_id").agg(
        F.sum(F.when(F.col("status") != "NOT_ASSESSED", F.col("w") * _nothing()).otherwise(0.0)).alias("base"),
        F.sum(F.when(found, F.col("w")).otherwise(0.0)).alias("w_all"),
        F.sum(F.when(found, F.col("w") * F.col("ic")).otherwise(0.0)).alias("ic_all"),
        F.sum(F.when(F.col("status") == "ABSENT", F.col("ic")).otherwise(0.0)).alias("absent_all"),
    )


def scores(observations: DataFrame, rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``(case_id, profile_id, exact, ancestor, ic_coverage, conflict, log_likelihood, score, compatibility)`` of the pairs in ``rows`` (see ``evidence``)."""
    case = _per_case(observations, stats)
    nothing = _nothing()
    found = F.col("status").isin("PRESENT", "SUSPECTED")
    usable = F.col("status") != "NOT_ASSESSED"
    good = found & ~F.col("absent")
    per = rows.groupBy("case_id", "profile_id").agg(
        F.sum(F.when(usable, F.col("contribution") - F.col("w") * nothing).otherwise(0.0)).alias("delta"),
        F.sum(F.when(good & (F.col("relation") == "exact"), F.col("w")).otherwise(0.0)).alias("w_exact"),
        F.sum(F.when(good & F.col("relation").isin("exact", "profile_ancestor", "profile_descendant"), F.col("w")).otherwise(0.0)).alias("w_anc"),
        F.sum(F.when(good, F.col("w") * F.col("ic") * F.col("sim")).otherwise(0.0)).alias("ic_hit"),
        F.sum(F.when((F.col("status") == "ABSENT") & F.col("positive"), F.col("ic") * F.col("probability")).otherwise(0.0)).alias("clash"),
        F.count("*").alias("matches"),
    )
    j = per.join(case, "case_id")
    part = lambda a, b: F.when(F.col(b) > 1e-9, F.col(a) / F.col(b)).otherwise(0.0)
    out = j.select(
        "case_id",
        "profile_id",
        part("w_exact", "w_all").alias("exact"),
        part("w_anc", "w_all").alias("ancestor"),
        F.when(F.col("ic_all") > 1e-9, F.col("ic_hit") / F.col("ic_all")).otherwise(part("w_anc", "w_all")).alias("ic_coverage"),
        part("clash", "absent_all").alias("conflict"),
        (F.col("base") + F.col("delta")).alias("log_likelihood"),
        "matches",
    )
    return with_score(out)


def with_score(parts: DataFrame) -> DataFrame:
    """``parts`` with ``score`` and ``compatibility``."""
    ic, exact, ancestor, conflict = (F.col(c) for c in ("ic_coverage", "exact", "ancestor", "conflict"))
    return parts.withColumn("score", F.col("log_likelihood") + IC_BONUS * ic + EXACT_BONUS * exact + ANCESTOR_BONUS * ancestor - CONFLICT_COST * conflict).withColumn(
        "compatibility", clip(IC_PART * ic + EXACT_PART * exact + ANCESTOR_PART * ancestor - CONFLICT_PART * conflict, 0.0, 1.0)
    )


_TOP = "case_id string, profile_id string, concept_id string, exact double, ancestor double, ic_coverage double, conflict double, log_likelihood double, rank bigint"
_PACKED = "pb int, no int, ats binary, times binary, probabilities binary, sims binary, flags binary"
_PARTS = ("exact", "ancestor", "ic", "conflict", "ll")


def _packed(key: tuple, rows: pa.Table) -> pa.Table:
    """The matches of one block of profiles, one row per term: bytes of the profiles' places and, for runs of ``times`` of them, what they share."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives back at once what a task no longer needs
    no, at, *values = (rows.column(c).to_numpy() for c in ("no", "at", "probability", "sim", "flags"))
    order = np.lexsort([*reversed(values), no])
    no, at, values = no[order], at[order].astype(np.uint16), [v[order] for v in values]
    new = np.r_[True, no[1:] != no[:-1]] if len(no) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    runs = np.flatnonzero(new)
    times, values = np.diff(np.r_[runs, len(no)]).astype(np.uint16), [v[runs] for v in values]
    cut = lambda v, first: pa.array([x.tobytes() for x in np.split(v, first[1:])] if len(first) else [], pa.binary())
    parts = [cut(at, starts), *[cut(v, np.searchsorted(runs, starts)) for v in (times, *values)]]
    return pa.table([pa.array([key[0].as_py()] * len(starts), pa.int32()), pa.array(no[starts], pa.int32()), *parts], names=["pb", "no", "ats", "times", "probabilities", "sims", "flags"])


def _summed(part: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of rows, always in the order of the rows, so that a profile's sum doesn't hang on which others are there."""
    if not len(part):
        return np.zeros(part.shape[1])
    if part.shape[1] <= 64:
        return np.add.accumulate(weights[:, None] * part, axis=0)[-1]
    out = weights[0] * part[0]
    for w, row in zip(weights[1:], part[1:], strict=True):
        out += w * row
    return out


def _score(parts: dict[str, np.ndarray]) -> np.ndarray:
    return parts["ll"] + IC_BONUS * parts["ic"] + EXACT_BONUS * parts["exact"] + ANCESTOR_BONUS * parts["ancestor"] - CONFLICT_COST * parts["conflict"]


class _Block:
    """Profiles of one block, in the order of their ids, against every observed term, and the scores of a case."""

    def __init__(self, rows: pa.Table, ic_root: float):
        own = rows.filter(pc.is_valid(rows.column("place"))).sort_by("at")
        self.ids, self.names = (own.column(c).combine_chunks() for c in ("profile_id", "concept_id"))
        self.places, self.concepts = own.column("place").to_numpy(), own.column("concept").to_numpy()
        freq = own.column("freq").to_numpy().astype(np.float64)  # of a match through the root; nan where there is none
        terms = rows.filter(pc.is_valid(rows.column("below"))).sort_by("no")
        background, ic = (terms.column(c).to_numpy() for c in ("background", "ic"))
        through = terms.column("below").to_numpy()[:, None] & ~np.isnan(freq)
        strength = np.minimum(1.0, ic_root / np.maximum(ic, 1e-9))[:, None]
        p = (np.nan_to_num(freq) - EPSILON) * SEMANTIC_SHARE * strength
        p += EPSILON
        np.clip(p, EPSILON, 1 - EPSILON, out=p)
        p[~through] = EPSILON
        self.hit = through * strength
        self.flags = np.zeros(p.shape, np.uint8)
        known = rows.filter(pc.is_valid(rows.column("ats")))
        for no, *parts in zip(*(known.column(c).to_pylist() for c in ("no", "ats", "times", "probabilities", "sims", "flags")), strict=True):
            at, times, *shared = (np.frombuffer(x, t) for x, t in zip(parts, (np.uint16, np.uint16, np.float64, np.float64, np.uint8), strict=True))
            probability, sim, flags = (np.repeat(x, times) for x in shared)
            p[no, at], self.hit[no, at], self.flags[no, at], through[no, at] = probability, sim, flags, flags & 4
        self.ic = ic
        self.hit *= ic[:, None]
        self.found = np.log(p)
        self.found -= np.log(background)[:, None]
        self.gone = np.negative(p)
        np.log1p(self.gone, out=self.gone)
        self.gone -= np.log1p(-background)[:, None]
        self.clash = p
        self.clash *= ic[:, None]
        self.clash *= through

    def coverage(self, case: tuple) -> np.ndarray:
        """The coverage by information of every profile."""
        (yes, w), _ = case
        ic_all = float(sum(w * self.ic[yes]))
        return _summed(self.hit[yes], w) / ic_all if ic_all > 1e-9 else self.scored(case)["ic"]

    def scored(self, case: tuple, at: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """The parts of the score of the profiles at the places ``at``, by default all."""
        (yes, w), (no, v) = case
        of = (lambda m, k: m[k]) if at is None else (lambda m, k: m[k[:, None], at])
        n = self.hit.shape[1] if at is None else len(at)
        flags = of(self.flags, yes)
        w_all, ic_all, absent_all = float(sum(w)), float(sum(w * self.ic[yes])), float(sum(self.ic[no]))
        part = lambda total, whole: total / whole if whole > 1e-9 else np.zeros(n)
        out = {"exact": part(_summed(flags & 1, w), w_all), "ancestor": part(_summed((flags >> 1) & 1, w), w_all), "conflict": part(_summed(of(self.clash, no), np.ones(len(no))), absent_all)}
        out["ic"] = _summed(of(self.hit, yes), w) / ic_all if ic_all > 1e-9 else out["ancestor"]
        out["ll"] = _summed(of(self.found, yes), w) + _summed(of(self.gone, no), v)
        out["score"] = _score(out)
        return out


_KEYS = {"IC_COVERAGE": ("ic", "exact", "score"), "LIKELIHOOD_SCORE": ("score",)}


def _key(values: np.ndarray) -> np.ndarray:
    return np.round(values, 10) + 0.0


def _best(first: np.ndarray, parts: Callable[[np.ndarray], dict], keys: tuple[str, ...], k: int, concepts: np.ndarray | None) -> tuple[np.ndarray, dict]:
    """The places of the first ``k`` by falling keys and then by falling place, with their parts; the first of each concept only.

    ``first`` has the first key of all; ``parts(places)`` is worked out only for places that it leaves in question.
    """
    n = len(first)
    take = k
    while True:
        take = min(n, take)
        near = np.flatnonzero(first >= np.partition(first, n - take)[n - take]) if take else np.empty(0, np.int64)
        got = parts(near)
        order = np.lexsort([near, *[_key(got[key]) for key in reversed(keys[1:])], first[near]])[::-1]
        if concepts is not None:
            order = order[np.sort(np.unique(concepts[near[order]], return_index=True)[1])]
        if concepts is None or len(order) >= k or take >= n:
            order = order[:k]
            return near[order], {c: v[order] for c, v in got.items()}
        take *= 4


class _Cases:
    """A block of cases with the terms of each, and the best profiles of each so far."""

    def __init__(self, rows: pa.Table, k: int):
        asked = rows.filter(pc.is_valid(rows.column("ask")))
        rows = rows.filter(pc.is_valid(rows.column("said")))
        said = rows.column("said").combine_chunks()
        if isinstance(said, pa.ChunkedArray):
            said = pa.concat_arrays(said.chunks) if said.num_chunks else pa.array([], said.type)
        self.ids = pa.array(rows.column("case_id").to_pylist(), pa.string())
        self.ends = np.r_[0, np.cumsum(pc.list_value_length(said).to_numpy())]
        flat = said.flatten()
        self.no, self.w, self.absent = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("no", "w", "absent"))
        self.places, self.concepts = (np.full((len(self.ids), k), -1, np.int32) for _ in range(2))
        self.parts = [np.zeros((len(self.ids), k)) for _ in _PARTS]
        self.numbers = {x: c for c, x in enumerate(self.ids.to_pylist())}
        self.blocks: list[tuple] = []
        self.asked = self.take(asked)
        self.better: dict[tuple, int] = {}

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, c: int) -> tuple:
        """The terms of a case with their weights, those found and those absent."""
        part = slice(self.ends[c], self.ends[c + 1])
        n, v, a = self.no[part], self.w[part], self.absent[part]
        return (n[~a], v[~a]), (n[a], v[a])

    def take(self, rows: pa.Table) -> dict[int, list[tuple]]:
        """What ``rows`` ask for, by the number of the case; cases that aren't here are left out."""
        out: dict[int, list[tuple]] = {}
        for case_id, *line in zip(*(rows.column(c).to_pylist() for c in ("case_id", "ask", "k0", "k1", "k2")), strict=True):
            if case_id in self.numbers:
                out.setdefault(self.numbers[case_id], []).append(tuple(line))
        return out

    def merge(self, first: int, last: int, of: list, at: list, values: list, block: _Block, keys: tuple[str, ...], by_concept: bool) -> None:
        """The best of the cases from ``first`` to before ``last``, from those so far and the places ``at`` of a block."""
        c, i = np.nonzero(self.places[first:last] >= 0)
        new = np.concatenate(at)
        case = np.r_[c, np.concatenate(of) - first]
        place, concept = np.r_[self.places[first:last][c, i], block.places[new]], np.r_[self.concepts[first:last][c, i], block.concepts[new]]
        parts = [np.r_[old[first:last][c, i], np.concatenate(x)] for old, x in zip(self.parts, zip(*values, strict=True), strict=True)]
        named = dict(zip(_PARTS, parts, strict=True))
        named["score"] = _score(named)
        order = np.lexsort([-place, *[-_key(named[key]) for key in reversed(keys)], case])
        if by_concept:
            order = order[np.sort(np.unique(case[order].astype(np.int64) << 32 | concept[order], return_index=True)[1])]
        case = case[order]
        starts = np.flatnonzero(np.r_[True, case[1:] != case[:-1]]) if len(case) else np.empty(0, np.int64)
        nth = np.arange(len(case)) - np.repeat(starts, np.diff(np.r_[starts, len(case)]))
        keep = nth < self.places.shape[1]
        order, case, nth = order[keep], case[keep] + first, nth[keep]
        for kept, x in zip((self.places, self.concepts, *self.parts), (place, concept, *parts), strict=True):
            kept[first:last] = -1
            kept[case, nth] = x[order]

    def counted(self) -> Iterator[pa.RecordBatch]:
        """The place of each profile asked for, as rows of ``_TOP``."""
        if self.better:
            of, ids = zip(*self.better, strict=True)
            yield _rows(self.ids.take(pa.array(of)), pa.array(ids, pa.string()), None, [np.zeros(len(ids))] * len(_PARTS), np.array(list(self.better.values())) + 1)

    def best(self, by_concept: bool) -> Iterator[pa.RecordBatch]:
        """The rows of ``_TOP`` of these cases."""
        if not self.blocks:
            return
        order = pa.array(np.argsort(np.concatenate([x for x, _, _ in self.blocks])))
        ids, names = (pa.concat_arrays([x[i] for x in self.blocks]).take(order) for i in (1, 2))
        for first in range(0, len(self), CHUNK_CASES):
            c, i = np.nonzero(self.places[first : first + CHUNK_CASES] >= 0)
            c += first
            at = pa.array(self.places[c, i])
            yield _rows(self.ids.take(pa.array(c)), ids.take(at), names.take(at) if by_concept else None, [x[c, i] for x in self.parts], i + 1)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """The sorted rows of each ``cb`` and ``pb``, one table at a time."""
    now, pieces = None, []
    for batch in batches:
        cb, pb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cb", "pb"))
        cuts = [0, *(np.flatnonzero((cb[1:] != cb[:-1]) | (pb[1:] != pb[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            key = int(cb[a]), int(pb[a])
            if key != now:
                if pieces:
                    yield *now, pa.Table.from_batches(pieces)
                now, pieces = key, []
            pieces.append(batch.slice(a, b - a))
        del batch
    if pieces:
        yield *now, pa.Table.from_batches(pieces)


def top_profiles(
    observations: DataFrame, known: DataFrame, by_term: DataFrame, by_profile: DataFrame, stats: DataFrame, ic_root: float,
    strategy: str = "IC_COVERAGE", top_k: int = 10, concepts: DataFrame | None = None, wanted: DataFrame | None = None,
) -> DataFrame:
    """The first ``top_k`` profiles of each case among all of ``by_profile``, with their coverages, score and ``rank``.

    IC_COVERAGE orders by coverage, exact coverage, score and id, LIKELIHOOD_SCORE by score and id, all descending;
    numbers are compared at ten decimals, so that ties don't hang on the order of a sum. With ``concepts(profile_id,
    concept_id)`` only the best profile of a concept is ranked (profiles outside stand alone). With ``wanted(case_id,
    profile_id)`` those pairs are returned instead, ``rank`` being their place among all profiles.

    Profiles are cut into blocks of at most some ``BLOCK_PROFILES`` and ``BLOCK_CELLS`` places in a matrix of terms and
    profiles, cases into blocks of some ``BLOCK_CASES``. A task has one block of cases and takes the blocks of profiles
    as they come, one in memory at a time, with the best of each case so far. A block's matches are packed once, a row
    per term, and sent once per block of cases; a case is sent once; a task returns ``top_k`` rows a case, ranked. So
    what is shuffled grows with observations and matches, not with their product or the number of blocks.
    """
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    keys = _KEYS[strategy]
    terms = observations.select("term").distinct().join(stats.select("term", "background", "ic"), "term").join(by_term, "term", "left")
    terms, _, counted = written_counting(terms.withColumn("no", (F.row_number().over(Window.orderBy("term")) - 1).cast("int")), "terms")
    n_profiles = by_profile.count()
    pbs = max(1, math.ceil(n_profiles / max(1, min(BLOCK_PROFILES, BLOCK_CELLS // max(1, counted["rows"])))))
    n_cases = observations.select("case_id").distinct().count()
    cbs = max(1, math.ceil(n_cases / BLOCK_CASES), min(math.ceil(n_cases / LEAST_CASES), LEAST_TASKS))
    named = by_profile.join(concepts.select("profile_id", "concept_id"), "profile_id", "left") if concepts is not None else by_profile.withColumn("concept_id", F.col("profile_id"))
    named = named.withColumn("concept_id", F.coalesce("concept_id", "profile_id")).withColumn("pb", F.pmod(F.xxhash64("profile_id"), F.lit(pbs)).cast("int"))
    number = lambda w: (w - 1).cast("int")
    named = named.withColumn("place", number(F.row_number().over(Window.orderBy("profile_id")))).withColumn("concept", number(F.dense_rank().over(Window.orderBy("concept_id"))))
    named, _ = written(named.withColumn("at", number(F.row_number().over(Window.partitionBy("pb").orderBy("profile_id")))), "profiles")
    to_cases = F.explode(F.sequence(F.lit(0), F.lit(cbs - 1))).alias("cb")
    to_profiles = F.explode(F.sequence(F.lit(0), F.lit(pbs - 1))).alias("pb")
    block = F.pmod(F.xxhash64("case_id"), F.lit(cbs)).cast("int").alias("cb")

    features = _judged(known.join(broadcast_if_small(terms), "term").join(broadcast_if_small(named.select("profile_id", "pb", "at", "freq", "t", "dt")), "profile_id"), ic_root)
    flag = lambda c, n: F.when(c, n).otherwise(0)
    met = ~F.col("absent")
    flags = flag(met & (F.col("relation") == "exact"), 1) + flag(met & F.col("relation").isin("exact", "profile_ancestor", "profile_descendant"), 2) + flag(F.col("positive"), 4)
    packed = features.select("pb", "no", "at", "probability", "sim", flags.cast("tinyint").alias("flags")).groupBy("pb").applyInArrow(_packed, _PACKED)
    packed, _ = written(packed, "packed")
    left = packed.unionByName(named.select("pb", "at", "place", "concept", "profile_id", "concept_id", "freq"), True).unionByName(terms.select("no", "background", "ic", F.col("dq").isNotNull().alias("below"), to_profiles), True).select("*", to_cases)

    status = F.col("status").eqNullSafe("NOT_ASSESSED")
    said = F.when(~status, F.struct("ord", "no", F.col("w").alias("w"), F.col("status").eqNullSafe("ABSENT").alias("absent")))
    cases = observations.join(broadcast_if_small(terms.select("term", "no")), "term").groupBy("case_id").agg(F.array_sort(F.collect_list(said)).alias("said"))
    first = F.lit(-1).alias("pb")  # a block's cases come before the blocks of profiles
    right = cases.select("case_id", "said", block, first)
    by_concept, asking = concepts is not None, wanted is not None
    counting = asking and "k0" in wanted.columns
    if asking:
        here = wanted.select("*", first) if counting else wanted.join(named.select("profile_id", "pb"), "profile_id")
        ask = F.col("profile_id").alias("ask")
        right = right.unionByName(here.select("case_id", ask, *[F.col(c) if counting and c in wanted.columns else F.lit(None).cast("double").alias(c) for c in ("k0", "k1", "k2")], block, "pb"), True)
    else:
        right = right.select("*", F.lit(None).cast("string").alias("ask"), *[F.lit(None).cast("double").alias(c) for c in ("k0", "k1", "k2")])
    every, k = keys[0] == "score", 0 if asking else min(top_k, n_profiles)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        cases, of_block = None, -1
        for cb, pb, rows in _tables(batches):
            if pb < 0:
                if cases is not None:
                    yield from cases.counted() if counting else cases.best(by_concept)
                cases, of_block = _Cases(rows, k), cb
            elif cases is not None and of_block == cb:  # else no case fell into this block
                data = _Block(rows, ic_root)
                if counting:
                    _count(cases, data, keys, every)
                elif asking:
                    asked = cases.take(rows.filter(pc.is_valid(rows.column("ask"))))
                    names = data.ids.to_pylist()
                    for c, lines in asked.items():
                        at = np.array([bisect.bisect_left(names, profile) for profile, *_ in lines], np.int64)
                        got = data.scored(cases[c], at)
                        yield _rows(cases.ids.take(pa.array([c] * len(at))), data.ids.take(pa.array(at)), None, [got[x] for x in _PARTS], np.zeros(len(at), np.int64))
                elif k:
                    _improve(cases, data, keys, every, k, by_concept)
                data = None
            rows = None
        if cases is not None:
            yield from cases.counted() if counting else cases.best(by_concept)

    best = left.unionByName(right, True).repartitionById(cbs, F.col("cb")).sortWithinPartitions("cb", "pb").mapInArrow(score, _TOP)
    if counting:
        return best.select("case_id", "profile_id", "rank")
    scored = with_score(best.withColumn("rank", F.col("rank").cast("int")))
    if not by_concept:
        scored = scored.withColumn("concept_id", F.col("profile_id"))
    return scored.drop("rank") if asking else scored


def _first_keys(data: _Block, case: tuple, every: bool) -> tuple[np.ndarray, Callable[[np.ndarray], dict]]:
    """The first key of all profiles of a block for a case, and the parts of those at given places."""
    if every:
        whole = data.scored(case)
        return _key(whole["score"]), lambda at: {c: v[at] for c, v in whole.items()}
    return _key(data.coverage(case)), lambda at: data.scored(case, at)


def _improve(cases: _Cases, data: _Block, keys: tuple[str, ...], every: bool, k: int, by_concept: bool) -> None:
    """Take the best of a block of profiles into the best so far of each case."""
    for first in range(0, len(cases), CHUNK_CASES):
        last = min(first + CHUNK_CASES, len(cases))
        of, places_, values = [], [], []
        for c in range(first, last):
            at, got = _best(*_first_keys(data, cases[c], every), keys, k, data.concepts if by_concept else None)
            of.append(np.full(len(at), c))
            places_.append(at)
            values.append([got[x] for x in _PARTS])
        cases.merge(first, last, of, places_, values, data, keys, by_concept)
    cases.blocks.append((data.places, data.ids, data.names))


def _count(cases: _Cases, data: _Block, keys: tuple[str, ...], every: bool) -> None:
    """Count how many of a block are before each of the profiles asked for."""
    names = data.ids.to_pylist()
    for c, lines in cases.asked.items():
        first, parts = _first_keys(data, cases[c], every)
        for profile, *want in lines:
            i = bisect.bisect_left(names, profile)
            here = i < len(names) and names[i] == profile
            want = [_key(np.float64(x)) for x in want[: len(keys)]]
            better, even = int((first > want[0]).sum()), np.flatnonzero(first == want[0])
            got = parts(even)
            for k, w in zip(keys[1:], want[1:], strict=True):
                have = _key(got[k])
                better += int((have > w).sum())
                even, got = even[have == w], {x: v[have == w] for x, v in got.items()}
            cases.better[c, profile] = cases.better.get((c, profile), 0) + better + int((even >= i + here).sum())


_TOP_NAMES = [c.split(" ")[0] for c in _TOP.split(", ")]


def _rows(cases: pa.Array, ids: pa.Array, names: pa.Array | None, parts: list, rank: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_TOP``."""
    text = pa.string()
    columns = [cases.cast(text), ids.cast(text), pa.nulls(len(ids), text) if names is None else names.cast(text), *[pa.array(x, pa.float64()) for x in parts], pa.array(rank, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=_TOP_NAMES)


def places(wanted: DataFrame, *parts, strategy: str = "IC_COVERAGE", **options) -> DataFrame:
    """``(case_id, profile_id, rank)``: the place of each of ``wanted(case_id, profile_id)`` among all profiles of its case.

    Takes the arguments of :func:`top_profiles`. Scored twice: first the wanted pairs, then how many are before them.
    Pairs of an unknown case or profile have no row.
    """
    order = {"ic": "ic_coverage", "exact": "exact", "score": "score"}
    scored, _ = written(top_profiles(*parts, strategy=strategy, wanted=wanted.select("case_id", "profile_id").distinct(), **options), "wanted")
    keys = [F.col(order[k]).alias(f"k{i}") for i, k in enumerate(_KEYS[strategy])]
    return top_profiles(*parts, strategy=strategy, wanted=scored.select("case_id", "profile_id", *keys), **options)




def ranked(scored: DataFrame, strategy: str = "IC_COVERAGE", top_k: int | None = 10, subset: DataFrame | None = None) -> DataFrame:
    """``scored`` with ``rank``, the first ``top_k`` of each case (all for None, none for 0).

    IC_COVERAGE orders by coverage, exact coverage, score and id, LIKELIHOOD_SCORE by score and id, all descending;
    numbers are compared at ten decimals, so that ties don't hang on the order of a sum. ``subset(profile_id)``
    restricts the profiles. Only pairs in ``scored`` are ranked: add those without a match (``unmatched``) first.
    """
    if top_k is not None and top_k < 0:
        raise ValueError("top_k must not be negative")
    rows = scored.join(subset.select("profile_id").distinct(), "profile_id", "left_semi") if subset is not None else scored
    keys = {"IC_COVERAGE": ["ic_coverage", "exact", "score"], "LIKELIHOOD_SCORE": ["score"]}[strategy]
    w = Window.partitionBy("case_id").orderBy(*[F.round(k, 10).desc() for k in keys], F.col("profile_id").desc())
    out = rows.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top_k) if top_k is not None else out
