"""Term statistics over a closed hierarchy: document frequency, information content, depth, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenorank.operators.hierarchy import closure
from phenorank.session import broadcast_if_small, discard, written

ROOT_BACKGROUND = 1 - 1e-4
LEAST_IC = 1e-9


def closed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(term, anc, dist)``: each term of ``nodes(hpo_id)`` with itself at 0 and its ancestors at their least distance."""
    up = closure(links).where("node <> anc").select(F.col("node").alias("term"), "anc", "dist")
    own = nodes.select(F.col("hpo_id").alias("term"), F.col("hpo_id").alias("anc"), F.lit(0).alias("dist"))
    return written(own.unionByName(up), "closed")[0]


def ancestor_sets(closed_terms: DataFrame, include_self: bool = True) -> DataFrame:
    """``(term, ancestors)`` as sorted arrays."""
    rows = closed_terms if include_self else closed_terms.where("dist > 0")
    return rows.groupBy("term").agg(F.array_sort(F.collect_set("anc")).alias("ancestors"))


def common_ancestors(pairs: DataFrame, closed_terms: DataFrame) -> DataFrame:
    """``(a, b, anc, da, db)`` for the term pairs of ``pairs(a, b)``."""
    left = closed_terms.select(F.col("term").alias("a"), "anc", F.col("dist").alias("da"))
    right = closed_terms.select(F.col("term").alias("b"), "anc", F.col("dist").alias("db"))
    return pairs.join(left, "a").join(right, ["b", "anc"]).select("a", "b", "anc", "da", "db")


def longest_depth(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(hpo_id, depth)``: the most links up to a top; nodes that hang on a cycle have none.

    Max-plus doubling: in round k every node knows its longest walk of at most 2**k links. Nodes in or below a
    cycle are taken out first, so that walks end.
    """
    pairs = closure(links)
    looped = pairs.where("node = anc").select(F.col("node").alias("anc")).distinct()
    bad = pairs.join(looped, "anc", "left_semi").select(F.col("node").alias("hpo_id")).distinct()
    good = nodes.join(bad, "hpo_id", "left_anti")
    walks = links.join(bad.select(F.col("hpo_id").alias("child")), "child", "left_anti").select(F.col("child").alias("node"), F.col("parent").alias("anc"), F.lit(1).alias("dist"))
    now, now_path = written(walks.distinct(), "walks")
    while True:
        far = now.select(F.col("node").alias("__n"), F.col("anc").alias("__a"), F.col("dist").alias("__d"))
        hop = now.join(far, F.col("anc") == F.col("__n")).select("node", F.col("__a").alias("anc"), (F.col("dist") + F.col("__d")).alias("dist"))
        grown, new_path = written(now.unionByName(hop).groupBy("node", "anc").agg(F.max("dist").alias("dist")), "walks")
        same = grown.agg(F.sum("dist"), F.count("*")).collect() == now.agg(F.sum("dist"), F.count("*")).collect()
        discard(links.sparkSession, now_path)
        now, now_path = grown, new_path
        if same:
            break
    deep = now.groupBy(F.col("node").alias("hpo_id")).agg(F.max("dist").alias("depth"))
    return good.join(deep, "hpo_id", "left").select("hpo_id", F.coalesce("depth", F.lit(0)).alias("depth"))


def document_frequency(positive: DataFrame, closed_terms: DataFrame) -> DataFrame:
    """``(term, df)``: profiles of ``positive(profile_id, term)`` with at least one term at or below each term."""
    # terms repeat over profiles and ancestors over terms: distinct before counting keeps the shuffle small
    reached = positive.select("profile_id", "term").distinct().join(closed_terms.select("term", "anc"), "term").select("profile_id", "anc").distinct()
    return reached.groupBy(F.col("anc").alias("term")).agg(F.count("*").alias("df"))


def information_content(terms: DataFrame, frequency: DataFrame, profiles: int, root: str | None = None) -> DataFrame:
    """``(term, df, background, ic)`` for ``terms(term)``: background (df + 0.5) / (N + 1) clipped, root fixed; ic = -ln."""
    t = terms.join(frequency, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    raw = F.least(F.greatest((F.col("df") + 0.5) / (profiles + 1.0), F.lit(1e-4)), F.lit(ROOT_BACKGROUND))
    background = F.when(F.col("term") == F.lit(root), F.lit(ROOT_BACKGROUND)).otherwise(raw) if root else raw
    return t.withColumn("background", background).withColumn("ic", -F.log("background"))


def smoothed_ic(terms: DataFrame, frequency: DataFrame, profiles: int) -> DataFrame:
    """``(term, ic)`` with the other smoothing: -ln((df + 1) / (N + 1))."""
    return terms.join(frequency, "term", "left").select("term", (-F.log((F.coalesce("df", F.lit(0)) + 1.0) / (profiles + 1.0))).alias("ic"))


def trunk(closed_terms: DataFrame, stats: DataFrame, root: str) -> tuple[list[str], str | None, float]:
    """The root with what is above it, the most informative of these terms (ties by the larger id), and its information.

    All terms of the branch meet there, so what they have in common through it needs no pair of its own. A handful of rows.
    """
    rows = closed_terms.where(F.col("term") == root).join(stats.select(F.col("term").alias("anc"), "ic"), "anc").select("anc", "ic").collect()
    best = max(((r.ic, r.anc) for r in rows), default=(0.0, None))
    return [r.anc for r in rows], best[1], best[0]


def term_similarity(queries: DataFrame, targets: DataFrame, closed_terms: DataFrame, stats: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """``(q, t, relation, dist, sim, strength)`` for all pairs of ``queries(term)`` and ``targets(term)`` with a common ancestor.

    exact; profile_descendant (q above t); profile_ancestor (t above q): strength max(sim, 0.5 ** dist) with
    sim = IC(t) / IC(q) up to 1; semantic: over the common ancestor with the most information, ties by the larger id,
    sim = strength = IC(mica) / IC(q). Pairs whose best common ancestor has no information are left out, and so are
    pairs that meet only in one of ``skip`` (see :func:`trunk`): through a root, every term would meet every other.
    """
    if skip:
        closed_terms = closed_terms.where(~F.col("anc").isin(skip))
    ic = stats.select("term", "ic")
    left = queries.select("term").distinct().join(closed_terms, "term").select(F.col("term").alias("q"), "anc", F.col("dist").alias("dq"))
    right = targets.select("term").distinct().join(closed_terms, "term").select(F.col("term").alias("t"), "anc", F.col("dist").alias("dt"))
    left = left.join(ic.select(F.col("term").alias("anc"), F.col("ic").alias("ic_anc")), "anc")
    best = left.join(right, "anc").groupBy("q", "t").agg(F.max(F.struct("ic_anc", "anc", "dq", "dt")).alias("m"))
    best = best.join(ic.select(F.col("term").alias("q"), F.col("ic").alias("ic_q")), "q").join(ic.select(F.col("term").alias("t"), F.col("ic").alias("ic_t")), "t")
    pair = closed_terms.where("dist > 0")
    below = pair.select(F.col("term").alias("t"), F.col("anc").alias("q"), F.col("dist").alias("d_below"))
    above = pair.select(F.col("term").alias("q"), F.col("anc").alias("t"), F.col("dist").alias("d_above"))
    rows = best.join(below, ["q", "t"], "left").join(above, ["q", "t"], "left")
    ratio = lambda x: F.when(F.col("ic_q") > LEAST_IC, F.least(F.lit(1.0), x / F.col("ic_q")))
    exact, desc, anc = F.col("q") == F.col("t"), F.col("d_below").isNotNull(), F.col("d_above").isNotNull()
    relation = F.when(exact, "exact").when(desc, "profile_descendant").when(anc, "profile_ancestor").otherwise("semantic")
    dist = F.when(exact, 0).when(desc, F.col("d_below")).when(anc, F.col("d_above")).otherwise(F.col("m.dq") + F.col("m.dt"))
    sim_up = F.coalesce(ratio(F.col("ic_t")), 1.0 / (1.0 + F.col("d_above")))
    sim = F.when(exact | desc, F.lit(1.0)).when(anc, sim_up).otherwise(F.coalesce(ratio(F.col("m.ic_anc")), F.lit(0.0)))
    out = rows.select("q", "t", relation.alias("relation"), dist.cast("int").alias("dist"), sim.alias("sim"), F.col("m.ic_anc").alias("ic_m"))
    out = out.withColumn("strength", F.when(F.col("relation") == "profile_ancestor", F.greatest("sim", F.pow(F.lit(0.5), F.col("dist")))).otherwise(F.col("sim")))
    return out.where((F.col("relation") != "semantic") | (F.col("ic_m") > LEAST_IC)).drop("ic_m")


def organ_group(closed_terms: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """``(term, group_id)``: the smallest ancestor that is a direct child of the root."""
    heads = links.where(F.col("parent") == root).select(F.col("child").alias("anc")).distinct()
    return closed_terms.join(F.broadcast(heads), "anc").groupBy("term").agg(F.min("anc").alias("group_id"))


def resolve_ids(ids: DataFrame, alias: DataFrame) -> DataFrame:
    """``ids`` with ``resolved``: the term each ``id`` means under ``alias(node, target)``; ids without an alias mean themselves."""
    return ids.join(alias, F.col("id") == F.col("node"), "left").select(*ids.columns, F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("target")).alias("resolved"))


def mica(pairs: DataFrame, closed_terms: DataFrame, stats: DataFrame) -> DataFrame:
    """``(a, b, mica, ic)``: the common ancestor with the most information, ties by the larger id."""
    shared = common_ancestors(pairs, closed_terms).join(stats.select(F.col("term").alias("anc"), "ic"), "anc")
    best = shared.groupBy("a", "b").agg(F.max(F.struct("ic", "anc")).alias("m"))
    return best.select("a", "b", F.col("m.anc").alias("mica"), F.col("m.ic").alias("ic"))


def mica_within(rows: DataFrame, key: str, closed_terms: DataFrame, stats: DataFrame) -> DataFrame:
    """``(a, b, mica, ic)``, see :func:`mica`, for each two terms ``a < b`` that a ``key`` of ``rows(key, term)`` has in common.

    Terms are numbered by information and id, so that the best of two terms' common ancestors is the largest number in
    both their lists. The lists meet where a key's terms meet; a pair leaves that join as three numbers, so that no row
    per pair and ancestor is ever made or shuffled.
    """
    numbered = stats.select("term", "ic", F.row_number().over(Window.orderBy("ic", "term")).alias("no"))
    numbered, _ = written(numbered, "numbered")
    above = closed_terms.select("term", "anc").join(broadcast_if_small(numbered.select(F.col("term").alias("anc"), F.col("no").alias("x"))), "anc")
    lists, _ = written(above.groupBy("term").agg(F.collect_set("x").alias("above")).join(broadcast_if_small(numbered.select("term", "no")), "term"), "lists")
    own = rows.select(key, "term").distinct().join(lists, "term")
    a, b = (own.select(key, *[F.col(c).alias(f"{c}_{side}") for c in ("term", "no", "above")]) for side in "ab")
    met = a.join(b, key).where("term_a < term_b").select((F.shiftleft(F.col("no_a").cast("bigint"), 32) + F.col("no_b")).alias("pair"), F.array_max(F.array_intersect("above_a", "above_b")).alias("m"))
    best = met.where("m is not null").distinct().select(F.shiftright("pair", 32).cast("int").alias("na"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("nb"), "m")
    name = lambda c, out, *more: broadcast_if_small(numbered.select(F.col("no").alias(c), F.col("term").alias(out), *more))
    return best.join(name("na", "a"), "na").join(name("nb", "b"), "nb").join(name("m", "mica", "ic"), "m").select("a", "b", "mica", "ic")


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
