"""Parent links turned into full hierarchies by pointer doubling.

Ancestor pointers are joined with themselves again and again, so that the distance they span doubles with each
round and a hierarchy of depth ``n`` takes ``log2(n)`` rounds. Nodes that are still unresolved after a logarithmic
number of rounds hang on a cycle. Each round's table is written to the shared folder, which keeps plans short and
survives lost executors; what a round must know of the last comes from that write's own counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenorank.session import discard, written, written_counting

BLANKS = r"[\s\u00a0\u2000-\u200b\u202f\u205f\u3000\ufeff]+"


def _norm(column) -> F.Column:
    """Ids compare without case and outer blanks; blank is null."""
    text = F.upper(F.trim(F.regexp_replace(column, BLANKS, " ")))
    return F.when(text != "", text)


def follow_pointers(pointers: DataFrame) -> DataFrame:
    """``(node, target)``: where a chain of single pointers ``(node, ptr)`` ends, by pointer doubling.

    A pointer to something that has no pointer of its own ends there; null pointers end the chain at null. Of ``n``
    pointers no chain is longer than ``n``, so what still moves after ``log2(n) + 1`` rounds is on a cycle or runs into
    one: it has no end and is left out. ``pointers`` holds one row per node.
    """
    spark = pointers.sparkSession
    now, path, seen = written_counting(pointers.select("node", "ptr", F.lit(True).alias("moved")), "pointers")
    for _ in range(seen["rows"].bit_length() + 1):
        far = now.select(F.col("node").alias("__n"), F.col("ptr").alias("__p"), F.lit(True).alias("__has"))
        hop = now.join(far, F.col("ptr") == F.col("__n"), "left").select("node", F.when(F.col("__has"), F.col("__p")).otherwise(F.col("ptr")).alias("ptr"), F.coalesce("__has", F.lit(False)).alias("moved"))
        new, new_path, seen = written_counting(hop, "pointers", moved=F.count_if("moved"))
        discard(spark, path)
        now, path = new, new_path
        if not seen["moved"]:
            break
    return now.where("not moved").select("node", F.col("ptr").alias("target"))


def resolved_links(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(terms(hpo_id), links(child, parent))`` over live terms, both distinct.

    Ids compare without case and outer blanks. An alternative id means its term, an obsolete id its ``replaced_by``
    (also over several steps); an id that is neither leads nowhere and gives no link. Null, empty and repeated
    parents and duplicate rows leave nothing behind. A term is obsolete where any of its rows says so.
    """
    t = terms.select(
        _norm(F.col("hpo_id")).alias("id"),
        "parents",
        "alt_ids",
        F.coalesce("is_obsolete", F.lit(False)).alias("gone"),
        _norm(F.col("replaced_by")).alias("replaced"),
    ).where("id is not null")
    state = t.groupBy("id").agg(F.max("gone").alias("gone"), F.min("replaced").alias("replaced"))
    live = state.where("not gone").select("id")
    replaced = state.where("gone").select(F.col("id").alias("node"), F.col("replaced").alias("ptr"))
    alternative = t.select("id", F.explode("alt_ids").alias("alt")).select(_norm(F.col("alt")).alias("node"), F.col("id").alias("ptr")).where("node is not null and node <> ptr")
    alternative = alternative.join(state.select(F.col("id").alias("node")), "node", "left_anti").groupBy("node").agg(F.min("ptr").alias("ptr"))
    alias = follow_pointers(replaced.unionByName(alternative))
    raw = t.where("not gone").select(F.col("id").alias("child"), F.explode("parents").alias("named")).select("child", _norm(F.col("named")).alias("named")).where("named is not null").distinct()
    raw = raw.join(live.select(F.col("id").alias("child")), "child", "left_semi")
    meant = raw.join(alias, raw.named == alias.node, "left").select("child", F.when(F.col("node").isNull(), F.col("named")).otherwise(F.col("target")).alias("parent"))
    links = meant.join(live.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent").distinct()
    return live.select(F.col("id").alias("hpo_id")), written(links, "links")[0]


def _pairs(links: DataFrame) -> DataFrame:
    return links.where("child is not null and parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("anc")).distinct()


def closure(links: DataFrame) -> DataFrame:
    """``(node, anc, dist)``: every ancestor of every node with its least distance, at least 1.

    Pointer doubling: with all pairs up to distance ``d`` known, those exactly ``d`` apart are joined with all others,
    which gives all pairs up to ``2 d``, each only by way of the nodes ``d`` above. It ends when no pair is ``d`` apart,
    cycles or not. A node that is its own ancestor has a pair with itself. Self links count; null links don't.
    """
    spark = links.sparkSession
    now, path, seen = written_counting(_pairs(links).withColumn("dist", F.lit(1)), "closure")
    reach, edge = 1, seen["rows"]
    while edge:
        far = now.select(F.col("node").alias("__n"), F.col("anc").alias("__a"), F.col("dist").alias("__d"))
        hop = now.where(F.col("dist") == reach).join(far, F.col("anc") == F.col("__n")).select("node", F.col("__a").alias("anc"), (F.lit(reach) + F.col("__d")).alias("dist"))
        grown = now.unionByName(hop).groupBy("node", "anc").agg(F.min("dist").alias("dist"))
        reach *= 2
        new, new_path, seen = written_counting(grown, "closure", edge=F.count_if(F.col("dist") == reach))
        discard(spark, path)
        now, path, edge = new, new_path, seen["edge"]
    return now


def _jumped(jumps: DataFrame) -> DataFrame:
    """From the pairs that ``d`` links join, those that ``2 d`` links join."""
    far = jumps.select(F.col("node").alias("__n"), F.col("anc").alias("__a"))
    return jumps.join(far, F.col("anc") == F.col("__n")).select("node", F.col("__a").alias("anc")).distinct()


def _both_ways(jumps: DataFrame) -> DataFrame:
    """The pairs whose lower end has something below it, and whose upper end has something above it."""
    inner = jumps.join(jumps.select(F.col("anc").alias("node")).distinct(), "node", "left_semi")
    return inner.join(jumps.select(F.col("node").alias("anc")).distinct(), "anc", "left_semi").select("node", "anc")


def unresolved(links: DataFrame) -> tuple[DataFrame, str, int]:
    """The ``links(child, parent)`` that pointer doubling doesn't resolve, with their table's path and number.

    Round ``k`` holds the pairs of a node and the nodes ``2**k`` links above it, over all parents at once; pairs that
    don't go on both ways are dropped, since a cycle goes on for ever. Without cycles the pairs run out after
    ``log2(depth)`` rounds; with cycles the rounds end when none is dropped any more, or when there are no more pairs
    than links in a jump. The rounds are logarithmic, and no set of all ancestors is built: of a tree, a round never
    has more pairs than nodes. What is left holds every cycle, and at most a few links that lead from one to another.
    """
    spark = links.sparkSession
    jumps, path, seen = written_counting(_both_ways(_pairs(links)), "jumps")
    reach, before = 1, seen["rows"] + 1
    while reach < seen["rows"] < before:
        before = seen["rows"]
        far, far_path = written(_jumped(jumps), "jumps")
        new, new_path, seen = written_counting(_both_ways(far), "jumps")
        discard(spark, path, far_path)
        jumps, path = new, new_path
        reach *= 2
    nodes = jumps.select("node").unionByName(jumps.select(F.col("anc").alias("node"))).distinct()
    inner = links.select("child", "parent").join(nodes.select(F.col("node").alias("child")), "child", "left_semi")
    inner = inner.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("child", "parent").distinct()
    out, out_path, seen = written_counting(inner, "links")
    discard(spark, path)
    return out, out_path, seen["rows"]


_NONE = "cast(null as string)"


def _spread(least: DataFrame, jumps: DataFrame) -> DataFrame:
    """``least(node, up, down, u, d)`` with the smallest ids seen over one more jump; u and d are kept."""
    above = jumps.join(least.select(F.col("node").alias("anc"), "up"), "anc").selectExpr("node", "up", f"{_NONE} down", f"{_NONE} u", f"{_NONE} d")
    below = jumps.join(least.select("node", "down"), "node").selectExpr("anc node", f"{_NONE} up", "down", f"{_NONE} u", f"{_NONE} d")
    return least.unionByName(above).unionByName(below).groupBy("node").agg(F.min("up").alias("up"), F.min("down").alias("down"), F.max("u").alias("u"), F.max("d").alias("d"))


def _least_both_ways(links: DataFrame) -> DataFrame:
    """``(node, up, down)``: the smallest id above and below each node, by pointer doubling; null where there is none.

    A table holds the jumps and the smallest ids side by side, so that a round is one write. A round without a change
    is the last: an id that lies further off would have reached a node on the way to it.
    """
    spark = links.sparkSession
    pairs = _pairs(links)
    ends = pairs.selectExpr("node", "anc up", f"{_NONE} down").unionByName(pairs.selectExpr("anc node", f"{_NONE} up", "node down"))
    jump_rows = "node", "anc", f"{_NONE} up", f"{_NONE} down", "false moved"
    start = ends.groupBy("node").agg(F.min("up").alias("up"), F.min("down").alias("down")).selectExpr("node", f"{_NONE} anc", "up", "down", "true moved")
    state, path = written(start.unionByName(pairs.selectExpr(*jump_rows)), "least")
    while True:
        jumps = state.where("anc is not null").select("node", "anc")
        least = state.where("anc is null").selectExpr("node", "up", "down", "up u", "down d")
        twice = _jumped(jumps)
        wider = _spread(_spread(least, jumps), twice).selectExpr("node", f"{_NONE} anc", "up", "down", "not (up <=> u and down <=> d) moved")
        new, new_path, seen = written_counting(wider.unionByName(_jumped(twice).selectExpr(*jump_rows)), "least", moved=F.count_if("moved"))
        discard(spark, path)
        state, path = new, new_path
        if not seen["moved"]:
            return state.where("anc is null").select("node", "up", "down")


def cycles(links: DataFrame) -> DataFrame:
    """``(hpo_id, cycle_id)`` of the nodes that are their own ancestor.

    ``cycle_id`` is the smallest id among the nodes that are both ancestor and descendant of the node, itself
    included. Among the unresolved nodes the smallest id above and below each is worked out, again by doubling: where
    the two are one, it is that id. Nodes of one cycle agree in both, so only links between nodes that agree are looked
    at once more; that goes on as long as cycles hang on cycles with smaller ids.
    """
    spark = links.sparkSession
    done: list[DataFrame] = []
    left = links
    while True:
        inner, path, n = unresolved(left)
        if not n:
            break
        least = _least_both_ways(inner)
        done.append(least.where("up = down").select(F.col("node").alias("hpo_id"), F.col("up").alias("cycle_id")))
        open_ = least.where("up <> down").select("node", F.struct("up", "down").alias("c"))
        below, above = open_.withColumnsRenamed({"node": "child"}), open_.withColumnsRenamed({"node": "parent", "c": "p"})
        left, _, seen = written_counting(inner.join(below, "child").join(above, "parent").where("c = p").select("child", "parent"), "links")
        discard(spark, path)
        if not seen["rows"]:
            break
    if not done:
        return links.select(F.col("child").alias("hpo_id"), F.col("parent").alias("cycle_id")).where("false")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def paths(nodes: DataFrame, links: DataFrame, separator: str = "/") -> DataFrame:
    """``(hpo_id, path, depth, root, in_cycle, n_descendants)``, one row per node.

    ``depth`` is the least number of links to a top (a node without a parent); among the parents on a shortest way
    the smallest id is followed, so that ``path`` (top first), ``depth`` and ``root`` are well defined also where
    terms have several parents. Path segments are concatenated while pointers double. A node whose every way up
    ends in a cycle has null ``path``, ``depth`` and ``root``; ``in_cycle`` says whether it lies on one itself.
    ``n_descendants`` counts distinct descendants without the node itself.
    """
    spark = links.sparkSession
    pairs = closure(links)
    tops = nodes.join(links.select(F.col("child").alias("hpo_id")).distinct(), "hpo_id", "left_anti")
    depth = (
        pairs.join(tops.select(F.col("hpo_id").alias("anc")), "anc", "left_semi")
        .groupBy("node")
        .agg(F.min("dist").alias("depth"))
        .unionByName(tops.select(F.col("hpo_id").alias("node"), F.lit(0).alias("depth")))
    )
    depth, depth_path = written(depth, "depth")
    up = depth.select(F.col("node").alias("parent"), F.col("depth").alias("__pd"))
    step = links.join(depth, links.child == depth.node).join(up, "parent").where("__pd = depth - 1").groupBy("child").agg(F.min("parent").alias("ptr"))
    start = depth.select("node").join(step, F.col("node") == F.col("child"), "left").select("node", "ptr", F.array("node").alias("segments"))
    now, path, seen = written_counting(start, "paths", open=F.count("ptr"))
    while seen["open"]:
        far = now.select(F.col("node").alias("__n"), F.col("ptr").alias("__p"), F.col("segments").alias("__s"))
        hop = now.join(far, F.col("ptr") == F.col("__n"), "left").select(
            "node", F.col("__p").alias("ptr"), F.when(F.col("__s").isNull(), F.col("segments")).otherwise(F.concat("__s", "segments")).alias("segments")
        )
        new, new_path, seen = written_counting(hop, "paths", open=F.count("ptr"))
        discard(spark, path)
        now, path = new, new_path
    tree = now.select(F.col("node").alias("hpo_id"), F.array_join("segments", separator).alias("path"), (F.size("segments") - 1).alias("depth"), F.col("segments")[0].alias("root"))
    below = pairs.where("node <> anc").groupBy(F.col("anc").alias("hpo_id")).agg(F.count("*").alias("n_descendants"))
    loop = pairs.where("node = anc").select(F.col("node").alias("hpo_id"), F.lit(True).alias("in_cycle"))
    return (
        nodes.join(tree, "hpo_id", "left")
        .join(loop, "hpo_id", "left")
        .join(below, "hpo_id", "left")
        .select("hpo_id", "path", "depth", "root", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants"))
    )


def descendants(links: DataFrame) -> DataFrame:
    """``(hpo_id, descendant_id, distance)``: all descendants of each node, with their least distance."""
    return closure(links).where("node <> anc").select(F.col("anc").alias("hpo_id"), F.col("node").alias("descendant_id"), F.col("dist").alias("distance"))


def found(spark: SparkSession, terms: DataFrame) -> DataFrame:
    """``(hpo_id, cycle_id)`` for a table of terms; see :func:`resolved_links` and :func:`cycles`."""
    return cycles(resolved_links(terms)[1])
