"""Splits that keep related records together: distributed union-find, then greedy assignment of whole groups.

Records and the values they share are the nodes of a graph. Every task builds a forest of its own part with
union-find; only the roots of trees that meet trees of other tasks go to the next level, where fewer tasks merge
them, until nothing is left to merge. The levels' pointers are then followed down again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenorank.session import discard, written

#: Edges that one task merges at once.
TASK_EDGES = 250_000
#: Rows that one task ranks at once, and from which a group's rows are spread over tasks.
TASK_ROWS = 100_000

# What stands for "not known" in an id column, in lower case.
NOT_GIVEN = [
    "", "-", "--", "?", "??", ".", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "missing", "unknown", "unk", "unspecified", "undefined",
    "not given", "not known", "not available", "not applicable", "not recorded", "not reported", "no id", "tbd", "không rõ", "không có", "không biết",
    "không", "chưa rõ", "chưa có", "k rõ", "khong ro", "khong co", "inconnu", "inconnue", "non renseigné", "aucun",
]


def shared_value(column: str) -> F.Column:
    """The value as it is compared: without case and outer blanks, null where it only says that nothing is known."""
    value = F.lower(F.trim(F.regexp_replace(F.col(column), r"[\s\p{Z}]+", " ")))
    return F.when(~value.isin(NOT_GIVEN), value)


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a task's edges (a, b): each node with the root of its tree, the root of least rank."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def rank(x: int) -> int:  # a fixed scramble, so that chains of rising ids shrink as fast as any other
        return (x * 0x9E3779B97F4A7C15 ^ (x >> 29)) & 0xFFFFFFFFFFFFFFFF

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                if rank(rb) < rank(ra):
                    ra, rb = rb, ra
                up[rb] = ra
    nodes = list(up)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "root": pd.Series([root(x) for x in nodes], dtype="int64")})


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(node, label)`` for the nodes of ``edges(a, b)`` (bigint): nodes joined by a chain of edges share a label.

    Null ends and repeated edges are fine; a node with only an edge to itself is a component of its own. A level
    whose edges fit one task ends the merging; until then each level keeps only roots that met other trees, and of
    those a fixed share drops out at every level, however the edges are laid out.
    """
    spark = edges.sparkSession
    level = edges.where("a is not null and b is not null").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).distinct()
    level, path = written(level, "edges")
    pointers: list[tuple[DataFrame, str]] = []
    left = level.count()
    while left:
        tasks = max(1, math.ceil(left / task_edges))
        forest, forest_path = written(level.repartition(tasks, F.xxhash64("a", F.lit(len(pointers)))).mapInPandas(_forest, "node bigint, root bigint"), "forest")
        best = forest.groupBy("node").agg(F.expr("min_by(root, xxhash64(root))").alias("target"), F.min("root").alias("low"), F.max("root").alias("high"))
        best, best_path = written(best, "pointers")
        discard(spark, path)
        pointers.append((best.select("node", "target"), best_path))
        shared = best.where("low <> high").select("node", "target")
        merged = forest.join(shared, "node").where("root <> target").select(F.col("root").alias("a"), F.col("target").alias("b")).distinct()
        level, path = written(merged, "edges")
        discard(spark, forest_path)
        left = level.count() if tasks > 1 else 0
    if not pointers:
        return level.select(F.col("a").alias("node"), F.col("b").alias("label"))
    discard(spark, path)
    labels = pointers[-1][0].select("node", F.col("target").alias("label"))
    for down, _ in reversed(pointers[:-1]):
        above = labels.select(F.col("node").alias("target"), "label")
        labels = down.join(above, "target", "left").select("node", F.coalesce("label", "target").alias("label"))
    out, _ = written(labels, "labels")
    discard(spark, *[p for _, p in pointers])
    return out


def _ties(cases: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(id, a, b)``: each record's node with the node of each value it shares; with itself where it has none."""
    values = F.array(*[F.when(shared_value(c).isNotNull(), F.xxhash64(F.lit(f"value {i}"), shared_value(c))) for i, c in enumerate(columns)])
    node = F.xxhash64(F.lit("record"), F.col(key))
    return cases.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), node.alias("a"), F.explode(F.array_append(F.filter(values, lambda x: x.isNotNull()), node)).alias("b"))


def with_hot_split(rows: DataFrame, groups: DataFrame, key: str, size: str, hot: int = TASK_ROWS) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per ``key``), the few groups above ``hot`` rows by broadcast.

    Of ``n`` rows at most ``n / hot`` groups can be that large, which bounds the broadcast; all others are shuffled.
    """
    large = groups.where(F.col(size) > hot)
    small = groups.where(F.col(size) <= hot)
    return rows.join(F.broadcast(large), key).unionByName(rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key))


def tied_sets(cases: DataFrame, key: str = "case_id", columns: tuple[str, ...] = ("patient_id", "family_id", "group_id")) -> DataFrame:
    """``(key, set_id, set_size)``: one row per record with the smallest key of all records tied to it, and their number.

    Records are tied by an equal value of a column, or a chain of such; null and not-given values tie nothing. Null
    keys are left out; repeated rows of a key are one record, with the ties of all of them.
    """
    ties = _ties(cases, key, list(columns))
    labels = components(ties.select("a", "b"))
    ids = ties.select("id", "a").distinct().join(labels.withColumnRenamed("node", "a"), "a").select("id", "label")
    ids, _ = written(ids, "members")
    groups = ids.groupBy("label").agg(F.min("id").alias("set_id"), F.count("*").alias("set_size"))
    return with_hot_split(ids, groups, "label", "set_size").select(F.col("id").alias(key), "set_id", "set_size")


def found(spark: SparkSession, cases: DataFrame) -> DataFrame:
    """``(case_id, set_id)`` of the cases tied to at least one other."""
    return tied_sets(cases).where("set_size > 1").select("case_id", "set_id")


def quotas(histogram: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, list[tuple[str, int]]]:
    """For each group size, how many groups go to each split when the largest go first, each to the split furthest below its target.

    ``histogram`` has (size, number of groups). Groups of one size are alike, so the greedy order within a size is
    settled at once: the split gaps are levelled from above, ties in the order of ``shares``.
    """
    total = sum(s * n for s, n in histogram)
    weight = sum(shares.values())
    gap = {k: total * v / weight for k, v in shares.items()}
    out: dict[int, list[tuple[str, int]]] = {}
    for size, n in sorted(histogram, reverse=True):
        taken = dict.fromkeys(shares, 0)
        left = n
        if n > 10_000:  # level in bulk, then finish one by one
            low, high = min(gap.values()) - size * n, max(gap.values())
            for _ in range(100):
                mid = (low + high) / 2
                if sum(max(0, math.floor((g - mid) / size)) for g in gap.values()) > n:
                    low = mid
                else:
                    high = mid
            for k in shares:
                taken[k] = max(0, math.floor((gap[k] - high) / size))
                gap[k] -= taken[k] * size
            left -= sum(taken.values())
        for _ in range(left):
            k = max(shares, key=lambda x: gap[x])
            taken[k] += 1
            gap[k] -= size
        out[size] = list(taken.items())
    return out


def split_groups(cases: DataFrame, shares: dict[str, float] | None = None, key: str = "case_id", columns: tuple[str, ...] = ("patient_id", "family_id", "group_id"), seed: int = 17) -> DataFrame:
    """``(key, set_id, split)``: a split for each record, tied records always in the same one.

    The histogram of group sizes (at most ``sqrt(2 n)`` rows for ``n`` records) goes to the driver, which works out
    how many groups of each size each split gets; within a size the groups are ranked by a seeded hash, in buckets
    that one task can hold.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    spark = cases.sparkSession
    sets, _ = written(tied_sets(cases, key, columns), "sets")
    groups = sets.where(F.col(key) == F.col("set_id")).select("set_id", "set_size").withColumn("order", F.xxhash64(F.lit(seed), "set_id"))
    histogram = [(r[0], r[1]) for r in groups.groupBy("set_size").count().collect()]
    if not histogram:
        return sets.select(key, "set_id", F.lit(None).cast("string").alias("split"))
    most = max(n for _, n in histogram)
    buckets = 1 << max(0, math.ceil(math.log2(max(1, most / TASK_ROWS))) + 1)
    groups = groups.withColumn("bucket", F.pmod(F.shiftrightunsigned(F.col("order"), 32), F.lit(buckets)))
    from pyspark.sql import Window

    per = groups.groupBy("set_size", "bucket").count()
    per = per.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("set_size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("set_size", "bucket").orderBy("order", "set_id"))).join(
        per.select("set_size", "bucket", "before"), ["set_size", "bucket"]
    )
    rows = []
    for size, given in quotas(histogram, shares).items():
        at = 0
        for name, n in given:
            if n:
                rows.append((size, at, at + n, name))
            at += n
    table = F.broadcast(spark.createDataFrame(rows, "set_size bigint, first bigint, past bigint, split string"))
    place = ranked.withColumn("at", F.col("before") + F.col("rank") - 1).join(table, "set_size").where("at >= first and at < past").select("set_id", F.col("set_size").alias("n"), "split")
    return with_hot_split(sets.select(key, "set_id"), place, "set_id", "n").select(key, "set_id", "split")
