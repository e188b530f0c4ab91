"""Clinical text: dictionary scan, spans, assertion cues, numbers with units, catalogue search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenorank.functions.scalars import normalize_text
from phenorank.session import broadcast_if_small

# What marks a finding as suspected, and what ends its left context.
SUSPECTED_CUES = r"1\s*phần|một\s*phần|1\s*phan|mot\s*phan|theo\s*dõi|theo\s*doi|t/d|td|nghi\s*ngờ|nghi\s*ngo|nghi"
#: Different first words of phrases up to which places are picked by them before anything is joined.
MOST_FIRSTS = 4096
DELIMITERS = r"\-–—;\n/.,+"


def dictionary_scan(texts: DataFrame, lexicon: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, term, first, last)``: every place where a phrase of ``lexicon(term, phrase)`` stands as whole words.

    Phrases are looked up by their first two words (one-word phrases by it), then compared as a whole, so a text is
    exploded into its words once whatever the number and length of phrases.
    """
    words = F.filter(F.split(normalize_text(F.col("phrase")), " "), lambda x: x != "")
    lex = lexicon.select("term", words.alias("w")).where("size(w) > 0").distinct()
    lex = lex.select("term", "w", F.when(F.size("w") > 1, F.concat_ws(" ", F.col("w")[0], F.col("w")[1])).otherwise(F.col("w")[0]).alias("head"))
    tokens = texts.where(F.col(column).isNotNull()).select(key, F.filter(F.split(normalize_text(F.col(column)), " "), lambda x: x != "").alias("t")).where("size(t) > 0")
    places = F.sequence(F.lit(0), F.size("t") - 1)
    firsts, longest = lex.agg(F.collect_set(F.col("w")[0]), F.coalesce(F.max(F.size("w")), F.lit(1))).collect()[0]
    if len(firsts) <= MOST_FIRSTS:  # no phrase begins elsewhere
        places = F.filter(places, lambda i: F.get("t", i).isin(firsts))
    pairs = F.transform(places, lambda i: F.struct(i.alias("first"), F.slice("t", i + 1, longest).alias("next")))
    at = tokens.select(key, F.explode(pairs).alias("p")).select(key, F.col("p.first").alias("first"), F.col("p.next").alias("next"))
    heads = F.explode(F.array_distinct(F.array(F.col("next")[0], F.concat_ws(" ", F.col("next")[0], F.get("next", F.lit(1))))))
    hits = at.select(key, "first", "next", heads.alias("head")).join(broadcast_if_small(lex), "head")
    return hits.where(F.slice("next", 1, F.size("w")) == F.col("w")).select(key, "term", "first", (F.col("first") + F.size("w") - 1).alias("last")).distinct()


def greedy_spans(spans: DataFrame, key: str) -> DataFrame:
    """Of ``spans(key, term, first, last)`` the longest from each start, left to right without overlap; ties by term.

    Spans are sorted within the partitions that hold their texts and folded as a stream: what is kept in mind is the
    end of the last span taken, however long a text is.
    """
    w = Window.partitionBy(key, "first").orderBy(F.col("last").desc(), "term")
    longest = spans.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, end = None, -1
        for pdf in batches:
            keep = []
            for k, first, last in zip(pdf[key].tolist(), pdf["first"].tolist(), pdf["last"].tolist(), strict=True):
                if k != of:
                    of, end = k, -1
                keep.append(first > end)
                if first > end:
                    end = last
            yield pdf[keep]

    return longest.repartition(key).sortWithinPartitions(key, "first").mapInPandas(fold, longest.schema)


def cue_assertion(mention: Column, left: Column | None = None) -> Column:
    """``(status, cue, place)``: SUSPECTED with the cue that stands in the mention, or left of it since the last delimiter; else PRESENT.

    ``place`` is 'mention' or 'context', null for PRESENT. Accents must be composed (``scalars.nfc``).
    """
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}_])({SUSPECTED_CUES})(?![\p{{L}}\p{{N}}_])"
    inside = F.nullif(F.regexp_extract(mention, pattern, 1), F.lit(""))
    before = F.nullif(F.regexp_extract(F.regexp_extract(left, rf"[^{DELIMITERS}]*$", 0), pattern, 1), F.lit("")) if left is not None else F.lit(None).cast("string")
    cue = F.coalesce(inside, before)
    return F.struct(F.when(cue.isNotNull(), "SUSPECTED").otherwise("PRESENT").alias("status"), cue.alias("cue"), F.when(inside.isNotNull(), "mention").when(before.isNotNull(), "context").alias("place"))


def cautious_context(left: Column) -> Column:
    """Whether the last clause left of a span denies, or speaks of someone else."""
    clause = F.regexp_extract(left, r"[^.;,\n]*$", 0)
    return F.coalesce(clause.rlike(r"(?iU)(?<!\w)(?:không|chưa|mẹ|cha|gia đình|tiền sử)(?!\w)"), F.lit(False))


def catalog_search(queries: DataFrame, catalog: DataFrame, top: int = 20) -> DataFrame:
    """``(query_id, id, score, rank)``: catalogue entries for each query, the best score per entry first, ties by length of ``vi``, then id.

    ``queries(query_id, query)``, ``catalog(id, vi, en, synonyms)``. Score -10: the query is the id; 0: it equals ``vi``;
    1: ``en``; 2: it stands in ``vi`` as whole words; 3: each of its words begins a word of ``vi``; 4: it stands anywhere
    in ``en``, or begins the id; 5: it stands anywhere in the synonyms. Empty queries find nothing. A query is joined with
    the entries that hold its first three characters somewhere (fewer, if it has fewer), so no pair without a chance is built.
    """
    q = queries.select("query_id", F.upper(F.trim("query")).alias("asked"), normalize_text(F.col("query")).alias("q")).where("q <> ''")
    text = lambda c: F.coalesce(normalize_text(F.col(c)), F.lit(""))
    c = catalog.where("id is not null").select("id", text("vi").alias("vi"), text("en").alias("en"), text("synonyms").alias("syn")).distinct()
    grams = lambda x: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.length(x) + 1), lambda i: F.substring(x, i, n))))
    keys = c.select("id", F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col(x)) for x in ("vi", "en", "syn")])))).alias("__k")).where("__k <> ''")
    words = F.split("q", " ")
    by_text = q.select("query_id", F.explode(F.array_distinct(F.array(F.substring("q", 1, 3), F.substring(words[0], 1, 3)))).alias("__k")).join(keys, "__k").select("query_id", "id")
    by_id = q.select("query_id", "asked").join(c.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("id")), lambda n: F.substring("id", 1, n))).alias("asked")), "asked").select("query_id", "id")
    pairs = by_text.unionByName(by_id).distinct().join(q, "query_id").join(c, "id")
    prefix = F.forall(words, lambda x: F.exists(F.split("vi", " "), lambda y: y.startswith(x)))
    score = (
        F.when(F.col("id") == F.col("asked"), -10)
        .when(F.col("q") == F.col("vi"), 0)
        .when(F.col("q") == F.col("en"), 1)
        .when(F.concat(F.lit(" "), "vi", F.lit(" ")).contains(F.concat(F.lit(" "), "q", F.lit(" "))), 2)
        .when(prefix, 3)
        .when(F.col("en").contains(F.col("q")) | F.col("id").startswith(F.col("asked")), 4)
        .when(F.col("syn").contains(F.col("q")), 5)
    )
    best = pairs.withColumn("score", score).where("score is not null").groupBy("query_id", "id").agg(F.min(F.struct("score", F.length("vi").alias("len"))).alias("m"))
    w = Window.partitionBy("query_id").orderBy("m.score", "m.len", "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "id", F.col("m.score").alias("score"), "rank")


def align_uniquely(text: str, phrases: list[str]) -> list[tuple[int, int]] | None:
    """The one way to place all phrases in the text in order without overlap, as half-open spans; None for no way or several.

    Phrases stand between characters that aren't part of words. Counts ways from the right, stopping at two.
    """

    def places(phrase: str) -> list[int]:
        out, at = [], text.find(phrase) if phrase else -1
        while at >= 0:
            end = at + len(phrase)
            if not (at and text[at - 1].isalnum() and phrase[0].isalnum()) and not (end < len(text) and text[end].isalnum() and phrase[-1].isalnum()):
                out.append(at)
            at = text.find(phrase, at + 1)
        return out

    options = [places(p) for p in phrases]
    ways: list[dict[int, int]] = [dict() for _ in phrases]
    for k in range(len(phrases) - 1, -1, -1):
        for at in options[k]:
            end = at + len(phrases[k])
            ways[k][at] = 1 if k == len(phrases) - 1 else min(2, sum(n for nxt, n in ways[k + 1].items() if nxt >= end))
    if not phrases or sum(ways[0].values()) != 1:
        return [] if not phrases else None
    out, low = [], 0
    for k, phrase in enumerate(phrases):
        at = next(a for a in options[k] if a >= low and ways[k].get(a))
        out.append((at, at + len(phrase)))
        low = at + len(phrase)
    return out


def largest_matching(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A largest set of (left, right) edges no two of which share an end, by augmenting paths."""
    near: dict[int, list[int]] = {}
    for a, b in sorted(set(edges)):
        near.setdefault(a, []).append(b)
    owner: dict[int, int] = {}
    for start in near:
        parent: dict[int, int] = {}
        todo, free = [start], None
        seen: set[int] = set()
        while todo and free is None:
            a = todo.pop()
            for b in near[a]:
                if b in seen:
                    continue
                seen.add(b)
                parent[b] = a
                if b not in owner:
                    free = b
                    break
                todo.append(owner[b])
        while free is not None:
            a = parent[free]
            free_next = next((b for b, x in owner.items() if x == a), None)
            owner[free] = a
            if a == start:
                break
            free = free_next
    return sorted((a, b) for b, a in owner.items())


def largest_span_matching(left: list[tuple[int, int, object]], right: list[tuple[int, int, object]]) -> list[tuple]:
    """A largest set of (left, right) ids of spans ``(start, end, id)`` that overlap, no two of which share a span, without a list of edges.

    In the order of ends, each span takes the open one of the other side that ends first: what overlaps that one overlaps
    every other that it could take, so no other choice leaves more.
    """
    spans = sorted([(end, start, 0, name) for start, end, name in left] + [(end, start, 1, name) for start, end, name in right], key=lambda s: (s[0], s[1], s[2], s[3]))
    begins = [sorted((start, k) for k, (_, start, side, _) in enumerate(spans) if side == own) for own in (0, 1)]
    opened, at, taken, out = ([], []), [0, 0], bytearray(len(spans)), []
    for k, (end, _, side, name) in enumerate(spans):
        if taken[k]:
            continue
        other = 1 - side
        while at[other] < len(begins[other]) and begins[other][at[other]][0] < end:
            heapq.heappush(opened[other], begins[other][at[other]][1])
            at[other] += 1
        while opened[other] and (taken[opened[other][0]] or opened[other][0] < k):
            heapq.heappop(opened[other])
        if opened[other]:
            mate = heapq.heappop(opened[other])
            taken[k] = taken[mate] = 1
            out.append((name, spans[mate][3]) if side == 0 else (spans[mate][3], name))
    return sorted(out)


def matched_intervals(spans: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """``(key, left_id, right_id)``: a largest matching per key of the overlapping spans of ``spans(key, id, start, end, found)``, found ones being the left.

    Keys without spans of both sides are left out before, the others go to Python by the bucket.
    """
    rows = spans.where("found is not null").select(key, "id", "start", "end", "found")
    both = rows.groupBy(key).agg(F.min("found").alias("a"), F.max("found").alias("b")).where("a <> b").select(key)
    rows = rows.join(both, key, "left_semi").withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    schema = rows.select(key, F.col("id").alias("left_id"), F.col("id").alias("right_id")).schema

    def match(table: pa.Table) -> pa.Table:
        sides: dict[object, tuple[list, list]] = {}
        for name, found, *span in zip(*(table.column(c).to_pylist() for c in (key, "found", "start", "end", "id")), strict=True):
            sides.setdefault(name, ([], []))[0 if found else 1].append(tuple(span))
        out = []
        for name, (left, right) in sides.items():
            if all(len({x[2] for x in side}) == len(side) for side in (left, right)):
                pairs = largest_span_matching(left, right)
            else:  # one id with several spans is one end of an edge
                pairs = largest_matching([(x[2], y[2]) for x in left for y in right if x[0] < y[1] and y[0] < x[1]])
            out.extend((name, *pair) for pair in pairs)
        kinds = [table.schema.field(c).type for c in (key, "id", "id")]
        return pa.table([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=[key, "left_id", "right_id"])

    return rows.groupBy("__b").applyInArrow(match, schema)


def matched_spans(edges: DataFrame, key: str) -> DataFrame:
    """``(key, left_id, right_id)``: a largest matching of overlapping spans per key, from ``overlaps`` edges."""
    schema = edges.select(key, "left_id", "right_id").schema

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = largest_matching(list(zip(pdf["left_id"].tolist(), pdf["right_id"].tolist(), strict=True)))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(pairs), "left_id": [p[0] for p in pairs], "right_id": [p[1] for p in pairs]})

    return edges.select(key, "left_id", "right_id").groupBy(key).applyInPandas(match, schema)


def extract_with(texts: DataFrame, key: str, column: str, extractor) -> DataFrame:
    """``(key, phrase)`` of the phrases that a caller's ``extractor(text) -> list[str]`` names, where they stand in the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, p) for k, t in zip(pdf[key], pdf[column], strict=True) if t is not None for p in extractor(t) if p and p in t]
            yield pd.DataFrame(rows, columns=[key, "phrase"])

    from pyspark.sql.types import StringType, StructType

    slim = texts.select(key, column)
    return slim.mapInPandas(run, StructType([slim.schema[key], *StructType().add("phrase", StringType()).fields]))
