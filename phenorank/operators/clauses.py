"""Rules over clauses of reports: phrases with offsets, clauses, assertion, subject, attributes, measurements, link decision.

All rules but the phrase search are column expressions over normalised text (``scalars.normalize_text``), so any number
of clauses is judged in one pass without a shuffle. Null text gives null or the rule's default, as each says.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenorank.functions.scalars import plain_text
from phenorank.session import BROADCAST_BYTES

# What a clause says of a finding, in the order in which equally specific phrases win.
ASSERTIONS: list[tuple[str, list[str]]] = [
    ("NOT_ASSESSED", ["han che danh gia", "khong danh gia duoc", "chua danh gia", "kho danh gia", "khong khao sat duoc", "chua khao sat", "khong quan sat duoc", "khong thay ro"]),
    ("SUSPECTED", ["khong loai tru", "chua loai tru", "nghi ngo", "nghi", "goi y", "co kha nang", "co the", "theo doi"]),
    ("ABSENT", ["chua ghi nhan", "khong ghi nhan", "khong phat hien", "khong thay", "khong co", "loai tru", "am tinh"]),
]
# Methods and attributes by the words that stand for them, the first that fits.
METHODS = {"ultrasound": ["sieu am", "ultrasound", "sonography"], "mri": ["mri", "cong huong tu"], "ct": ["ct scan", "chup ct", "cat lop vi tinh"], "clinical_exam": ["kham lam sang", "tham kham"]}
LATERALITY = {"bilateral": ["hai ben", "ca hai ben", "song phuong", "bilateral"], "left": ["ben trai", "left sided", "left"], "right": ["ben phai", "right sided", "right"], "unilateral": ["mot ben", "unilateral"]}
SEVERITY = {"severe": ["rat nang", "muc do nang", "severe"], "moderate": ["muc do vua", "trung binh", "moderate"], "mild": ["muc do nhe", "nhe", "mild"]}
DISTRIBUTION = {"diffuse": ["lan toa", "diffuse"], "focal": ["khu tru", "focal"]}
PROGRESSION = {"progressive": ["tien trien", "progressive"], "stable": ["on dinh", "stable"]}
# Whom a clause speaks of, as whole words, the first that fits.
SUBJECTS: list[tuple[str, str, list[str]]] = [
    ("family_history", "family_context_rule", ["tien su gia dinh", "con truoc", "anh chi em", "bo cua thai", "nguoi than", "family history"]),
    ("fetus", "explicit_fetal_context_rule", ["thai nhi", "fetal", "bao thai", "em be"]),
    ("mother", "maternal_context_rule", ["thai phu", "san phu", "nguoi me", "me bi", "me co", "maternal"]),
    ("fetus", "fetal_context_rule", ["thai co", "thai ghi nhan", "tren thai", "o thai"]),
]
DEFAULT_SUBJECT = ("fetus", "prenatal_fetus_default")
# The name under which a measurement in a unit is kept.
MEASURES = {"mm": "width_mm", "cm": "length_cm", "g": "weight_g", "kg": "weight_kg", "bpm": "heart_rate_bpm", "%": "percent"}
# What ends a clause, and words that may stand between the words of a phrase.
BOUNDARY = r"[,;.!?\n\r]|\b(?:nhưng|nhung|tuy\s+nhiên|tuy\s+nhien)\b"
REPORTING, MOST_SKIPPED = frozenset({"co", "duoc"}), 2
ABSTAIN_BELOW, REVIEW_BELOW, AMBIGUOUS_WITHIN = 0.55, 0.85, 0.05


def _padded(normal: Column) -> Column:
    return F.concat(F.lit(" "), normal, F.lit(" "))


def assertion(normal: Column) -> Column:
    """``(status, trigger)`` of a normalised clause: the phrase with the most words, then characters, then first in order; else PRESENT, null."""
    padded = _padded(normal)
    at = 0
    hits = []
    for priority, (status, phrases) in enumerate(ASSERTIONS):
        for phrase in phrases:
            key = [F.lit(x) for x in (len(phrase.split()), len(phrase), -priority, -at)]
            hits.append(F.when(padded.contains(f" {phrase} "), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)], F.lit(status).alias("status"), F.lit(phrase).alias("trigger"))))
            at += 1
    best = F.array_max(F.array_compact(F.array(*hits)))
    return F.struct(F.coalesce(best["status"], F.lit("PRESENT")).alias("status"), best["trigger"].alias("trigger"))


def _first(normal: Column, rules: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(rules.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | normal.contains(word)
        out = F.when(hit, name).otherwise(out)
    return out


def laterality(normal: Column) -> Column:
    """bilateral, left, right, unilateral or null."""
    return _first(normal, LATERALITY)


def severity(normal: Column) -> Column:
    """severe, moderate, mild or null."""
    return _first(normal, SEVERITY)


def distribution(normal: Column) -> Column:
    """diffuse, focal or null."""
    return _first(normal, DISTRIBUTION)


def progression(normal: Column) -> Column:
    """progressive, stable or null."""
    return _first(normal, PROGRESSION)


def method(clause: Column, whole: Column) -> Column:
    """The one method that a normalised clause names, else the one that the whole text names; null for none or several."""

    def only(normal: Column) -> Column:
        named = F.array_compact(F.array(*[_first(normal, {name: words}) for name, words in METHODS.items()]))
        return F.when(F.size(named) == 1, F.element_at(named, 1))

    return F.coalesce(only(clause), only(whole))


def subject(normal: Column) -> Column:
    """``(subject, rule)``: family before explicit fetal before maternal before other fetal words; the fetus by default."""
    padded = _padded(normal)
    out = F.struct(F.lit(DEFAULT_SUBJECT[0]).alias("subject"), F.lit(DEFAULT_SUBJECT[1]).alias("rule"))
    for who, rule, phrases in reversed(SUBJECTS):
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | padded.contains(f" {phrase} ")
        out = F.when(hit, F.struct(F.lit(who).alias("subject"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def measurement_map(text: Column) -> Column:
    """The first number before each unit, by name, as a map of doubles; empty where there is none."""
    entries = []
    for unit, name in MEASURES.items():
        pattern = rf"(?iu)(?<![0-9])([0-9]+(?:[.,][0-9]+)?)[\s\p{{Z}}]*{unit}[\s\p{{Z}}]*(?=$|[^\p{{L}}\p{{N}}_])"
        value = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        entries.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def gestational_age(normal: Column) -> Column:
    """Weeks of the first valid age in a normalised text (10 to 45 weeks, 0 to 6 days), at three decimals: ``n tuan [d ngay]`` before ``n w [+d]``."""

    def first(pattern: str) -> Column:
        weeks, days = (F.regexp_extract_all(normal, F.lit(pattern), F.lit(g)) for g in (1, 2))
        both = F.transform(F.arrays_zip(weeks.alias("w"), days.alias("d")), lambda x: F.struct(x["w"].cast("int").alias("w"), F.coalesce(F.nullif(x["d"], F.lit("")).cast("int"), F.lit(0)).alias("d")))
        good = F.filter(both, lambda x: x["w"].between(10, 45) & x["d"].between(0, 6))
        return F.when(F.size(good) > 0, F.round(F.get(good, F.lit(0))["w"] + F.get(good, F.lit(0))["d"] / 7.0, 3))

    return F.coalesce(first(r"(?<![0-9])([0-9]{1,2})\s*tuan(?:\s*([0-9])\s*ngay)?\b"), first(r"(?<![0-9])([0-9]{1,2})\s*w(?:\s*\+?\s*([0-9])\s*d?)?\b"))


def link_decision(scores: Column, status: Column) -> Column:
    """``(abstained, ambiguous, needs_review)`` from a mention's scores (best first) and its status."""
    top, second = F.coalesce(F.get(scores, F.lit(0)), F.lit(0.0)), F.get(scores, F.lit(1))
    ambiguous = F.coalesce(F.abs(top - second) < AMBIGUOUS_WITHIN, F.lit(False))
    abstained = (F.coalesce(F.size(scores), F.lit(0)) <= 0) | (top < ABSTAIN_BELOW) | ambiguous
    review = abstained | (top < REVIEW_BELOW) | (F.coalesce(status, F.lit("")) != "PRESENT")
    return F.struct(abstained.alias("abstained"), ambiguous.alias("ambiguous"), review.alias("needs_review"))


_TOKEN = re.compile(r"[^\W_]+")
_BOUNDARY = re.compile(BOUNDARY, re.I)


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(normalised word, start, end) of the words of a text that have something left when normalised."""
    return [(n, m.start(), m.end()) for m in _TOKEN.finditer(text) if (n := plain_text(m[0]))]


class Phrases:
    """Known phrases as a trie of words."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.root: dict = {}
        for term, phrase in rows:
            node = self.root
            words = plain_text(phrase).split()
            for word in words:
                node = node.setdefault(word, {})
            if words:
                node.setdefault("", (" ".join(words), set()))[1].add(term)

    def longest(self, words: list[tuple[str, int, int]], start: int) -> tuple[int, str, set[str]] | None:
        """(end, phrase, terms) of the phrase from ``start`` with the most words, then the widest; up to two reporting words inside may be skipped."""
        node, at, skipped, best = self.root, start, 0, None
        while at < len(words):
            below = node.get(words[at][0])
            if below is not None:
                node, at = below, at + 1
                if "" in node:
                    best = (at, *node[""])
            elif words[at][0] in REPORTING and skipped < MOST_SKIPPED and node is not self.root:
                skipped, at = skipped + 1, at + 1
            else:
                break
        return best


def phrase_mentions(texts: DataFrame, lexicon: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, start, end, mention, phrase, terms, clause, before)``: phrases of ``lexicon(term, phrase)`` in whole texts, left to right without overlap.

    From each word the longest phrase is taken, and the search goes on behind it. ``clause`` is the text between the
    boundaries around it, ``before`` what stands before it in its clause. Null texts give no row. One pass, no shuffle; the
    lexicon is measured, and broadcast if it has at most ``BROADCAST_BYTES`` characters: beyond, use ``text.dictionary_scan``
    with ``text.greedy_spans``, which join.
    """
    lex = lexicon.select("term", "phrase").where("term is not null and phrase is not null").distinct()
    if (lex.agg(F.sum(F.length("term") + F.length("phrase"))).collect()[0][0] or 0) > BROADCAST_BYTES:
        raise ValueError("the lexicon is too large to broadcast; use text.dictionary_scan and text.greedy_spans")
    shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in lex.collect()])
    slim = texts.select(key, column).where(F.col(column).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Phrases(shared.value)
        for batch in batches:
            of, rows = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                words, at = tokens(text), 0
                bounds = None
                while at < len(words):
                    hit = known.longest(words, at) if words[at][0] in known.root else None
                    if hit is None:
                        at += 1
                        continue
                    if bounds is None:
                        bounds = [m.span() for m in _BOUNDARY.finditer(text)]
                        ends, starts = [b for _, b in bounds], [a for a, _ in bounds]
                    start, end = words[at][1], words[hit[0] - 1][2]
                    k = bisect_right(ends, start) - 1
                    left = ends[k] if k >= 0 else 0
                    k = bisect_left(starts, end)
                    right = starts[k] if k < len(starts) else len(text)
                    of.append(n)
                    rows.append((start, end, text[start:end], hit[1], sorted(hit[2]), text[left:right], text[left:start]))
                    at = hit[0]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], [key, *_FOUND.names])

    return slim.mapInArrow(run, T.StructType([slim.schema[key], *_FOUND.fields]))


_FOUND = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("mention", T.StringType()), T.StructField("phrase", T.StringType())]
    + [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("clause", T.StringType()), T.StructField("before", T.StringType())]
)
