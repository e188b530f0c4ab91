"""Free-entered values mapped to a canonical list by a symmetric-delete dictionary.

The reference list is taken apart into its parts (what, where, how) by lining up each entry with its synonyms. A value
is searched for phrases of these parts: first as they are, then within a bounded edit distance, for which the
dictionary holds every phrase under all strings that deleting a few of its characters leaves. Readings of a value are
ranked by weighted Damerau-Levenshtein distance and what they leave unread; equally good entries by the hints of an
earlier retriever and by reference frequency. Values that name no entry are reported as misses.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenorank.llm.lookalike import by_table
from phenorank.session import written

MISS = "NONE"
#: Edits that a phrase may be away, by its length without blanks.
EDITS = ((2, 0), (5, 1), (10_000, 2))
#: Cost of an edit, of a swap, of an accent left out, of another accent, of a character left unread.
EDIT, SWAP, BARE, ACCENT, UNREAD = 1.0, 0.8, 0.12, 0.35, 0.5
#: What alone, and what and where together, may be this far away per character.
FAR_WHAT, FAR = 0.34, 0.24
#: Readings this close in cost are equally good.
CLOSE = 0.05
MOST_WORDS = 5
#: Deletions are made in so many leading characters: strings within two edits agree after deleting two in each beginning.
PREFIX = 8

_WORDS = re.compile(r"\w+")
# How the telex method types letters and tones.
TELEX_LETTERS = {"ă": "aw", "â": "aa", "ê": "ee", "ô": "oo", "ơ": "ow", "ư": "uw", "đ": "dd"}
TELEX_TONES = {"́": "s", "̀": "f", "̉": "r", "̃": "x", "̣": "j"}


def words(text: str) -> list[str]:
    return _WORDS.findall(by_table(text).lower())


def bare(text: str) -> str:
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d")) if not unicodedata.combining(c))


def telex(word: str) -> str:
    """The word as typed in telex, its tone last."""
    tone, out = "", []
    for ch in word:
        marks = unicodedata.normalize("NFD", ch)
        for mark, key in TELEX_TONES.items():
            if mark in marks:
                tone, marks = key, marks.replace(mark, "")
        plain = unicodedata.normalize("NFC", marks)
        out.append(TELEX_LETTERS.get(plain, plain))
    return "".join(out) + tone


def distance(a: str, b: str, lenient: bool, most: float = float("inf")) -> float:
    """Weighted Damerau-Levenshtein distance of a typed text ``a`` from a phrase ``b``; accents weigh little, none if ``lenient``. Beyond ``most`` infinite."""
    if a == b:
        return 0.0
    pa_, pb = bare(a) if len(bare(a)) == len(a) else a, bare(b) if len(bare(b)) == len(b) else b
    before: list[float] = []
    last = [j * EDIT for j in range(len(b) + 1)]
    for i, ca in enumerate(a, 1):
        now = [i * EDIT]
        for j, cb in enumerate(b, 1):
            if ca == cb:
                step = 0.0
            elif pa_[i - 1] == pb[j - 1]:
                step = (0.0 if lenient else BARE) if ca == pa_[i - 1] else ACCENT
            else:
                step = EDIT
            cost = min(last[j - 1] + step, last[j] + EDIT, now[j - 1] + EDIT)
            if i > 1 and j > 1 and pa_[i - 1] == pb[j - 2] and pa_[i - 2] == pb[j - 1] and pa_[i - 1] != pa_[i - 2]:
                cost = min(cost, before[j - 2] + SWAP)
            now.append(cost)
        if min(now) > most and min(last) > most:
            return float("inf")
        before, last = last, now
    return last[-1]


def deletions(text: str, most: int) -> set[str]:
    """All strings that are left after deleting up to ``most`` characters."""
    out = last = {text}
    for _ in range(min(most, len(text) - 1)):
        last = {t[:k] + t[k + 1 :] for t in last for k in range(len(t))}
        out = out | last
    return out


def allowed(length: int) -> int:
    return next(edits for most, edits in EDITS if length <= most)


def _splits(name: list[str], synonym: list[str]) -> list[tuple[str, str, str, str]]:
    """(what, where, how, other word for what) such that name = what where how and synonym = where other how."""
    out = []
    tail = 0
    while tail < min(len(name), len(synonym)) and name[-1 - tail] == synonym[-1 - tail]:
        tail += 1
    for how in range(tail, -1, -1):
        head, rest = name[: len(name) - how], synonym[: len(synonym) - how]
        for where in range(1, min(len(rest), len(head))):
            if head[-where:] == rest[:where]:
                out.append((" ".join(head[:-where]), " ".join(rest[:where]), " ".join(name[len(name) - how :]), " ".join(rest[where:])))
    return out


class Reference:
    """The canonical list: its parts, their phrases, and the entries they make up."""

    def __init__(self, rows: list[tuple[str, str | None, str | None, str | None, str | None]]):
        parsed, options = {}, {}
        for id_, vi, en, aliases, synonyms in rows:
            if id_ is None:
                continue
            name = words(vi or "")
            others = [s for s in by_table(synonyms or "").split("|") if words(s)]
            foreign = [words(s.split("(")[0]) + ["("] + words(s.split("(", 1)[1]) for s in others if "(" in s]
            native = [words(s) for s in others if "(" not in s]
            parsed[id_] = (name, words(en or ""), foreign, native, [a for a in (aliases or "").split("|") if words(a)])
            options[id_] = [s for n in native for s in _splits(name, n)]
        # of several ways to take an entry apart, the one whose parts are most common
        weight: Counter = Counter()
        for splits in options.values():
            for what, where, how, _ in splits:
                weight.update({("what", what), ("where", where), ("how", how)})
        self.phrases: dict[tuple[str, ...], set[tuple[str, str]]] = defaultdict(set)  # words -> (kind, part)
        self.entries: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)  # (what, where) -> (how, id)
        self.whole: dict[str, set[str]] = defaultdict(set)
        parts: dict[str, tuple[str, str, str]] = {}
        for id_, splits in sorted(options.items()):
            name, en, foreign, native, aliases = parsed[id_]
            for form in [name, en, *[[w for w in f if w != "("] for f in foreign], *native]:
                if form:
                    self.whole[" ".join(form)].add(id_)
            for alias in aliases:
                self.whole[" ".join(words(alias))].add(id_)
            if splits:
                what, where, how, other = max(splits, key=lambda s: (weight["what", s[0]] * weight["where", s[1]] * max(1, weight["how", s[2]]), s))
                parts[id_] = what, where, how
                self.entries[what, where].append((how, id_))
                for kind, phrase, part in (("what", what, what), ("what", other, what), ("where", where, where), ("how", how, how)):
                    if phrase:
                        self.phrases[tuple(phrase.split())].add((kind, part))
        # the foreign names: "how what of the where", and "where what (how)"
        votes: Counter = Counter()
        for id_, (what, where, how) in parts.items():
            _, en, foreign, _, _ = parsed[id_]
            if "of" in en and en[en.index("of") + 1 :][:1] == ["the"]:
                at = len(en) - 1 - en[::-1].index("of")
                place = en[at + 2 :]
                votes["where", tuple(place), where] += 1
                for f in foreign:
                    cut = f.index("(")
                    if f[: len(place)] == place and len(place) < cut:
                        votes["what", tuple(f[len(place) : cut]), what] += 1
                        votes["how", tuple(f[cut + 1 :]), how] += 1
        for (kind, phrase, part), _ in votes.items():
            if phrase and votes[kind, phrase, part] == max(n for (k, p, _), n in votes.items() if (k, p) == (kind, phrase)):
                self.phrases[phrase].add((kind, part))
        #: blank-free phrase without accents, or in telex -> (accented phrase, kind, part)
        self.exact: dict[str, set[tuple[str, str, str]]] = defaultdict(set)
        for phrase, uses in self.phrases.items():
            shown = "".join(phrase)
            for kind, part in uses:
                self.exact[bare(shown)].add((shown, kind, part))
                typed = "".join(telex(w) for w in phrase)
                if typed != bare(shown):
                    self.exact[typed].add((typed, kind, part))
        #: words that only telex writes so; where they occur, accents left out are meant to be
        self.typed = {telex(w) for p in self.phrases for w in p} - {bare(w) for p in self.phrases for w in p}
        self.deleted: dict[str, set[str]] = defaultdict(set)
        for key in self.exact:
            for left in deletions(key[:PREFIX], allowed(len(key))):
                self.deleted[left].add(key)
        self.longest = max(map(len, self.exact), default=0)
        #: places whose name is short, or part of another phrase: it may be all that a typing error left of that one
        named = defaultdict(set)
        for phrase, uses in self.phrases.items():
            for kind, part in uses:
                if kind == "where":
                    named[part].add(phrase)
        self.doubtful = {
            part
            for part, phrases in named.items()
            if any(len(bare("".join(p))) <= 4 or any(len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q))) for q in self.phrases) for p in phrases)
        }
        self.known: dict[tuple[str, int, bool], list[tuple[str, str, float]]] = {}

    def lookup(self, shown: str, plain: str, edits: int, lenient: bool) -> list[tuple[str, str, float]]:
        """(kind, part, cost) of the phrases that ``shown`` (no blanks; ``plain`` without accents) may stand for, within so many edits."""
        got = self.known.get((shown, edits, lenient))
        if got is not None:
            return got
        keys = {plain} if plain in self.exact else set()
        most = min(edits, allowed(len(plain) + 1))
        if most:
            for left in deletions(plain[:PREFIX], most):
                if left in self.deleted:
                    keys |= self.deleted[left]
        best: dict[tuple[str, str], float] = {}
        for key in keys:
            if abs(len(key) - len(plain)) > most:
                continue
            near = min(most, allowed(min(len(key), len(plain) + 1))) + 3 * ACCENT if key != plain else float("inf")
            for phrase, kind, part in self.exact[key]:
                cost = distance(shown, phrase, lenient, near)
                if cost <= near and cost < best.get((kind, part), 1e9):
                    best[kind, part] = cost
        got = [(kind, part, cost) for (kind, part), cost in best.items()]
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[shown, edits, lenient] = got
        return got

    def read(self, tokens: list[str]) -> tuple[float, list[str]]:
        """(cost, entries) of the best reading; no entry where the best reading names none."""
        lenient = all(t.isascii() for t in tokens) and not any(t in self.typed for t in tokens)
        joined = " ".join(tokens)
        if joined in self.whole:
            return 0.0, sorted(self.whole[joined])
        best: tuple[float, list[str]] = (float("inf"), [])
        for edits in range(3):  # the further away, the dearer to look up: only where nothing sure is nearer
            cost, ids, where, off = self._readings(tokens, edits, lenient)
            if not best[1] or ids and cost < best[0]:
                best = cost, ids
            if best[1] and (cost < UNREAD or where not in self.doubtful and (off < EDIT / 2 or cost < 3 * UNREAD)):
                break
        return best

    def _readings(self, tokens: list[str], edits: int, lenient: bool) -> tuple[float, list[str], str, float]:
        """Cost, entries and place of the best reading, and how far off its phrases are."""
        n = len(tokens)
        at: dict[str, list[tuple[int, int, str, float]]] = {"what": [], "where": [], "how": []}
        plains = [bare(t) for t in tokens]
        for i in range(n):
            shown = plain = ""
            for j in range(i, min(n, i + MOST_WORDS)):
                shown += tokens[j]
                plain += plains[j]
                if len(shown) > self.longest + edits:
                    break
                for kind, part, cost in self.lookup(shown, plain, edits, lenient):
                    at[kind].append((i, j + 1, part, cost))
        unread = [0.0]
        for t in tokens:
            unread.append(unread[-1] + UNREAD * len(t))
        none: tuple[int, int, str, float] = (0, 0, "", 0.0)

        def gain(m: tuple[int, int, str, float]) -> float:
            return unread[m[1]] - unread[m[0]] - m[3]

        best_cost = unread[-1]
        for kind in at:  # a worthless match can't be in a best reading, nor one that is dearer than another of the same part and words
            nearest: dict[tuple[int, int, str], tuple[int, int, str, float]] = {}
            for m in sorted(at[kind], key=lambda m: m[3]):
                nearest.setdefault(m[:3], m)
            at[kind] = [*sorted((m for m in nearest.values() if gain(m) > 0), key=gain, reverse=True), none]
        if at["what"][0] is none:
            return best_cost, [], "", 0.0
        most_how = gain(at["how"][0])

        def pairs(limit: Callable[[], float]) -> Iterator[tuple]:
            """(what, where, their entries, gain) in falling gain for each what, as long as a reading with them may cost no more than ``limit()``."""
            for what in at["what"]:
                for where in at["where"]:
                    two = gain(what) + gain(where)
                    if unread[-1] - two - most_how > limit() + 1e-9:
                        break
                    if what is none or where is none:
                        yield what, where, [], two
                    elif what[1] <= where[0] or where[1] <= what[0]:
                        yield what, where, self.entries.get((what[2], where[2]), []), two

        def hows(what: tuple, where: tuple) -> Iterator[tuple]:
            return (how for how in at["how"] if how is none or not any(m is not none and how[1] > m[0] and m[1] > how[0] for m in (what, where)))

        for what, where, entries, two in pairs(lambda: best_cost):
            if not entries:
                best_cost = min(best_cost, unread[-1] - two - gain(next(hows(what, where))))
        ties, nearest_cost = [], best_cost + CLOSE
        for what, where, entries, two in pairs(lambda: nearest_cost + CLOSE):
            if not entries or what[3] > FAR_WHAT * (unread[what[1]] - unread[what[0]]) / UNREAD:
                continue
            if what[3] + where[3] > FAR * (unread[what[1]] - unread[what[0]] + unread[where[1]] - unread[where[0]]) / UNREAD:
                continue
            for how in hows(what, where):
                cost = unread[-1] - two - gain(how)
                agree = [e for e in entries if e[0] == how[2]] or entries
                new = [(cost + (0.0 if h == how[2] else 0.02 if how is none else 0.3), id_, where[2], what[3] + where[3]) for h, id_ in agree]
                ties += new
                nearest_cost = min(nearest_cost, *(t[0] for t in new))
        if not ties:
            return best_cost, [], "", 0.0
        least, _, place, off = min(ties)
        if least > best_cost + CLOSE:
            return best_cost, [], "", 0.0
        return least, sorted({id_ for cost, id_, _, _ in ties if cost <= least + CLOSE}), place, off


_read: dict[str, Reference] = {}


def read_values(values: DataFrame, reference_rows: list[tuple], key: str, text: str) -> DataFrame:
    """``(key, ids, cost)``: the equally good entries of each value, none for a miss.

    Values are brought to their words first; each different sequence of words is read once and joined back, so values
    that repeat, however often, cost one reading. Values without anything to see give no row, null keys neither. The
    reference list is broadcast; it must be bounded.
    """
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast(reference_rows)
    name = uuid.uuid4().hex
    slim = values.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [by_table(value) for value in batch.column(1).to_pylist()]
            made = [" ".join(_WORDS.findall(c.lower())) if c.strip() else None for c in clean]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["key", "seen"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = _read.get(name)
        if reference is None:
            _read.clear()
            reference = _read[name] = Reference(shared.value)
        for batch in batches:
            got = [reference.read(seen.split(" ") if seen else []) for seen in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array([g[0] for g in got], pa.float64())], ["seen", "ids", "cost"])

    tidied, _ = written(slim.mapInArrow(tidy, T.StructType([T.StructField("key", slim.schema["key"].dataType), T.StructField("seen", T.StringType())])).where("seen is not null"), "tidied")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    readings = tidied.select("seen").distinct().repartition(parts, "seen").mapInArrow(read, "seen string, ids array<string>, cost double")
    return tidied.join(readings, "seen").select("key", "ids", "cost")


def mapped(mentions: DataFrame, catalogue: DataFrame, hints: DataFrame) -> DataFrame:
    """``(mention_id, hpo_id, cost)`` for each unlinked mention with visible text: its entry, or ``NONE``.

    Where several entries read equally well, one that the earlier retriever proposed for the mention goes first, by its
    score, then the one that linked mentions use more often, then the smaller id. A mention whose rows differ in text
    gets an entry per text; null mention ids give no row.
    """
    rows = [tuple(r) for r in catalogue.select("id", "vi", "en", "aliases", "synonyms").where("id is not null").distinct().collect()]
    open_ = mentions.where("hpo_id is null").select("mention_id", "mention_text")
    read, _ = written(read_values(open_, rows, "mention_id", "mention_text"), "read")
    usage = mentions.where("hpo_id is not null").groupBy("hpo_id").agg(F.count("*").alias("uses"))
    usage = usage.join(F.broadcast(catalogue.select(F.col("id").alias("hpo_id")).distinct()), "hpo_id", "left_semi")  # at most the catalogue
    sure = read.where("size(ids) <= 1").select(F.col("key").alias("mention_id"), F.coalesce(F.expr("get(ids, 0)"), F.lit(MISS)).alias("hpo_id"), "cost")
    tied = read.where("size(ids) > 1").select(F.col("key").alias("mention_id"), "ids", "cost", F.explode("ids").alias("hpo_id"))
    said = hints.where("mention_id is not null and hpo_id is not null").groupBy("mention_id", "hpo_id").agg(F.max(F.nanvl("score", F.lit(None).cast("double"))).alias("score"))
    ranked = tied.join(said, ["mention_id", "hpo_id"], "left").join(F.broadcast(usage), "hpo_id", "left")
    best = ranked.groupBy("mention_id", "ids").agg(
        F.expr("min_by(struct(hpo_id, cost), struct(-coalesce(score, -1D), -coalesce(uses, 0), hpo_id))").alias("best")
    )
    return sure.unionByName(best.select("mention_id", "best.hpo_id", "best.cost")).distinct()


def found(spark: SparkSession, mentions: DataFrame, catalogue: DataFrame, hints: DataFrame) -> DataFrame:
    return mapped(mentions, catalogue, hints).select("mention_id", "hpo_id").distinct()


def misses(mentions: DataFrame, catalogue: DataFrame, hints: DataFrame) -> DataFrame:
    """``(mention_id)`` of the unlinked mentions that name no entry."""
    return mapped(mentions, catalogue, hints).where(F.col("hpo_id") == MISS).select("mention_id").distinct()
