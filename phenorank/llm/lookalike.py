"""One consistent spelling for text that prints alike but is stored in different characters.

Each token of a text is run through a trie of the known vocabulary by a weighted edit automaton: a look-alike or a
character that isn't drawn costs nothing, any other difference costs its weight. A token within the budget gets the
vocabulary's spelling; any other token is normalised by table, so that every text gets a defined spelling. The two
differ where a letter is drawn like either of two: the automaton follows both and the vocabulary decides, while the
table can only ever say one. The budget is 0 by default, since texts that look different must stay different.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenorank.session import broadcast_if_small

# Letters of other scripts, and of Latin itself, that are drawn like a plain Latin letter.
DRAWN_ALIKE: list[tuple[str, str]] = [
    # Cyrillic small and capital
    ("асԁеһіјӏорԛѕѵԝхуү", "acdehijlopqsvwxyy"),
    ("АВСЕԌНІЈКӀМОРԚЅТѴԜХУҮ", "ABCEGHIJKIMOPQSTVWXYY"),
    # Greek small and capital
    ("αινορυϲϳ", "aivopucj"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    # Armenian small and capital
    ("ցհյոռսզօ", "ghjnnuqo"),
    ("ԼՕՏՍ", "LOSU"),
    # Cherokee capital
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃ", "ABCDEGHJKLMPRSTVWZ"),
    # Lisu
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    # Latin variants, and the two other capitals drawn like the crossed D
    ("ɑɡÐƉ", "agĐĐ"),
]
# Marks, hyphens and blanks that aren't told apart when shown.
MARKS_ALIKE = {"͂": "̃"}
HYPHENS = "‐‑‒–−⁃˗֊᠆﹘﹣－➖"
BLANK_LETTERS = "⠀ㅤﾠᅟᅠ"
# Letters drawn like either of two plain ones. The table takes the first; which is meant, the vocabulary tells.
AMBIGUOUS = {"ӏ": "lI", "Ӏ": "Il", "Ι": "Il", "І": "Il", "ǀ": "lI", "υ": "uv", "ʋ": "vu", "զ": "qg"}
#: Compatibility forms that are drawn like what they stand for.
SAME_SHAPE_TAGS = ("<wide>", "<narrow>", "<small>", "<noBreak>")
SAME_SHAPE_RANGES = ((0x2160, 0x217F), (0xFB00, 0xFB06), (0x01C4, 0x01CC), (0x0132, 0x0133), (0x2024, 0x2026))

_LETTERS = {ord(a): b for many, plain in DRAWN_ALIKE for a, b in zip(many, plain, strict=True)} | {ord(a): b[0] for a, b in AMBIGUOUS.items()}
#: Small capitals that are drawn like the small letter.
_LETTERS |= {ord(unicodedata.lookup(f"LATIN LETTER SMALL CAPITAL {c.upper()}")): c for c in "covwz"}
#: Text made of these alone, without blanks at an end or in a row, is already in its one spelling.
_PLAIN = re.compile(r"[!-~À-ÃÈ-ÊÌÍÒ-ÕÙÚÝà-ãè-êìíò-õùúýĂăĐđĨĩŨũƠơƯưẠ-ỹ]+(?: [!-~À-ÃÈ-ÊÌÍÒ-ÕÙÚÝà-ãè-êìíò-õùúýĂăĐđĨĩŨũƠơƯưẠ-ỹ]+)*")
_BLANKS = re.compile("[\\s" + BLANK_LETTERS + "]+")
_STROKED = re.compile("([dD])([̀-͎]*)[̵̶]")
_DOTLESS = re.compile("ı(?=̣*[̀-̄̆-̌͂])")


def not_drawn(ch: str) -> bool:
    """Format and control characters, variation selectors and the grapheme joiner."""
    code = ord(ch)
    return (
        unicodedata.category(ch) == "Cf"
        or (unicodedata.category(ch) == "Cc" and not ch.isspace())
        or 0xFE00 <= code <= 0xFE0F
        or 0xE0100 <= code <= 0xE01EF
        or code in (0x034F, 0x180B, 0x180C, 0x180D, 0x180F)
    )


class _Table(dict):
    """Character -> what it is drawn as, worked out as characters come up; for str.translate."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        out: str | None = ch
        if code in _LETTERS:
            out = _LETTERS[code]
        elif ch in MARKS_ALIKE:
            out = MARKS_ALIKE[ch]
        elif ch in HYPHENS:
            out = "-"
        elif ch in BLANK_LETTERS or ch.isspace():
            out = " "
        elif not_drawn(ch):
            out = None
        else:
            tag = unicodedata.decomposition(ch).split(" ")[0]
            if tag in SAME_SHAPE_TAGS or any(a <= code <= b for a, b in SAME_SHAPE_RANGES):
                out = unicodedata.normalize("NFKC", ch)
        self[code] = out
        return out


_TABLE = _Table()


def by_table(text: str) -> str:
    """The spelling of ``text`` by table alone: base letters, marks in canonical order and composed, one kind of blank."""
    text = unicodedata.normalize("NFD", text).translate(_TABLE)
    text = unicodedata.normalize("NFD", text)
    if "̵" in text or "̶" in text:
        text = _STROKED.sub(lambda m: ("đ" if m[1] == "d" else "Đ") + m[2], text)
    if "ı" in text:
        text = _DOTLESS.sub("i", text)
    return unicodedata.normalize("NFC", text)


class Trie:
    """Vocabulary in decomposed characters. A node is a dict of children; the spelling stands under the key ''."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for word in sorted(set(words)):
            node = self.root
            for ch in unicodedata.normalize("NFD", word):
                node = node.setdefault(ch, {})
            node[""] = word

    def spelling(self, token: str, budget: float = 0.0, weight: float = 1.0) -> tuple[str, float] | None:
        """The vocabulary's spelling of ``token`` with the least cost up to ``budget``, ties by spelling; else None.

        States are trie nodes with their cost. Characters that aren't drawn keep all states; a look-alike moves to
        the child it is drawn as for nothing; with budget left, a change, a drop or an addition costs ``weight``.
        """
        states = {id(self.root): (0.0, self.root)}
        for raw in unicodedata.normalize("NFD", token):
            if not_drawn(raw):
                continue
            drawn = AMBIGUOUS.get(raw) or (_TABLE[ord(raw)] or "",)  # one after the other, a state for each that goes on
            step: dict[int, tuple[float, dict]] = {}

            def reach(node: dict, cost: float, into: dict = step) -> None:
                if cost <= budget and (id(node) not in into or into[id(node)][0] > cost):
                    into[id(node)] = (cost, node)

            for cost, node in states.values():
                for chars in drawn:
                    at: dict | None = node
                    for ch in chars:
                        at = at.get(ch) if at else None
                    if at is not None:
                        reach(at, cost)
                if cost + weight <= budget:
                    reach(node, cost + weight)
                    for ch, child in node.items():
                        if ch:
                            reach(child, cost + weight)
            if budget:
                self._skip(step, budget, weight)
            states = step
            if not states:
                return None
        ends = [(cost, node[""]) for cost, node in states.values() if "" in node]
        if not ends:
            return None
        cost, word = min(ends)
        return word, cost

    @staticmethod
    def _skip(states: dict, budget: float, weight: float) -> None:
        """Characters of the vocabulary that the token lacks."""
        todo = list(states.values())
        while todo:
            cost, node = todo.pop()
            for ch, child in node.items():
                if ch and cost + weight <= budget and (id(child) not in states or states[id(child)][0] > cost + weight):
                    states[id(child)] = (cost + weight, child)
                    todo.append(states[id(child)])


class Speller:
    """Spells texts one way, remembering the tokens it has met (up to a number of them, then it starts afresh)."""

    def __init__(self, vocabulary: Iterable[str], budget: float = 0.0, remember: int = 200_000):
        self.trie = Trie(vocabulary)
        self.budget, self.remember = budget, remember
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            hit = self.trie.spelling(token, self.budget)
            got = self.known[token] = hit[0] if hit else by_table(token)
        return got

    def text(self, text: str) -> str:
        if not self.budget and _PLAIN.fullmatch(text):
            return text
        known, token = self.known, self.token
        return " ".join([w for t in _BLANKS.split(text) if (w := known.get(t) or token(t))])


def vocabulary(catalogue: DataFrame, column: str) -> list[str]:
    """The distinct tokens of a reference column, spelled by table. The reference list is collected: it must be bounded."""
    texts = [r[0] for r in catalogue.select(column).where(F.col(column).isNotNull()).distinct().collect()]
    return sorted({w for t in texts for w in by_table(_BLANKS.sub(" ", t)).split()})


@lru_cache(maxsize=4)
def _speller(words: tuple[str, ...], budget: float) -> Speller:
    return Speller(words, budget)


def spelled(df: DataFrame, column: str, words: list[str], out: str = "canonical", budget: float = 0.0) -> DataFrame:
    """``df`` with ``out``: the one spelling of ``column``. Equal-looking texts get equal spellings, others differ.

    Letter case, accents, tone marks and wording are kept. Kinds of blank and runs of blanks become one blank, blanks
    at the ends go. Null stays null; a text without anything to see becomes ''. Rows and all other columns are kept;
    a column named like ``out`` is replaced. ``words`` is the reference vocabulary, broadcast to the workers: it must
    be bounded, and may be empty. One pass, no shuffle.
    """
    base = df.drop(out) if out in df.columns else df
    shared = df.sparkSession.sparkContext.broadcast(tuple(words))
    at = base.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = _speller(shared.value, budget)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            made = pa.array([None if t is None else speller.text(t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    from pyspark.sql.types import StringType, StructType

    return base.mapInArrow(run, StructType([*base.schema.fields, *StructType().add(out, StringType()).fields]))


def same_when_shown(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(mention_id, hpo_id)``: mention and entry read the same when shown, but aren't the same characters.

    Null ids and texts, and texts without anything to see, give no row; repeated rows give one.
    """
    words = vocabulary(catalogue, "vi")
    left = spelled(mentions.select("mention_id", "mention_text").where("mention_id is not null and mention_text is not null"), "mention_text", words)
    right = spelled(catalogue.select(F.col("id").alias("hpo_id"), "vi").where("id is not null and vi is not null"), "vi", words)
    right = right.where("canonical <> ''").distinct()
    pairs = left.join(broadcast_if_small(right), "canonical").where("mention_text <> vi")
    return pairs.select("mention_id", "hpo_id").distinct()


def found(spark: SparkSession, mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    return same_when_shown(mentions, catalogue)
