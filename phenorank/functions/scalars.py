"""Scalar column functions of the engine."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-4


@cache
def _marks() -> re.Pattern[str]:
    """All nonspacing marks, as ranges."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn"]
    starts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if c != after - 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]+")


_KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789:+" else 32 for c in range(256))


def plain_text(text: str) -> str:
    if not text.isascii():
        text = _marks().sub("", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold().replace("đ", "d")))
    return " ".join(text.lower().encode("ascii", "replace").translate(_KEPT).decode().split())


def normalize_text(text: Column) -> Column:
    """NFKC and lower case without accents; anything but a-z, 0-9, ':' and '+' is one blank; trimmed. Null stays null.

    In Arrow batches, as Spark has no Unicode normalisation.
    """

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else plain_text(t))

    # nondeterministic only in name: else filters on the result are pushed down and each text is normalised twice
    return F.pandas_udf(run, "string").asNondeterministic()(text)


def nfc(text: Column) -> Column:
    """Composed form, in Arrow batches; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(run, "string").asNondeterministic()(text)


def group_key(text: Column) -> Column:
    """Tokens of a-z and 0-9 without a leading 'tat', joined by blanks: the key that groups spellings of a phrase."""
    tokens = F.trim(F.regexp_replace(normalize_text(text), "[^a-z0-9]+", " "))
    return F.regexp_replace(tokens, "^tat ", "")


def normalize_term_id(value: Column) -> Column:
    """'hp_1234567', 'HP1234567' and ' HP:1234567 ' alike as 'HP:1234567'; null where it is no term id."""
    tidy = F.regexp_replace(F.replace(F.upper(F.trim(value)), F.lit("_"), F.lit(":")), "^HP(?=[0-9])", "HP:")
    return F.when(tidy.rlike(r"^HP:[0-9]{7}$"), tidy)


def token(value: Column) -> Column:
    """Lower case, blanks and hyphens as '_'."""
    return F.regexp_replace(F.lower(F.trim(value)), r"[-\s]+", "_")


def normalize_status(value: Column) -> Column:
    """PRESENT, SUSPECTED, ABSENT or NOT_ASSESSED from English or Vietnamese spellings; else null."""
    name = F.upper(token(value))
    return (
        F.when(name.isin("PRESENT", "CÓ", "OBSERVED", "POSITIVE"), "PRESENT")
        .when(name.isin("SUSPECTED", "NGHI_NGỜ", "POSSIBLE", "UNCERTAIN"), "SUSPECTED")
        .when(name.isin("ABSENT", "KHÔNG", "NEGATED", "NEGATIVE"), "ABSENT")
        .when(name.isin("NOT_ASSESSED", "UNKNOWN", "CHƯA_KHẢO_SÁT"), "NOT_ASSESSED")
    )


def normalize_subject(value: Column) -> Column:
    """fetus, mother, family or unknown."""
    name = token(value)
    return (
        F.when(name.isin("fetus", "thai_nhi", "fetal"), "fetus").when(name.isin("mother", "mẹ", "maternal"), "mother").when(name.isin("family_history", "family", "gia_đình"), "family").otherwise("unknown")
    )


def finite(value: Column) -> Column:
    """The value as a double, null where it isn't a finite number."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def log_odds(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def sigmoid(x: Column) -> Column:
    """Stable in both tails."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log_sum_exp(values: Column) -> Column:
    """Of an array of doubles, null for an empty one."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


# 80 and 10 of 100 hash buckets, and the pattern of a pseudonymous id below.
def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """The first 8 hex digits of a key's SHA-256, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def hash_split(key: Column) -> Column:
    """train for 80 of 100 hash buckets, validation and test for 10 each."""
    b = hash_bucket(key)
    return F.when(b < 80, "train").when(b < 90, "validation").otherwise("test")


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def pseudonymous(value: Column) -> Column:
    """An id that names nobody: a letter, 2 to 63 more of a plain alphabet, no @, no 9 digits in a row."""
    return F.coalesce(value.rlike(r"^[A-Za-z][A-Za-z0-9_.:\-]{2,63}$") & ~value.rlike(r"[0-9]{9,}"), F.lit(False))


def identifier_hint(text: Column) -> Column:
    """Whether a text may name a person: e-mail, phone number, or nine digits in a row."""
    return F.coalesce(text.rlike(r"[\w.+-]+@[\w-]+\.[\w.]+|\b0\d{9,10}\b|\d{9,}"), F.lit(False))


def strip_json(value: Column) -> Column:
    """The outermost object of a model's answer, without code fences."""
    return F.nullif(F.regexp_extract(value, r"(?s)(\{.*\})", 1), F.lit(""))
