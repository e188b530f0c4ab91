"""Quantities written in different units, brought to one common unit. Pure SQL, one pass, no shuffle.

The text is normalised, number and unit are taken out with ``regexp_extract``, the unit's spelling is looked up
by a join with a small alias table, the unit is the first of text unit, unit field and default, and the factor
and offset of that unit are applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spelling of a unit, its factor to a plain share and its offset.
UNIT_ALIASES: list[tuple[str, float, float]] = [
    ("%", 1e-2, 0.0),
    ("percent", 1e-2, 0.0),
    ("per cent", 1e-2, 0.0),
    ("pct", 1e-2, 0.0),
    ("phần trăm", 1e-2, 0.0),
    ("pour cent", 1e-2, 0.0),
    ("per hundred", 1e-2, 0.0),
    ("‰", 1e-3, 0.0),
    ("permille", 1e-3, 0.0),
    ("per mille", 1e-3, 0.0),
    ("pro mille", 1e-3, 0.0),
    ("pour mille", 1e-3, 0.0),
    ("per thousand", 1e-3, 0.0),
    ("phần nghìn", 1e-3, 0.0),
    ("phần ngàn", 1e-3, 0.0),
    ("‱", 1e-4, 0.0),
    ("per_10k", 1e-4, 0.0),
    ("per 10k", 1e-4, 0.0),
    ("per ten thousand", 1e-4, 0.0),
    ("phần vạn", 1e-4, 0.0),
    ("per hundred thousand", 1e-5, 0.0),
    ("ppm", 1e-6, 0.0),
    ("per million", 1e-6, 0.0),
    ("parts per million", 1e-6, 0.0),
    ("phần triệu", 1e-6, 0.0),
    ("ratio", 1.0, 0.0),
    ("proportion", 1.0, 0.0),
    ("fraction", 1.0, 0.0),
    ("share", 1.0, 0.0),
]

NUMBER = r"(?:\d{1,3}(?: \d{3})+|\d[\d.,]*|[.,]\d+)(?:e[+-]?\d{1,3})?"
UNIT = (
    r"%|percent|per cent|pct|phần trăm|pour cent|per hundred thousand|per hundred|‰|permille|per mille|pro mille|pour mille"
    r"|per thousand|phần nghìn|phần ngàn|‱|per ten thousand|per 10k|phần vạn|ppm|parts per million|per million|phần triệu"
)
ABOUT = r"^(?:~|≈|about|around|roughly|approx\.?|approximately|circa|ca\.|c\.|khoảng|xấp xỉ|chừng|gần|environ|env\.) ?"
RANGE = rf"^(?:from |between |từ |de |entre )?({NUMBER}) ?({UNIT})? ?(?:-|–|—|−|to|and|đến|tới|à|et) ?({NUMBER}) ?({UNIT})?$"
RATIO = (
    rf"^(?:n ?= ?)?({NUMBER}) ?(?:\p{{L}}+ )?(?:/|out of|of|in|among|amongst|per|sur|parmi|trên tổng|trên|trong số|trong|từ) ?"
    rf"(?:n ?= ?)?({NUMBER})(?: \p{{L}}+)?$"
)
#: Without one of these a text is no range, or no ratio: looked for before the expression is tried.
RANGE_SIGNS = ["-", "–", "—", "−", "to", "and", "đến", "tới", "à", "et"]
RATIO_SIGNS = ["/", "of", "in", "among", "per", "sur", "parmi", "tr", "từ"]
SINGLE = rf"^({NUMBER}) ?({UNIT})?$"


def _normal(column: str) -> str:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("\\", "\\\\").replace("'", "\\'")
    blanks = r"[\\s\\u00a0\\u2000-\\u200b\\u202f\\u205f\\u3000\\ufeff]+"
    return f"trim(regexp_replace(lower(translate({column}, '{wide}', '{plain}')), '{blanks}', ' '))"


def _pattern(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(x: str) -> dict[str, str]:
    """Of a number's text: ``decimal``, its value with the comma, or the last of two kinds of mark, as decimal mark;
    ``thousands``, with commas as thousands marks, null where they can't be; ``whole``, where any mark is one. Null for no text."""
    comma, point = f"instr({x}, ',') > 0", f"instr({x}, '.') > 0"
    return {
        "decimal": (
            f"try_cast(case when {x} = '' then null when not ({comma}) and not ({point}) then {x} when {x} rlike '[.].*,' then replace(replace({x}, '.', ''), ',', '.')"
            f" when {x} rlike ',.*[.,]' then replace({x}, ',', '') when {x} rlike '[.].*[.]' then replace({x}, '.', '') else replace({x}, ',', '.') end as double)"
        ),
        "thousands": f"case when {comma} and {x} rlike '^[1-9][0-9]{{0,2}}(,[0-9]{{3}})+$' then try_cast(replace({x}, ',', '') as double) end",
        "whole": f"case when ({comma} or {point}) and {x} rlike '^[1-9][0-9]{{0,2}}([.,][0-9]{{3}})+$' then try_cast(regexp_replace({x}, '[.,]', '') as double) end",
    }


def _share(number: str, factor: str, offset: str = "0D") -> str:
    """A comma marks thousands only where the share then stays within the whole."""
    return f"(coalesce(case when {number}_thousands * {factor} + {offset} <= 1 then {number}_thousands end, {number}_decimal) * {factor} + {offset})"


def common_share(df: DataFrame, categories: DataFrame, raw: str = "frequency_raw", kind: str = "frequency_kind", out: str = "share_ppm") -> DataFrame:
    """``df`` with the column ``out``: the share that ``raw`` states, in parts per million, or null.

    Classes take their value from ``categories`` (code, label, label_vi, share_ppm; fixed and small). A unit or total
    in the text wins over ``kind``; a bare number takes the unit named by ``kind``, and without one a number up to 1
    is a share and a larger one a percentage. Ranges stand for their middle, approximate values for themselves.
    Null, empty, bounds, zero totals, words without a value and prose give null; shares above the whole give 1000000.
    Rows are kept as they are, repeated ones included; ``out`` replaces a column of that name.
    """
    spark = df.sparkSession
    units = F.broadcast(spark.createDataFrame(UNIT_ALIASES, "alias string, factor double, offset double"))
    base = df.drop(out) if out in df.columns else df
    t = base.withColumn("__t", F.expr(f"regexp_replace({_normal(f'`{raw}`')}, {_pattern(ABOUT)}, '')"))
    t = t.withColumn("__kind", F.expr(_normal(f"`{kind}`")))
    # one match per form: its groups are put side by side and split again; what doesn't match has no groups
    has = lambda signs: "(" + " or ".join(f"contains(__t, '{sign}')" for sign in signs) + ")"
    t = t.withColumn("__d", F.expr("__t rlike '[0-9]'"))
    # each form is tried only on what can have it and has none of the forms before
    tried = (("__r", RANGE, 4, has(RANGE_SIGNS)), ("__q", RATIO, 2, f"{has(RATIO_SIGNS)} and coalesce(size(__r), 0) < 5"), ("__s", SINGLE, 2, "coalesce(size(__r), 0) < 5 and coalesce(size(__q), 0) < 3"))
    for name, regex, groups, where in tried:
        marked = "concat('\\u0001', " + ", '\\u0001', ".join(f"'${k}'" for k in range(1, groups + 1)) + ")"
        t = t.withColumn(name, F.expr(f"case when __d and {where} then split(regexp_replace(__t, {_pattern(regex)}, {marked}), '\\u0001') end"))
    group = lambda name, k, n: f"if(coalesce(size({name}), 0) = {n + 1}, {name}[{k}], '')"
    parts = {
        "__ra": group("__r", 1, 4),
        "__ru": group("__r", 2, 4),
        "__rb": group("__r", 3, 4),
        "__rv": group("__r", 4, 4),
        "__qa": group("__q", 1, 2),
        "__qb": group("__q", 2, 2),
        "__sa": group("__s", 1, 2),
        "__su": group("__s", 2, 2),
        "__code": "upper(regexp_extract(__t, '(?:^|[(])(hp:[0-9]{7})[)]?$', 1))",
        "__label": "trim(regexp_replace(__t, ' ?[(]hp:[0-9]{7}[)]$', ''))",
    }
    t = t.withColumns({k: F.expr(v) for k, v in parts.items()})
    t = t.withColumn("__alias", F.expr("coalesce(nullif(coalesce(nullif(__rv, ''), nullif(__ru, '')), ''), nullif(__su, ''))"))

    cat = categories.select(
        F.upper(F.trim("code")).alias("__ccode"),
        F.array(F.expr(_normal("label")), F.expr(_normal("label_vi"))).alias("__labels"),
        F.col("share_ppm").cast("double").alias("__cshare"),
    )
    by_code = cat.groupBy("__ccode").agg(F.min("__cshare").alias("__code_share"))
    by_label = cat.select(F.explode("__labels").alias("__clabel"), "__cshare").where("__clabel is not null and __clabel <> ''").groupBy("__clabel").agg(F.min("__cshare").alias("__label_share"))
    t = t.join(F.broadcast(by_code), F.col("__code") == F.col("__ccode"), "left")
    t = t.join(F.broadcast(by_label), F.col("__label") == F.col("__clabel"), "left")
    text_unit = units.select(F.col("alias").alias("__ta"), F.col("factor").alias("__tf"), F.col("offset").alias("__to"))
    kind_unit = units.select(F.col("alias").alias("__ka"), F.col("factor").alias("__kf"), F.col("offset").alias("__ko"))
    t = t.join(F.broadcast(text_unit), F.col("__alias") == F.col("__ta"), "left")
    t = t.join(F.broadcast(kind_unit), F.col("__kind") == F.col("__ka"), "left")

    # a text has one form at most, so two numbers are all there is to read
    t = t.withColumns({f"__x{k}": F.expr(f"replace(coalesce({c}), ' ', '')") for k, c in enumerate(("nullif(__ra, ''), nullif(__qa, ''), __sa", "nullif(__rb, ''), __qb"))})
    t = t.withColumns({f"__n{k}_{name}": F.expr(value) for k in range(2) for name, value in _number(f"__x{k}").items()})
    t = t.withColumns(
        {
            "__f": F.expr("coalesce(__tf, __kf, case when coalesce(if(__rb <> '', __n1_decimal, __n0_decimal), 0D) <= 1 then 1D else 0.01D end)"),
            "__o": F.expr("coalesce(__to, __ko, 0D)"),
            "__total": F.expr("coalesce(__n1_whole, __n1_decimal)"),
        }
    )
    share = (
        "case when __code <> '' or __label_share is not null then coalesce(__code_share, __label_share) / 1000000D"
        f" when __rb <> '' then ({_share('__n0', '__f', '__o')} + {_share('__n1', '__f', '__o')}) / 2"
        f" when __qb <> '' then case when __total > 0 then {_share('__n0', '(1D / __total)')} end"
        f" when __sa <> '' then {_share('__n0', '__f', '__o')} end"
    )
    keep = [F.col(f"`{c}`") for c in base.columns]
    t = t.withColumn("__share", F.expr(share))
    return t.select(*keep, F.expr("case when __share >= 1 then 1000000 when __share >= 0 then cast(round(__share * 1000000D) as bigint) end").cast("bigint").alias(out))


def found(spark: SparkSession, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """``(annotation_id, share_ppm)`` of the annotations that state a value; distinct rows, null ids left out."""
    slim = annotations.select("annotation_id", "frequency_raw", "frequency_kind").where("annotation_id is not null and frequency_raw is not null")
    return common_share(slim, categories).where("share_ppm is not null").select("annotation_id", "share_ppm").distinct()
